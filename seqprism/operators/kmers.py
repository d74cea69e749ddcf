"""k-mer occurrences, counts and feature statistics in long form."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from seqprism.functions import arrays
from seqprism.functions.sequence import canonical, windows

#: Classes whose counts a task holds at once.
HELD_CLASSES = 1000


def clean(sites: DataFrame) -> DataFrame:
    """Upper-case sequences; those with an N are dropped."""
    return sites.withColumn("seq", F.upper("seq")).where(~F.col("seq").contains("N"))


def occurrences(sites: DataFrame, kmin: int, kmax: int, seq: str = "seq") -> DataFrame:
    """sites without the sequence, one row for each k-mer occurrence: k, pos (from 0), kmer (canonical)."""

    def placed(k: int) -> Column:
        return F.transform(windows(F.col(seq), k), lambda s, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), canonical(s).alias("kmer")))

    parts = [placed(k) for k in range(kmin, kmax + 1)]
    others = [c for c in sites.columns if c != seq]
    return sites.select(*others, F.explode(F.concat(*parts)).alias("o")).select(*others, "o.k", "o.pos", "o.kmer")


def _spelled(sites: DataFrame, others: list[str], kmin: int, kmax: int) -> DataFrame:
    """others, k and the k-mer as it stands in the sequence, for each occurrence."""
    lengths = sites.select(*others, "seq", F.explode(F.array(*map(F.lit, range(kmin, kmax + 1)))).alias("k")).where(F.length("seq") >= F.col("k"))
    placed = lengths.select(*others, "seq", "k", F.explode(F.sequence(F.lit(1), F.length("seq") - F.col("k") + 1)).alias("_at"))
    return placed.select(*others, "k", F.substring("seq", F.col("_at"), F.col("k")).alias("_spelled"))


def site_counts(sites: DataFrame, kmin: int, kmax: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(site_id, keep, k, kmer, cnt); keep: columns with one value for each site.

    Where the sites are dealt by site_id, no k-mer is shuffled.
    """
    others = ["site_id", *keep]
    found = _spelled(sites, others, kmin, kmax).withColumn("kmer", canonical(F.col("_spelled")))
    return found.groupBy(*others, "k", "kmer").agg(F.count("*").alias("cnt"))


def class_counts(sites: DataFrame, by: str, kmin: int, kmax: int) -> DataFrame:
    """(by, kmer, cnt): a task counts k-mers by number, whole batches at once, and gives one row for each class
    and spelling of a k-mer (for each run of HELD_CLASSES classes); the two spellings meet after that."""
    lengths = range(kmin, kmax + 1)
    words = {k: arrays.spellings(k) for k in lengths}
    kind = sites.schema[by].dataType

    def rows(held: dict, odd: Counter, shape: pa.DataType):
        found = [(name, words[k][i], int(own[k][i])) for name, own in held.items() for k in lengths for i in np.flatnonzero(own[k])]
        found += [(name, kmer, n) for (name, kmer), n in odd.items()]
        names, kmers, n = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(names, shape), pa.array(kmers, pa.string()), pa.array(n, pa.int64())], names=[by, "_spelled", "_n"])

    def run(batches):
        held: dict = {}
        odd: Counter = Counter()
        shape = None
        for batch in batches:
            shape = batch.schema.field(0).type
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            classes, own = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            text, offsets = arrays.flat(batch.column(1))
            for first, end in arrays.pieces(offsets):
                part, at = text[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
                local = np.unique(own[first:end])
                of = np.repeat(np.searchsorted(local, own[first:end]), np.diff(at))
                for k in lengths:
                    counts = np.bincount(of * (4**k + 1) + arrays.numbers(part, at, k), minlength=len(local) * (4**k + 1)).reshape(-1, 4**k + 1)[:, :-1]
                    for place, c in zip(local.tolist(), counts, strict=True):
                        held.setdefault(classes[place], {x: np.zeros(4**x, np.int64) for x in lengths})[k] += c
                strange = np.flatnonzero(arrays.DIGIT[part] > 3)
                for n in np.unique(np.searchsorted(at, strange, side="right") - 1).tolist():
                    seq = batch.column(1)[first + n].as_py()
                    spelled = (seq[i : i + k] for k in lengths for i in range(len(seq) - k + 1))
                    odd.update((classes[own[first + n]], w) for w in spelled if set(w) - set("ACGT"))
                if len(held) > HELD_CLASSES or len(odd) > 1000 * HELD_CLASSES:
                    yield rows(held, odd, shape)
                    held, odd = {}, Counter()
        if held or odd:
            yield rows(held, odd, shape)

    shape = StructType([StructField(by, kind), StructField("_spelled", StringType()), StructField("_n", LongType())])
    spelled = sites.select(by, "seq").mapInArrow(run, shape)
    return spelled.groupBy(by, canonical(F.col("_spelled")).alias("kmer")).agg(F.sum("_n").alias("cnt"))


def all_kmers(spark, kmin: int, kmax: int) -> DataFrame:
    """Every k-mer of the lengths, canonical or not."""
    from seqprism.functions.sequence import code_kmer

    parts = [spark.range(4**k).select(F.lit(k).alias("k"), F.col("id").alias("code"), code_kmer(F.col("id"), F.lit(k)).alias("kmer")) for k in range(kmin, kmax + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def feature_stats(counts: DataFrame, site_weights: DataFrame) -> DataFrame:
    """(kmer, mean, sd): weighted over all sites, absent k-mers being zeros.

    sd = sqrt(|sum(w x^2) - W mean^2| / (W - 1)), W the sum of all weights.
    """
    return weighted_stats(counts.join(site_weights, "site_id"), site_weights.agg(F.sum("weight")).first()[0] or 0.0)


def weighted_stats(counts: DataFrame, total: float) -> DataFrame:
    """feature_stats() of counts that have their site's weight; total: the sum of all sites' weights."""
    sums = counts.groupBy("kmer").agg(F.sum(F.col("weight") * F.col("cnt")).alias("s"), F.sum(F.col("weight") * F.col("cnt") * F.col("cnt")).alias("q"))
    mean = F.col("s") / total
    return sums.select("kmer", mean.alias("mean"), F.sqrt(F.abs(F.col("q") - total * mean * mean) / (total - 1)).alias("sd"))


def constant_features(counts: DataFrame, n_sites: int, kmin: int, kmax: int) -> DataFrame:
    """k-mers that every site has equally often: those of all sites, and those of none, among which are
    all that are not canonical. As many rows as there are k-mers, at most."""
    never = all_kmers(counts.sparkSession, kmin, kmax).select("kmer").join(F.broadcast(counts.select("kmer").distinct()), "kmer", "left_anti")
    return _everywhere(counts, n_sites).unionByName(never)


def _everywhere(counts: DataFrame, n_sites: int) -> DataFrame:
    spread = counts.groupBy("kmer").agg(F.count("*").alias("n"), F.min("cnt").alias("low"), F.max("cnt").alias("high"))
    return spread.where((F.col("n") == n_sites) & (F.col("low") == F.col("high"))).select("kmer")


def penetrance(counts: DataFrame, n_sites: int) -> DataFrame:
    """(kmer, n, share) of sites that have the k-mer."""
    return counts.groupBy("kmer").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / n_sites)


def standardized(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(site_id, kmer, z) of the present k-mers; constant ones are left out, absent ones are -mean/sd."""
    return counts.join(stats.where("sd > 0"), "kmer").select("site_id", "kmer", ((F.col("cnt") - F.col("mean")) / F.col("sd")).alias("z"))


def log_odds(class_kmers: DataFrame, by: str, features: int) -> DataFrame:
    """(model, kmer, weight): smoothed log ratio of a k-mer's share inside and outside each class."""
    totals = class_kmers.groupBy(by).agg(F.sum("cnt").alias("n_class"))
    overall = class_kmers.groupBy("kmer").agg(F.sum("cnt").alias("n_kmer"))
    everything = class_kmers.agg(F.sum("cnt")).first()[0] or 0
    # Classes times k-mers: the size of the model itself.
    grid = totals.withColumn("one", F.lit(1)).join(overall.withColumn("one", F.lit(1)), "one").join(class_kmers, [by, "kmer"], "left").fillna(0, ["cnt"])
    share = lambda n, total: F.log((n + 1.0) / (total + float(features)))
    inside = share(F.col("cnt"), F.col("n_class"))
    outside = share(F.col("n_kmer") - F.col("cnt"), F.lit(everything) - F.col("n_class"))
    return grid.select(F.col(by).alias("model"), "kmer", F.round(inside - outside, 6).alias("weight"))


def wide(counts: DataFrame, kmers: list[str]) -> DataFrame:
    """One column for each k-mer, zeros filled in: for text output of small sets."""
    return counts.groupBy("site_id").pivot("kmer", kmers).agg(F.sum("cnt")).fillna(0)


