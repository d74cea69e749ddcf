"""Readers of the text formats of the method; every schema is explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprism.session import prepare

from .records import RecordSource

#: Letters of a piece of a genome.
CHUNK = 1 << 16


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.split("value", "\t").alias("f"))


def labelled_loci(spark: SparkSession, path: str, window: int | None = None) -> DataFrame:
    """(site, chrom, start, end, annotation) from `chr:pos<TAB>a;b` or `chr:start-end<TAB>a;b`.

    With a window, regions are that many places around the middle, ends inclusive.
    """
    rows = _fields(spark, path).where(F.col("f")[0].contains(":") | F.col("f")[0].contains("-"))
    place = F.regexp_extract_all(F.col("f")[0], F.lit(r"\d+"), F.lit(0))
    spot = F.split(F.regexp_extract(F.col("f")[0], ":(.*)$", 1), "-")
    start, end = spot[0].cast("long"), F.coalesce(F.get(spot, F.lit(1)), spot[0]).cast("long")
    base = rows.select(F.col("f")[0].alias("site"), F.regexp_extract(F.col("f")[0], "^([^:]+):", 1).alias("chrom"), start.alias("start"), end.alias("end"), F.get("f", F.lit(1)).alias("annotation")).where(F.size(place) > 0)
    if window is None:
        return base
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    return base.withColumns({"start": F.greatest(middle - window // 2, F.lit(0)), "end": F.greatest(middle - window // 2, F.lit(0)) + window - 1})


def records(spark: SparkSession, path: str, start: str = "", **options) -> DataFrame:
    """(id, file, offset, value) of the records of text files; see RecordSource."""
    prepare(spark).dataSource.register(RecordSource)
    return spark.read.format(RecordSource.name()).options(path=path, start=start, **options).load()


def labelled_sequences(spark: SparkSession, path: str, **options) -> DataFrame:
    """(site_id, seq, annotation) from `ACGT...<TAB>a;b`, upper-cased; ids from file and offset."""
    f = F.split(F.regexp_replace("value", r"\r?\n$", ""), "\t")
    rows = records(spark, path, **options).where(~F.col("value").startswith("#") & F.col("value").rlike(r"\S"))
    return rows.select(F.col("id").alias("site_id"), F.upper(f[0]).alias("seq"), F.get(f, F.lit(1)).alias("annotation"))


def fasta(spark: SparkSession, path: str, **options) -> DataFrame:
    """(site_id, name, seq); a record begins with `>` at the beginning of a line and may go over many lines."""
    head = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(head) + 1, F.length("value"))
    return records(spark, path, ">", **options).select(F.col("id").alias("site_id"), F.trim(F.regexp_replace(head, r"^>|\r$", "")).alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"))


def genome_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, **options) -> DataFrame:
    """(chrom, chunk, part) of a FASTA genome for region_sequences(): the letters of each record in pieces
    as they are read. chrom is the first word of its line."""
    found = records(spark, path, ">", chunk=str(chunk), **options)
    return found.select(F.regexp_extract("head", r"^>\s*(\S+)", 1).alias("chrom"), "chunk", "part")


def genome_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("length"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end) from `chr:start-end` lines: hills or repeats."""
    value = F.col("f")[0]
    return _fields(spark, path).select(F.regexp_extract(value, "^([^:]+):", 1).alias("chrom"), F.regexp_extract(value, r":(\d+)-", 1).try_cast("long").alias("start"), F.regexp_extract(value, r"-(\d+)$", 1).try_cast("long").alias("end")).where("start IS NOT NULL AND end IS NOT NULL")


def weight_matrix(spark: SparkSession, path: str, name: str = "kmer", value: str = "weight") -> DataFrame:
    """(model, kmer, weight) from a table with one column per model; the header may begin with `#`."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    first, *models = wide.columns
    long = wide.withColumnRenamed(first, name).unpivot([name], models, "model", value)
    return long.select("model", name, F.col(value).cast("double").alias(value))


def count_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, class, kmer, cnt) of a wide table of counts whose last column is the class; `?` is null."""
    wide = spark.read.option("sep", "\t").option("header", True).option("nullValue", "?").csv(path)
    first, *kmers, last = wide.columns
    return wide.unpivot([first, last], kmers, "kmer", "cnt").select(F.col(first).cast("long").alias("site_id"), F.col(last).alias("class"), "kmer", F.col("cnt").cast("double").alias("cnt"))


def coefficients(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(weights, intercepts) of a table whose intercept row is known by its name, wherever it stands."""
    rows = weight_matrix(spark, path, "feature", "value")
    is_intercept = F.col("feature").isin("(Intercept)", "Intercept", "intercept")
    return rows.where(~is_intercept).select("model", F.col("feature").alias("kmer"), F.col("value").alias("weight")), rows.where(is_intercept).select("model", F.col("value").alias("intercept"))


def score_matrix(spark: SparkSession, path: str) -> DataFrame:
    return weight_matrix(spark, path, "motif", "score")


def design(spark: SparkSession, path: str) -> DataFrame:
    """Class structure: six tab columns, comma lists, `-` for none."""
    rows = _fields(spark, path).where(F.col("f")[0] != "Index")
    ints = lambda c: F.when(c == "-", F.array().cast("array<int>")).otherwise(F.split(c, ",").cast("array<int>"))
    f = F.col("f")
    return rows.select(f[0].cast("int").alias("node_idx"), f[1].alias("name"), (f[2] == "1").alias("is_leaf"), ints(f[3]).alias("parents"), ints(f[4]).alias("children"), f[5].cast("int").alias("layer"))


def motifs(spark: SparkSession, path: str, **options) -> DataFrame:
    """(motif, pos, a, c, g, t) from TRANSFAC records: `DE name`, numbered rows up to a line `XX`."""
    found = records(spark, path, r"DE\s", **options)
    every = F.split("value", r"\r?\n")
    last = F.array_position(F.transform(every, lambda x: F.trim(x)), "XX")
    body = F.filter(F.when(last > 0, F.slice(every, F.lit(1), last.cast("int") - 1)).otherwise(every), lambda x: x.rlike(r"^\s*\d+\s"))
    rows = found.select(F.regexp_extract("value", r"^DE\s+(\S+)", 1).alias("motif"), F.explode(F.transform(body, lambda x: F.split(F.trim(x), r"\s+"))).alias("f"))
    return rows.select("motif", F.col("f")[0].cast("int").alias("pos"), *[F.col("f")[i + 1].cast("double").alias(b) for i, b in enumerate("acgt")])


def markov(spark: SparkSession, path: str) -> DataFrame:
    """(context, base, p) from `kmer<TAB>p` lines: the last letter given those before."""
    k = F.col("f")[0]
    return _fields(spark, path).select(F.substring(k, F.lit(1), F.length(k) - 1).alias("context"), F.right(k, F.lit(1)).alias("base"), F.col("f")[1].cast("double").alias("p"))


def cut_genome(genome: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk, part) of genome (chrom, seq): one pass over each sequence, in time linear in its
    length (a substring would count its way from the beginning for each chunk)."""
    parts = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    return genome.select("chrom", F.posexplode(parts).alias("chunk", "part")).withColumn("chunk", F.col("chunk").cast("long"))


def region_sequences(places: DataFrame, genome: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """places (chrom, start, end) with seq, ends inclusive, as far as their chromosome goes; places on none
    or outside of it are left out, places of the same region have one row each. genome: chunks of that
    length from genome_chunks() or cut_genome(), joined by chunk, so no task holds a whole chromosome."""
    spots = places.select("chrom", "start", "end").distinct()
    wanted = spots.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor(F.col("end") / chunk))))
    low = F.greatest(F.col("start") - F.col("chunk") * chunk, F.lit(0))
    high = F.least(F.col("end") - F.col("chunk") * chunk, F.lit(chunk - 1))
    cut = wanted.join(genome, ["chrom", "chunk"]).withColumn("_piece", F.substring("part", (low + 1).cast("int"), (high - low + 1).cast("int")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "_piece"))), lambda x: x["_piece"]), "")
    return places.join(cut.groupBy("chrom", "start", "end").agg(joined.alias("seq")).where("seq <> ''"), ["chrom", "start", "end"]).select(*places.columns, "seq")
