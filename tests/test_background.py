"""Random regions as a class, and the options that make training sites."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from seqprism.config import AnalysisConfig
from seqprism.operators import background, intervals, labels, motifs
from seqprism.sources.readers import cut_genome

PLACED = "site_id long, chrom string, start long, end long, annotation string, seq string"
CONFIG = AnalysisConfig(window=20, min_subclass=3, random_regions=True, screen_repeats=True)


@pytest.fixture(scope="module")
def genome(spark):
    draw = random.Random(8)
    seqs = {"a": "".join(draw.choice("ACGT") for _ in range(1500)), "n": "ACGTN" * 200, "r": "".join(draw.choice("acgt") for _ in range(600)), "s": "ACG"}
    rows = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    return seqs, rows.select("chrom", F.length("seq").cast("long").alias("length")), cut_genome(rows, 64)


def _sites(spark, seqs):
    rows = [(i, "a", 40 * i, 40 * i + 19, ("x", "x;y", "z;y")[i % 3], seqs["a"][40 * i : 40 * i + 20]) for i in range(13)]
    return spark.createDataFrame([*rows, (20, "r", 0, 19, "x", "A" * 20), (21, "a", 700, 719, "rare", "C" * 20)], PLACED)


def test_random_regions_are_screened_and_as_many_as_the_smallest_class(spark, genome):
    seqs, lengths, chunks = genome
    # Repeats cover r from 0 to 499: a window that begins at 489 is covered by 11 of 20, one at 490 by half.
    repeats = spark.createDataFrame([("r", 0, 299), ("r", 300, 499)], "chrom string, start long, end long")
    found = background.training_sites(_sites(spark, seqs), CONFIG, lengths, chunks, repeats, 64).collect()
    names = [r.annotation for r in found]
    # The class x is named like a label; its site in the repeats went, as did the rare class.
    assert {a: names.count(a) for a in set(names)} == {"xOnly;x": 5, "x;y": 4, "z;y": 4, "Random": 4}
    drawn = [r for r in found if r.annotation == "Random"]
    assert len({r.site_id for r in found}) == len(found) and all(r.site_id < 0 for r in drawn)
    for r in drawn:
        assert r.seq == seqs[r.chrom][r.start : r.end + 1].upper() and len(r.seq) == 20 and "N" not in r.seq
        assert r.chrom != "r" or r.start >= 490
        assert not any(o.chrom == r.chrom and o.start <= r.end and r.start <= o.end for o in found if o is not r)


def test_what_stays_is_what_a_plain_loop_accepts(spark, genome):
    seqs, lengths, chunks = genome
    taken = spark.createDataFrame([("a", 0, 1200)], "chrom string, start long, end long")
    none = spark.createDataFrame([], "chrom string, start long, end long")
    found = intervals.random_regions(lengths, taken, 100, 20, 5, screen=background.screen(none, chunks, 0.5, 64)).collect()
    assert found and all((r.chrom == "a" and r.start > 1200) or r.chrom == "r" for r in found)
    spots = sorted((r.chrom, r.start) for r in found)
    assert all(a[0] != b[0] or b[1] - a[1] >= 20 for a, b in zip(spots, spots[1:], strict=False))
    few = intervals.random_regions(lengths, taken, 3, 20, 5, screen=background.screen(none, chunks, 0.5, 64)).collect()
    assert few == found[:3]


def test_options(spark, genome):
    seqs, lengths, chunks = genome
    sites = _sites(spark, seqs)
    plain = replace(CONFIG, random_regions=False, screen_repeats=False)
    assert background.training_sites(sites, plain).count() == 14
    merged = background.training_sites(sites.withColumn("annotation", F.replace("annotation", F.lit("rare"), F.lit("z;x"))), replace(plain, merge_low=True))
    assert merged.count() == 15 and {r.annotation for r in merged.select("annotation").where("site_id = 21").collect()} <= {"xOnly;x", "x;y", "z;y"}
    for needed in (replace(plain, screen_repeats=True), replace(plain, random_regions=True)):
        with pytest.raises(ValueError, match="needs"):
            background.training_sites(sites, needed)
    assert background.training_sites(sites.limit(0), replace(plain, random_regions=True), lengths, chunks).count() == 0


def test_names_are_carried_back_and_are_one_to_one(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x;y"), (3, "y;z"), (4, "xOnly;x"), (5, "x"), (6, "w"), (7, None)], "site_id long, annotation string")
    names = {r.annotation: r.name for r in labels.class_names(rows).collect()}
    assert names == {"x": "xOnlyOnly#x", "x;y": "x#y", "y;z": "y#z", "xOnly;x": "xOnly#x", "w": "w", None: None}
    again = labels.renamed(rows)
    assert {r.site_id: r.annotation for r in again.collect()} == {1: "xOnlyOnly;x", 2: "x;y", 3: "y;z", 4: "xOnly;x", 5: "xOnlyOnly;x", 6: "w", 7: None}
    assert labels.renamed(again).collect().sort() == again.collect().sort()
    support = {r.name: r.n for r in labels.node_support(rows).collect()}
    assert support["xOnlyOnly#x"] == 2 and support["x"] == 4 and support["y"] == 2
    member = labels.membership(again, labels.hierarchy(again).select(F.col("name").alias("model")))
    assert {r.site_id for r in member.where("model = 'xOnlyOnly#x'").collect()} == {1, 5}


def test_random_regions_have_no_motifs(spark):
    rows = spark.createDataFrame([("Random", 1), ("x", 2), (None, 3)], "model string, site_id long")
    assert {r.site_id for r in labels.without_background(rows).collect()} == {2, 3}
    draw = random.Random(2)
    seqs = [(i, "".join(draw.choice("ACGT") for _ in range(12)) + "TGACTCA" + "".join(draw.choice("ACGT") for _ in range(12))) for i in range(25)]
    hills = spark.createDataFrame([(m, 0, i, 12, 7, 1.0) for m in ("Random", "x") for i, _ in seqs], "model string, cluster int, site_id long, start int, len int, score double")
    config = AnalysisConfig(motif_min_width=7, motif_max_width=7, motifs_per_cluster=1)
    found = motifs.cluster_motifs(hills, spark.createDataFrame(seqs, "site_id long, seq string"), config)
    assert {r.model for r in found.collect()} == {"x"}
