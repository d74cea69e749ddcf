"""The cutoffs of the quality rules: the exact bound, the choice, and the guarantee by simulation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqprism.llm import risk_rules
from seqprism.llm.common import read

from .rows import DOCS


def test_tail_is_the_binomials(spark):
    tail = spark.range(1).select(risk_rules.binomial_log_tail(F.lit(3).cast("long"), F.lit(200).cast("long"), 0.05).alias("t")).first().t
    assert math.exp(tail) == pytest.approx(sum(math.comb(200, i) * 0.05**i * 0.95 ** (200 - i) for i in range(4)), rel=1e-9)


def frame(spark, rows):
    """(stratum, good, proposes, symbols) rows as calibrate() takes them; other statistics are 0."""
    s = F.struct(*[F.col("v").cast("long").alias(r) if r == "symbols" else F.lit(0).cast("long").alias(r) for r in risk_rules.CUTOFFS])
    return spark.createDataFrame(rows, "stratum string, good boolean, proposes boolean, v int").select("stratum", "good", "proposes", s.alias("s"))


def test_strictest_admissible_cutoff(spark):
    rows = [("en", i % 10 != 0, i % 3 == 0, 400 if i % 10 == 0 else i % 7) for i in range(2000)]
    best = risk_rules.calibrate(frame(spark, rows)).first().limits
    assert best.symbols == 10 and best.repeats is None  # 5 would reject a seventh of the good ones
    few = risk_rules.calibrate(frame(spark, rows[:60]))
    assert few.count() == 0  # too few documents to bound the risk


def test_the_guarantee_holds(spark):
    """120 strata of one kind: the true rate of false rejection of each choice is known."""
    draw, rows, rate = np.random.default_rng(3), [], 0.06
    for k in range(120):
        good = draw.random(500) < 0.8
        value = np.where(good, np.where(draw.random(500) < rate, 100, 1), np.where(draw.random(500) < 0.7, 100, 1))
        rows += [(f"s{k}", bool(g), i % 3 == 0, int(v)) for i, (g, v) in enumerate(zip(good, value, strict=True))]
    # Any cutoff below 100 rejects 6 % of the good documents, more than permitted: each choice is a failure.
    assert risk_rules.calibrate(frame(spark, rows)).count() <= 120 * risk_rules.LEVEL


@pytest.mark.parametrize("most", [risk_rules.BROADCAST_STRATA, 0])
def test_cutoffs_decide_on_the_tables(spark, most, monkeypatch):
    """Cutoffs reject documents that the base rules keep; with many strata they are joined, not broadcast."""
    monkeypatch.setattr(risk_rules, "BROADCAST_STRATA", most)
    docs, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = risk_rules.judge(docs, labels).cache()
    assert rows.where("NOT base_failed AND NOT kept").count() > 0
    good = rows.join(labels.where("quality = 1"), "doc_id").where("NOT base_failed")
    assert good.where("NOT kept").count() <= 0.05 * good.count()
    passed = risk_rules.keep_good(docs, labels)
    assert passed.columns == docs.columns and passed.select("doc_id").exceptAll(rows.where("kept").select("doc_id")).isEmpty() and passed.count() == rows.where("kept").count()


def test_nulls_repeats_and_clashing_names(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    clashing = docs.select("*", *[F.lit(1).alias(c) for c in ("s", "stratum", "limits", "kept_", "good", "key", "text_", "set", "budget")])
    assert risk_rules.judge(clashing, labels).count() == 15
    kept = risk_rules.keep_good(clashing, labels)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in risk_rules.judge(docs, labels).where("kept").collect()}
    long_text = spark.createDataFrame([(7, "a b " * 300_000, "en", "s", 1, "k", 7)], DOCS)
    assert risk_rules.judge(long_text, labels).first().n_words == 600_000
    assert risk_rules.keep_good(nothing, labels).count() == 0
