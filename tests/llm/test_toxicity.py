"""Toxicity by maximal segments: held-out rows, awkward rows, the extreme-value fit."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from seqprism.llm import segment_toxicity
from seqprism.llm.common import id_remainder, read

from .rows import words


def test_held_out_rows_of_the_tables_alone_and_joined(spark):
    """Recall and precision on held-out rows; as clean texts get longer, no more of them come out toxic."""
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = segment_toxicity.fit(docs, labels)
    held = docs.where(id_remainder("doc_id", 5) == 0).join(labels.where("toxic IS NOT NULL"), "doc_id").select("doc_id", "text", "toxic")
    both = segment_toxicity.score_documents(held, model).join(held, "doc_id").toPandas()
    hit = int(((both["predicted"] == 1) & (both["toxic"] == 1)).sum())
    assert hit >= 0.9 * (both["toxic"] == 1).sum() and hit >= 0.95 * (both["predicted"] == 1).sum()
    clean = both.loc[(both["toxic"] == 0) & (both["predicted"] == 0), "text"].tolist()
    draw = random.Random(1)
    joined = [(size * 1000 + i, " ".join(draw.choices(clean, k=size))) for size in (5, 20, 50, 200) for i in range(40)]
    got = segment_toxicity.score_documents(spark.createDataFrame(joined, "doc_id long, text string").repartition(8), model).toPandas()
    called = got.groupby(got["doc_id"] // 1000)["predicted"].sum()
    assert (called <= 2).all()


def test_toy_classes_and_awkward_rows(spark, nothing):
    rows = [(i, words(80, i) + (" foul nasty " if i % 5 == 0 else " ") + words(30, 1000 + i)) for i in range(400)]
    rows += [rows[7], rows[10], (900, None), (901, ""), (902, " \n"), (None, "foul nasty"), (903, words(200_000, 9)), (904, words(100_000, 8) + " foul nasty " + words(100_000, 7))]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(1).alias(c) for c in ("key", "mark", "fold", "score", "toxic", "token")])
    labels = spark.createDataFrame([*((i, 1, int(i % 5 == 0)) for i in range(400)), (3, 1, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = segment_toxicity.judge(df, labels).collect()
    got = {r.doc_id: r for r in rows}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(rows) == 408 and all(got[i].held_out for i in held) and np.mean([got[i].predicted == int(i % 5 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows) and got[900].score == got[901].score == got[902].score and got[900].predicted == 0
    assert got[None].predicted == 1 and not got[None].held_out and got[903].predicted == 0 and got[904].predicted == 1
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    model = segment_toxicity.fit(df, labels)
    found = segment_toxicity.toxic_passages(df.where("doc_id = 10"), model).collect()
    assert found and all("foul" in r.passage or "nasty" in r.passage for r in found)
    assert segment_toxicity.judge(nothing, labels).count() == 0
    alone = segment_toxicity.judge(df, labels.where("toxic = 0"))
    assert alone.where("predicted = 1").isEmpty()


def test_logistic_weights_stand_for_rows():
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=300), draw.random(300) < 0.3
    twice = segment_toxicity.logistic(np.append(x, x[~y]), np.append(y, y[~y]), np.ones(300 + int((~y).sum())))
    assert np.allclose(twice, segment_toxicity.logistic(x, y, np.where(y, 1.0, 2.0)), atol=2e-3)
