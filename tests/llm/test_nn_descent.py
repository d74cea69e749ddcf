"""Nearest rows by NN-descent: recall against brute force, exact results on small and awkward tables."""

import numpy as np
import pytest

from seqprism.llm import nn_descent
from seqprism.llm.nn_descent import Settings

FEW = Settings(rounds=1, searches=2)


def brute(rows, top=20, every=20):
    """(query_id, rank, vec_id, score) over rows (key, vector) that are sound and distinct."""
    own = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in {i for i, _ in own if i % every == 0}:
        scores = {}
        for _, asked in [r for r in own if r[0] == q]:
            for i, v in own:
                if i != q and len(v) == len(asked):
                    scores[i] = max(scores.get(i, -np.inf), sum((a * b for a, b in zip(asked, v, strict=True)), 0.0))
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top]
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(best)]
    return sorted(out)


def answer(df, **how):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nn_descent.nearest_rows(df, **how).collect())


def test_recall_where_the_graph_is_sparse(spark):
    """6,000 vectors of unequal norms in loose clusters; lists, blocks and beams are a small part of them."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(40, 24))[draw.integers(0, 40, 6000)] + 0.7 * draw.normal(size=(6000, 24))
    x *= draw.uniform(0.7, 1.3, size=(6000, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    sparse = Settings(degree=24, back=16, block=128, start=16, bits=8, beam=80, expand=25, verified=40)
    got = {}
    for r in nn_descent.nearest_rows(df, settings=sparse).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 6000, 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and all(abs(scores[i] - s) < 1e-9 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_copies_ties_and_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(draw.integers(-2, 3, size=(120, 3)))]
    rows += [(i, [1.0, 1.0, 2.0]) for i in range(200, 300)] + [rows[0], rows[20], (200, [1.0, 1.0, 2.0]), (20, [9.0, 0.0, 0.0]), (40, None), (60, [nan, 1.0, 1.0]), (80, [1.0, None, 1.0]), (400, [inf, 0.0, 0.0]), (420, []), (440, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (460, [1.0, 2.0]), (461, [-1.0, 0.5]), (480, [5.0]), (500, [-0.0, 1.0, 0.0]), (501, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", *[f"1 AS `{c}`" for c in ("key", "class", "v", "node", "score", "rank", "query_id", "bucket", "n")])
    got, want = answer(df, settings=FEW), brute(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert answer(df.where("false")) == [] and answer(df.where("vec_id = 480")) == []


def test_query_on_a_table_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    from seqprism.llm.queries import QUERIES

    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in QUERIES["op13_nn_descent_search"](spark, "/root/testdata/sf0.001").collect())
    want = brute(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
