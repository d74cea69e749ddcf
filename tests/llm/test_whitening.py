"""Whitening against exact integers and a plain covariance; awkward rows."""

import numpy as np
import pytest

from seqprism.llm import whitening
from seqprism.llm.queries import QUERIES

COLUMNS = "vec_id long, embedding array<float>"


def plain(vectors, components=32):
    """Whitened rows, shares and exact deviations of equally long vectors."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    y = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return y @ axes / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(y.T @ y / n), deviations


def test_whole_table_against_a_plain_covariance(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    want, shares, deviations = plain([r.embedding for r in rows])
    got = QUERIES["op11_two_pass_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == len(rows) * 32 and got["vec_id"].tolist() == [r.vec_id for r in rows for _ in range(32)]
    own = got["whitened"].to_numpy().reshape(-1, 32)
    signs = np.sign((own * want).sum(axis=0))
    assert np.allclose(own * signs, want, atol=1e-8)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 32), shares, rtol=1e-9)
    assert got["deviation"].to_numpy().reshape(-1, 32)[:, 0].tolist() == deviations
    assert set(got["n"]) == {len(rows)} and 0 <= got["identity_error"].max() < 1e-6 and got["identity_error"].nunique() == 1


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(1)
    own = [[float(c) for c in v] for v in draw.normal(size=(40, 3))]
    rows = [*enumerate(own), (3, own[3]), (None, own[5]), (50, None), (51, [1.0, None, 2.0]), (52, [nan, 1.0, 1.0]), (53, [1.0, -inf, 1.0]), (54, []), (55, [0.0, 0.0, 0.0]), (60, [2.0, 2.0]), (61, [3.0, 3.0]), (62, [7.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS key", "2 AS size", "3 AS whitened", "4 AS vector", "5 AS n", "6 AS component")
    got = whitening.whitening_digests(df).toPandas()
    three = got[got["vec_id"].isna() | (got["vec_id"] < 60)]
    used = [v for i, v in rows if v is not None and len(v) == 3 and (i is None or i < 50 or i == 55)]
    assert len(three) == 3 * 43 and set(three["n"]) == {43} and len(used) == 43
    want, shares, deviations = plain(used)
    first = three[three["component"] == 1]
    assert sorted(first["deviation"].tolist()) == sorted(deviations)
    assert np.allclose(np.sort(np.abs(first["whitened"].to_numpy())), np.sort(np.abs(want[:, 0])))
    assert sorted(first["explained"].unique()) == pytest.approx([shares[0]])
    # Two vectors on a line have one component; a lone vector has none that is real.
    line = got[got["vec_id"].isin([60, 61])].sort_values(["component", "vec_id"])
    assert np.abs(line["whitened"].tolist()[:2]) == pytest.approx([1, 1]) and line["whitened"].isna().tolist() == [False, False, True, True]
    assert line["identity_error"].max() < 1e-9
    alone = got[got["vec_id"] == 62]
    assert len(alone) == 1 and alone["whitened"].isna().all() and alone["deviation"].tolist() == [0] and alone["explained"].isna().all()
    assert whitening.whitening_digests(df.where("false")).count() == 0


def test_sums_and_deviations_are_exact_beyond_double(spark):
    big = 2.0**40
    rows = [(i, [big + i, -big * i, 1e300]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fits = whitening.fit(df)
    x = [[int(min(max(64 * c, -whitening.MOST), whitening.MOST)) + whitening.SHIFT for c in v] for _, v in rows]
    assert fits[3].sums == [sum(c) for c in zip(*x, strict=True)]
    got = {r.vec_id: r.deviation for r in whitening.transform(df, fits).collect()}
    for (i, _), row in zip(rows, x, strict=True):
        want = sum((7 * a - s) ** 2 for a, s in zip(row, fits[3].sums, strict=True))
        assert got[i] == (want if want < 1 << 63 else None)


def test_trees_of_many_partitions_give_the_same(spark):
    draw = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(draw.normal(size=(300, 8)))], COLUMNS)
    one, many = whitening.fit(df.coalesce(1)), whitening.fit(df.repartition(40))
    assert one[8].sums == many[8].sums and np.allclose(one[8].projection, many[8].projection)
    assert max(whitening.identity_errors(df.repartition(40), many).values()) < 1e-9
