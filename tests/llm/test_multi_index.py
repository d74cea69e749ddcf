"""Near vectors by the product grid: recall against brute force with many cells, and lengths apart."""

import numpy as np

from seqprism.llm import multi_index


def links_of(x):
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def test_recall_with_many_codewords_and_few_visits(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "PER_CELL", 10)
    seen, whole = [], multi_index.fit
    monkeypatch.setattr(multi_index, "fit", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    draw = np.random.default_rng(5)
    middles = draw.normal(size=(150, 32))
    x = middles[draw.integers(0, 150, 3500)] + 0.8 * draw.normal(size=(3500, 32))
    other = draw.normal(size=(1000, 32))
    # Pairs just above the threshold, in every direction.
    own = x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True)
    other -= (other * own).sum(axis=1, keepdims=True) * own
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x = np.concatenate([x, 0.951 * own + np.sqrt(1 - 0.951**2) * other])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in multi_index.near_vectors(df).collect()}
    want = links_of(x).sum(axis=1)
    index = seen[0]
    assert len(index.first) >= 16 and index.visits < len(index.first) * len(index.second) / 4
    assert want.sum() >= 2000 and all(got[i] <= want[i] for i in range(len(x)))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_lengths_nulls_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [3.0, 0.0, 0.1]), (4, [1.0]), (5, [2.0]), (6, None), (None, [1.0, 0.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "2 AS n", "3 AS dims", "4 AS component")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in multi_index.near_vectors(df).collect()), key=str)
    assert got == sorted([(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False), (2, 1, 2, True), (3, 1, 2, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (None, 0, None, True)], key=str)


def test_codewords_grow_with_the_root():
    assert [multi_index.codewords(64 * n * n) for n in (1, 16, 256, 4096)] == [2, 16, 256, 4096]
