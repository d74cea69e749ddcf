"""Training: the optimum against a plain solver, memory of the driver, the outer stopping rules."""

import random
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa

from seqprism.config import AnalysisConfig
from seqprism.operators import train

FEATURES = ["AAAA", "AAAC", "AACC", "ACGT", "CACA"]
LEAVES = ["a", "b", "c"]
#: Effects of the features on the classes that the rows are drawn by.
EFFECTS = np.array([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0], [0.5, -0.5, 0], [0, 0, 0]])


def rows(n, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.poisson(1.5, size=(n, len(FEATURES)))
    logit = x @ EFFECTS
    p = np.exp(logit - logit.max(axis=1, keepdims=True))
    y = np.array([draw.choice(3, p=q / q.sum()) for q in p])
    return x, y


def frames(spark, x, y):
    counts = [(i, f, int(c)) for i, row in enumerate(x) for f, c in zip(FEATURES, row, strict=True) if c]
    sites = [(i, LEAVES[k]) for i, k in enumerate(y)]
    return spark.createDataFrame(counts, "site_id long, kmer string, cnt int"), spark.createDataFrame(sites, "site_id long, leaf string")


def fitted(spark, x, y, blocks, config, parents=None):
    counts, sites = frames(spark, x, y)
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    data = train.make_blocks(counts, sites, FEATURES, LEAVES, dict.fromkeys(LEAVES, 1.0), blocks)
    return train.fit(data, blocks, FEATURES, LEAVES, parents or {}, mean, sd, np.bincount(y, minlength=3).astype(float), config)


def plain_optimum(x, y, strength, rounds=6000):
    """Least weighted loss plus 2 * strength * sum |coefficients|, by proximal steps; intercepts are free."""
    f = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    hot = np.eye(3)[y]
    w, b, size = np.zeros((f.shape[1], 3)), np.zeros(3), 1 / (len(f) * 4)

    def loss():
        logit = f @ w + b
        top = logit.max(axis=1, keepdims=True)
        return float((np.log(np.exp(logit - top).sum(axis=1)) + top[:, 0] - (logit * hot).sum(axis=1)).sum()) + 2 * strength * np.abs(w).sum()

    for _ in range(rounds):
        logit = f @ w + b
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        gap = p / p.sum(axis=1, keepdims=True) - hot
        w, b = w - size * f.T @ gap, b - size * gap.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - size * 2 * strength, 0)
    return loss()


def test_blocks_agree_on_the_optimum(spark):
    x, y = rows(600)
    model = fitted(spark, x, y, 4, AnalysisConfig(regularization=2.0, admm_rounds=60, tolerance=1e-3))
    best = plain_optimum(x, y, 2.0)
    assert best * 0.999 <= model.objective[-1] <= best * 1.01
    # The feature of each class has its greatest coefficient there.
    assert [int(model.coefficients[1 + i].argmax()) for i in range(3)] == [0, 1, 2]


def test_a_block_may_have_no_rows(spark):
    x, y = rows(12, seed=2)
    model = fitted(spark, x, y, 30, AnalysisConfig(admm_rounds=3, outer_rounds=1))
    assert np.isfinite(model.coefficients).all() and np.isfinite(model.objective).all()


def test_memory_of_the_driver_does_not_grow_with_blocks(spark):
    """Many features, so that a block's coefficients would show: 400 kB for each block."""
    draw = random.Random(4)
    features = [f"f{i}" for i in range(4000)]
    counts = spark.createDataFrame([(i, draw.choice(features), 1) for i in range(300) for _ in range(5)], "site_id long, kmer string, cnt int")
    sites = spark.createDataFrame([(i, LEAVES[i % 3]) for i in range(300)], "site_id long, leaf string")
    peaks = []
    for blocks in (4, 64):
        data = train.make_blocks(counts, sites, features, LEAVES, dict.fromkeys(LEAVES, 1.0), blocks)
        tracemalloc.start()
        train.fit(data, blocks, features, LEAVES, {"a": ["x"], "b": ["x", "y"], "c": ["y"]}, np.zeros(4000), np.ones(4000), np.full(3, 100.0), AnalysisConfig(admm_rounds=2, outer_rounds=1))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 2_000_000


def test_outer_rounds_end_by_either_rule():
    near, far = ([0.001, 0.002], [1.0, 1.0]), ([0.5, 1.9], [1.0, 1.0])
    assert train.converged(0, *near, budget=15, tolerance=0.01)
    # Only beyond half the budget does a move within twice the norm end the rounds.
    assert [train.converged(n, *far, budget=15, tolerance=0.01) for n in (0, 7, 8, 14)] == [False, False, True, True]
    assert not train.converged(14, [0.5, 2.0], [1.0, 1.0], budget=15, tolerance=0.01)
    assert train.converged(0, [0.0, 0.001], [0.0, 1.0], budget=15, tolerance=0.01)


def test_a_run_that_only_the_relaxed_rule_ends(spark, monkeypatch):
    """With a tolerance that nothing meets, all outer rounds but the last few would be spent."""
    x, y = rows(200, seed=3)
    config = replace(AnalysisConfig(), tolerance=1e-12, outer_rounds=6, admm_rounds=4, regularization=1.0)
    model = fitted(spark, x, y, 2, config, {"a": ["x"], "b": ["x", "y"], "c": ["y"]})
    assert len(model.objective) == 5  # the first round beyond half of six


def test_cross_validation_scores_every_site_by_the_other_folds(spark):
    draw = random.Random(5)
    site = lambda word: "".join(draw.choices("ACGT", k=30)) + word * 3 + "".join(draw.choices("ACGT", k=30))
    data = [(i, ("A", "B")[i % 2], site(("TGACTCA", "CACGTGC")[i % 2])) for i in range(90)]
    df = spark.createDataFrame(data, "site_id long, annotation string, seq string")
    config = replace(AnalysisConfig(), kmin=4, kmax=4, admm_rounds=10, outer_rounds=1, regularization=0.5, blocks=2)
    got = train.cross_validate(df, config).toPandas()
    assert len(got) == 90 * 2 and got.groupby("site_id")["prob"].sum().round(6).eq(1).all()
    best = got.loc[got.groupby("site_id")["prob"].idxmax()]
    assert (best["model"].str.endswith(("A", "B"))).all() and (best["model"].str[-1] == best["annotation"]).mean() > 0.9


def test_dense_blocks_have_the_loss_of_sparse_ones(spark):
    """Before, there were sparse rows only, made of a row for each site and k-mer."""
    from seqprism.operators import kmers
    from seqprism.operators.cluster import canonical_kmers

    draw = random.Random(6)
    data = [(i, LEAVES[i % 3], "".join(draw.choices("ACGT", k=draw.choice([3, 40])))) for i in range(60)] + [(99, "a", "A" * 400)]
    marked = spark.createDataFrame(data, "site_id long, leaf string, seq string")
    names, weights = canonical_kmers(3, 4), {"a": 1.0, "b": 2.0, "c": 0.5}
    counts = kmers.site_counts(marked.drop("leaf"), 3, 4).select("site_id", "kmer", "cnt")
    sparse = {r.block: train._rows(r) for r in train.make_blocks(counts, marked.drop("seq"), names, LEAVES, weights, 3).collect()}
    dense = {r.block: train._rows(r) for r in train.dense_blocks(marked, names, LEAVES, weights, 3, 4, 3).collect()}
    x, sd = np.random.default_rng(7).normal(size=(len(names) + 1, 3)), np.linspace(0.5, 2, len(names))
    assert set(sparse) == set(dense)
    for block, own in dense.items():
        assert isinstance(own, train.DenseRows)
        (value, gradient), (wanted, slope) = own.loss(x, sd / 3, sd), sparse[block].loss(x, sd / 3, sd)
        assert np.isclose(value, wanted) and np.allclose(gradient, slope)


def test_dense_rows_reach_the_optimum_in_few_passes(spark, monkeypatch):
    """Before, each block of a dense fit was solved anew in every round, a hundred passes over its rows each."""
    draw = random.Random(8)
    words = {"A": "TGACTCA", "B": "CACGTGC", "C": "GGGCGGG"}
    site = lambda word: "".join(draw.choices("ACGT", k=20)) + word * draw.choice([0, 1]) + "".join(draw.choices("ACGT", k=20))
    data = [(i, "ABC"[i % 3], site(words["ABC"[i % 3]])) for i in range(300)]
    df = spark.createDataFrame(data, "site_id long, annotation string, seq string")
    passes, real = [], train.Blocks.sum_of
    monkeypatch.setattr(train.Blocks, "sum_of", lambda self, of: passes.append(1) or real(self, of))
    config = replace(AnalysisConfig(), kmin=3, kmax=3, regularization=2.0, tolerance=1e-3, blocks=3)
    model = train.train(df, config)
    columns = train.columns_of(model.features, 3, 3)
    x = train.count_matrix(pa.array([r[2] for r in data]), columns, len(model.features))
    best = plain_optimum(x, np.array([i % 3 for i in range(300)]), 2.0)
    assert best * 0.9999 <= model.objective[-1] <= best * 1.001
    assert len(passes) < 60


def test_dense_leaves_and_labels_alternate_as_sparse_ones(spark):
    """The aim of the dense fit is the one of the consensus fit, which only nears it by its tolerance."""
    draw = random.Random(9)
    data = [(i, LEAVES[i % 3], "".join(draw.choices("ACGT", weights=[4 + i % 3, 3, 2, 3], k=60))) for i in range(240)]
    marked = spark.createDataFrame(data, "site_id long, leaf string, seq string")
    columns = train.columns_of(FEATURES, 4, 4)
    x = train.count_matrix(pa.array([r[2] for r in data]), columns, len(FEATURES))
    args = (FEATURES, LEAVES, {"a": ["x"], "b": ["x", "y"]}, x.mean(axis=0), x.std(axis=0, ddof=1), np.full(3, 80.0))
    config = replace(AnalysisConfig(), regularization=0.5, tolerance=1e-3, outer_rounds=2)
    blocks = train.dense_blocks(marked, FEATURES, LEAVES, dict.fromkeys(LEAVES, 1.0), 4, 4, 3)
    dense, consensus = train.fit_dense(blocks, 3, *args, config), train.fit(blocks, 3, *args, config)
    assert np.isclose(dense.objective, consensus.objective, rtol=2e-3).all()


def test_the_penalty_is_least_at_or_beside_a_knot():
    pairs, strength, rho = [(0, 0), (0, 1), (1, 1), (2, -1)], 3.0, 2.0
    labels_at = np.array([[0.5, -1.0], [2.0, 2.0], [0.0, 3.0]])
    penalty = train.Penalty.of(strength, labels_at, pairs, 3)
    at = np.random.default_rng(1).normal(size=(3, 3)) * 3
    found = penalty.nearest(at, rho)
    aim = lambda x: penalty.value(x) + rho / 2 * ((x - at) ** 2).sum()
    assert np.isclose(penalty.value(at), strength * sum(np.abs(at[:, i] - (labels_at[:, p] if p >= 0 else 0)).sum() for i, p in pairs))
    for step in np.eye(9).reshape(9, 3, 3):
        assert aim(found) <= min(aim(found + 1e-4 * step), aim(found - 1e-4 * step))
