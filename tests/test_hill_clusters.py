"""Clusters take all hills of a model, whatever their rank."""

import random
from dataclasses import replace

import numpy as np

from seqprism.config import AnalysisConfig
from seqprism.operators import cluster

CONFIG = replace(AnalysisConfig(), k_values=(2, 3), bootstraps=3, stratum_rows=60, min_model_hills=100)


def hill_rows(spark):
    draw = random.Random(2)
    rows = [("a", i, 0, 12, "".join(draw.choices("AT", k=12)), 9.0 - i / 1000) for i in range(800)]
    rows += [("a", 1000 + i, 0, 12, "".join(draw.choices("CG", k=12)), 1.0) for i in range(300)]
    rows += [("b", i, 0, 12, "".join(draw.choices("ACGT", k=12)), 1.0) for i in range(100)]
    return rows, spark.createDataFrame(rows, "model string, site_id long, start int, len int, seq string, score double").repartition(5)


def test_profiles_against_plain_counts():
    other = str.maketrans("ACGT", "TGCA")
    seqs = ["ACGTTGCAAC", "ACG", "TTTTTTT", "ACGTNACGT"]
    names = cluster.canonical_kmers(3, 4)
    assert len(names) == 32 + 136
    got = cluster.profile_matrix(seqs, names, 3, 4)
    for s, row in zip(seqs, got, strict=True):
        words = [s[i : i + k] for k in (3, 4) for i in range(len(s) - k + 1)]
        words = [min(w, w.translate(other)[::-1]) for w in words if "N" not in w]
        assert row.tolist() == [words.count(n) for n in names]


def test_every_hill_of_a_model_is_clustered(spark):
    rows, df = hill_rows(spark)
    quality, assigned = cluster.cluster_hills(df, CONFIG)
    tried = quality.collect()
    assert len(tried) == 2 * 3 and {r.model for r in tried} == {"a"} and {r.k for r in tried if r.chosen} == {2}
    found = {r.site_id: r.cluster for r in assigned.collect()}
    # The second kind has only ranks beyond the best 750; all 1,100 hills have a cluster, by kind.
    assert set(found) == {r[1] for r in rows if r[0] == "a"}
    assert len({found[i] for i in range(800)}) == 1 and {found[1000 + i] for i in range(300)} == {1 - found[0]}


def test_quality_alone_makes_no_clusters_of_all_hills(spark, monkeypatch):
    """Before, each query on quality put every hill into a cluster as well, and profiled it twice."""
    rows, df = hill_rows(spark)
    want = {tuple(r) for r in cluster.cluster_hills(df, CONFIG)[0].collect()}
    quality, none = cluster.cluster_hills(df, CONFIG, assigning=False)
    assert none is None and {tuple(r) for r in quality.collect()} == want
    present = {(r.model, r.kmer): r.n for r in cluster.hill_presence(df.withColumnRenamed("seq", "hill"), ["a"], 4, 5).collect()}
    names = cluster.canonical_kmers(4, 5)
    plain = (cluster.profile_matrix([r[4] for r in rows if r[0] == "a"], names, 4, 5) > 0).sum(axis=0)
    assert present == {("a", w): n for w, n in zip(names, plain.tolist(), strict=True) if n}
