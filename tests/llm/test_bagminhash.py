"""Near-duplicate components against brute force, and the cutting of large buckets."""

import collections
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from seqprism.llm import bagminhash
from seqprism.llm.common import salted_join
from seqprism.llm.components import components

from .rows import words


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return collections.Counter([tuple(own[i : i + 5]) for i in range(len(own) - 4)] if len(own) > 4 else [tuple(own)] if own else [])


def brute_components(rows):
    """doc_id to the least id of its component, from all pairs that have a shingle in common."""
    sets, holders, parent = {k: shingles(t) for k, t in rows}, collections.defaultdict(list), {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    for a, b in {p for own in holders.values() for p in itertools.combinations(sorted(own), 2)}:
        if root(a) != root(b):
            x, y = sets[a], sets[b]
            common = (x & y).total()
            if common >= 0.8 * (x.total() + y.total() - common) - 1e-9:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {k: root(k) for k in sets}


def test_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute_components([tuple(r) for r in docs.collect()])
    got = {r.doc_id: r.component_id for r in bagminhash.near_duplicates(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_a_large_group_whose_members_differ(spark, monkeypatch):
    """Chains of edits, so that one hub doesn't link them all, with parts of a few kilobytes."""
    monkeypatch.setattr(bagminhash, "PART_BYTES", 20_000)
    draw, rows = random.Random(5), []
    for chain in range(3):
        text = words(90, chain).split()
        for step in range(30):
            rows.append((len(rows), " ".join(text)))
            text[draw.randrange(90)] = f"new{chain}x{step}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in bagminhash.near_duplicates(docs).collect()} == brute_components(rows)


def test_cross_links_find_every_pair():
    draw = random.Random(1)
    sets = [sorted(draw.sample(range(60), 40)) for _ in range(25)]
    sets += [sorted({*s[:-2], 100 + i, 101 + i}) for i, s in enumerate(sets)]
    grams = [np.array(s, np.uint64) for s in sets]
    every = np.arange(50)
    want = {(i, j) for i, j in itertools.permutations(range(50), 2) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    assert set(bagminhash.cross_links(grams, every, every, every)) == want


def test_tasks_hold_bounded_bytes_and_meet_every_pair(spark):
    """One bucket of 20,000 near copies, 300 of them outside its main component."""
    n, size = 20_000, 4_000
    label = F.when(F.col("id") % 67 == 0, F.col("id")).otherwise(F.lit(1))
    binary = lambda c: F.unhex(F.md5(c.cast("string").cast("binary")))
    labelled = spark.range(n).select(F.lit(5).cast("long").alias("band"), binary(F.col("id")).alias("node"), binary(label).alias("component"))
    grams = labelled.select("node", F.expr(f"cast(repeat('x', {size}) AS binary)").alias("grams"))
    tasks = bagminhash.search_tasks(labelled, grams, n).groupBy("i", "j").agg(F.count_if(~F.col("other")).alias("every"), F.count_if("other").alias("few")).toPandas()
    assert tasks["every"].max() * size < 1.5 * bagminhash.PART_BYTES and tasks["few"].max() * size < 1.5 * bagminhash.PART_BYTES
    few = -(-n // 67)
    assert (tasks.groupby("i")["every"].sum() == n).all() and (tasks.groupby("j")["few"].sum() == few).all()
    assert tasks["every"].max() < 3 * tasks["every"].median() and len(tasks) == tasks["i"].nunique() * tasks["j"].nunique()


def test_a_hot_key_is_cut(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"), "id")
    side = rows.groupBy("key").agg(F.count("*").alias("n"))
    joined = salted_join(rows, side, "key", "id", 30_000)
    assert joined.count() == 30_000 and joined.where("n <> CASE WHEN key = 0 THEN 10000 ELSE 1 END").isEmpty()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    draw = random.Random(2)
    shuffled = [(10_000 + a, 10_000 + b) for a, b in itertools.pairwise(draw.sample(range(60), 60))]
    star = [(50_000 + i, 49_000) for i in range(500)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain + shuffled + star, "a long, b long")).collect()}
    assert all(found[i] == 0 and found[10_000 + i % 60] == 10_000 for i in range(61)) and all(found[50_000 + i] == 49_000 for i in range(500))
