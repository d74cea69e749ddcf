"""Merkle manifest against a plain tree, with small blocks so that all rounds are used; awkward rows."""

import hashlib
import random
import zlib

import pytest

from seqprism.llm import merkle

from .rows import DOCS


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes):
    """Levels of a tree, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, place):
    for own in levels[:-1]:
        first = place - place % 8
        yield "".join(own[first:place]), "".join(own[place + 1 : first + 8])
        place //= 8


def plain(rows):
    """Of (doc_id, text, lang, source, n_chars): sorted result rows."""
    groups = {}
    for i, text, lang, source, n in rows:
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        bad = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        own = leaf([i, source, lang, n, text])
        groups.setdefault(lang, []).append((i, own, leaf([i, source, lang, n, low]) if bad else own))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = grow([r[1] for r in groups[name]])
    top = grow([trees[name][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        for place, (i, own, told) in enumerate(groups[name]):
            path = [*siblings(trees[name], place), *siblings(top, at)]
            for before, after in path:
                told = h(before + told + after)
            root = top[-1][0]
            out.append((i, own, trees[name][-1][0], root, h("".join(b + a for b, a in path)), told, told == root))
    return sorted(out, key=str)


def result(docs, span=merkle.SPAN):
    got = merkle.document_manifest(docs, span).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str)


@pytest.mark.parametrize(("span", "shuffles"), [(1, 7), (2, 4), (5, 3)])
def test_groups_of_all_sizes_over_many_partitions(spark, span, shuffles):
    draw = random.Random(span)
    sizes = {None: 70, "": 1, "a": 8, "B": 9, "é": 64, "zz": 65, "big": 700}
    rows = [("".join(draw.choices("aBcD é", k=5)), lang, draw.choice(["s", None]), 3) for lang, n in sizes.items() for _ in range(n)]
    rows = [(i * 7 % 1000, *r) for i, r in enumerate(rows)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), span) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_awkward_rows(spark, docs, nothing):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    rows += [(9002, "Long TEXT é " * 200_000, "en", "s", None), rows[1], rows[1], (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, "k", 7) for r in rows], DOCS).selectExpr("*", *[f"1 AS `{c}`" for c in ("group", "leaf", "key", "other", "root", "at", "idx", "bundle", "name")])
    got = result(df)
    assert got == plain(rows) and {r[-1] for r in got} == {True, False}
    assert result(nothing) == []
    one = [(5, "Only", "en", "s", 4)]
    assert result(spark.createDataFrame([(*one[0], "k", 7)], DOCS)) == plain(one)


def test_tampering_shows_in_changed_rows_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = {r.doc_id: r.verified for r in merkle.document_manifest(docs).collect()}
    for r in docs.collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None and any("A" <= c <= "Z" for c in r.text)
        assert told[r.doc_id] is not changed
