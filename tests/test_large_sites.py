"""Sites and their hills at a cost that grows with the letters alone."""

import random
import time

import numpy as np
import pytest

from seqprism.functions import arrays
from seqprism.operators import hills
from seqprism.plans import fixture

TEXTS = [(1, "en", "ACGT" * 100), (2, "en", None), (3, "de", "zzz"), (4, None, "aäcßgt" * 77), (5, "fr", ""), (6, "es", "a" * 150), (7, "es", "日" + "c" * 151), (None, "es", "acgt"), (8, "en", "ſKİaı" * 40)]
LABELS = [(1, 1, 0), (1, 0, 0), (4, 0, 1), (8, None, 1), (None, 1, 1)]


def written(spark, folder, texts, labels):
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_sites_of_odd_texts(spark, tmp_path):
    got = {tuple(r) for r in fixture.sites(spark, written(spark, tmp_path, TEXTS, LABELS)).collect()}
    want = set()
    for doc, lang, text in TEXTS:
        letters = "".join(c for c in text or "" if c in "ACGTacgt").upper()
        for quality in [q for i, q, _ in LABELS if i == doc and doc is not None] or [None]:
            kind = {1: "hi", 0: "lo"}.get(quality, "un")
            want |= {(None if doc is None else doc * fixture.SITES + t, lang, lang and f"{lang};{kind}", letters[t * 150 : t * 150 + 150]) for t in range(-(-len(letters) // 150))}
    assert got == want


def test_a_long_text_is_cut_in_linear_time(spark, tmp_path):
    """Before, each site was looked for from its text's beginning."""
    folder = written(spark, tmp_path, [(1, "en", "ACGTACGT--" * 600_000)], [])
    began = time.time()
    assert fixture.sites(spark, folder).selectExpr("sum(length(seq))").first()[0] == 4_800_000
    assert time.time() - began < 15


@pytest.mark.parametrize("levels", [2, 5, 1000])
def test_fold_without_ties_keeps_the_plain_ones(levels):
    draw = np.random.default_rng(levels)
    for shortest, longest in [(6, 14), (3, 5), (6, 6), (1, 4)]:
        n, width = 40, 50
        ends = draw.integers(1, width + 1, n)
        found = [(size, np.round(draw.integers(-levels, 2 * levels, (width - size + 1, n)) / levels, 6)) for size in range(shortest, longest + 1)]
        for size, scores in found:
            scores[np.arange(len(scores))[:, None] + size > ends] = -np.inf
        row, start, size, score, _ = hills.suppress_many(iter(found), width, n, shortest, 0.1)
        want = [(i, *w) for i in range(n) for w in hills.suppress_online([(s, k, float(x[s, i])) for k, x in found for s in range(len(x)) if x[s, i] > 0.1])]
        assert sorted(zip(row.tolist(), start.tolist(), size.tolist(), score.tolist(), strict=True)) == sorted(want)


def test_fold_costs_a_few_times_the_scores():
    """Before, it took 7.6 times as long as the scores on these rows, and 4.0 times after."""
    draw, n = random.Random(8), 8000
    letters = np.frombuffer(bytes(draw.choices(b"ACGT", k=150 * n)), np.uint8).reshape(150, n)
    tables = hills.value_tables({w: round(draw.gauss(0.02, 0.3), 6) for k in (4, 5) for w in arrays.spellings(k)}, 4, 5)

    def seconds(work):
        began = time.process_time()
        out = work()
        return time.process_time() - began, out

    scores = lambda: list(hills.scores_by_size(letters, np.full(n, 150), tables, 0, 6, 14))
    found = scores()
    made = min(seconds(scores)[0] for _ in range(3))
    folded = min(seconds(lambda: hills.suppress_many(iter(found), 150, n, 6, 0.1))[0] for _ in range(3))
    assert folded < 5.8 * made
