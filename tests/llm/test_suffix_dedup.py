"""Passage removal: the external sort within its memory, and the operator against brute force."""

import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import pytest

from seqprism.llm import suffix_dedup, suffix_sort

from .rows import words


@pytest.mark.parametrize(("budget", "batch"), [(1 << 20, 1 << 17), (20, 7), (3, 2)])
def test_suffix_order(budget, batch):
    draw = random.Random(budget)
    for _ in range(120):
        k, depth, text = draw.choice([1, 2, 5]), draw.choice([3, 6, 50]), []
        for _ in range(draw.randint(1, 8)):
            text += [draw.randrange(k) + 1 for _ in range(draw.randint(1, 20))] + [0]
        groups = suffix_sort.suffix_groups(np.array(text), depth, suffix_sort.Scratch(budget, batch))
        at, lcp = map(list, zip(*[(a, c) for p, q in groups for a, c in zip(p.tolist(), q.tolist(), strict=True)], strict=True))
        own = [tuple(text[a : a + depth]) for a in at]
        assert sorted(at) == list(range(len(text))) and own == sorted(own)
        for i in range(1, len(own)):
            assert lcp[i] == sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(own[i - 1], own[i], strict=False)))


def test_a_sort_far_larger_than_its_memory(tmp_path, monkeypatch):
    """A text of 100 times the budget, through several levels of names; memory is traced throughout."""
    draw = np.random.default_rng(0)
    vocabulary = [bytes(draw.integers(97, 105, draw.integers(2, 8)).astype(np.uint8)) for _ in range(300)]
    text = np.frombuffer(b" ".join(vocabulary[i] for i in draw.integers(0, 300, 90_000)), np.uint8)[:400_000].astype(np.uint16) + 1
    text[76::77] = 0
    text[-1] = 0
    text[-2] = max(text[-2], 1)
    text.tofile(tmp_path / "text")
    calls, whole = [], suffix_sort.induced
    monkeypatch.setattr(suffix_sort, "induced", lambda text, *rest: (calls.append(len(text)), whole(text, *rest))[1])
    stored = np.memmap(tmp_path / "text", np.uint16, "r")
    seen, last = np.zeros(len(text), bool), b""
    big_endian = text.astype(">u2").tobytes()
    tracemalloc.start()
    for at, lcp in suffix_sort.suffix_groups(stored, 50, suffix_sort.Scratch(4_000, 2_000)):
        seen[at] = True
        for a, c in zip(at[:40].tolist(), lcp[:40].tolist(), strict=True):
            own = big_endian[2 * a : 2 * a + 100]
            assert own >= last and (c == 50 or own[2 * c : 2 * c + 2] != last[2 * c : 2 * c + 2] or not last)
            last = own
        last = big_endian[2 * int(at[-1]) : 2 * int(at[-1]) + 100]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen.all() and len(calls) >= 3 and peak < 1_500_000  # the arrays of the sort are some 40 bytes a character


def wanted(rows):
    """n_bytes, n_removed, n_spans and digest of (key, bytes) rows, by the definition."""
    seen, want = set(), {}
    for key, own in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        mine = set()
        for _, body in own:
            gone, reach = bytearray(len(body)), 0
            for i in range(len(body) - 49):
                mine.add(body[i : i + 50])
                if body[i : i + 50] in seen:
                    gone[max(i, reach) : i + 50] = b"\1" * (i + 50 - max(i, reach))
                    reach = i + 50
            want[key] = (len(body), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(x for x, g in zip(body, gone, strict=True) if not g)).hexdigest())
        seen |= mine
    return want


def check(df):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    want = wanted([r for r in rows if r[0] is not None])
    got = suffix_dedup.passage_digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


@pytest.mark.parametrize("budget", [suffix_dedup.SORT_BUDGET, 300])
def test_passages(docs, nothing, budget, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORT_BUDGET", budget)
    check(docs)
    assert suffix_dedup.passage_digests(nothing).count() == 0


def test_passages_of_whole_tables(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))


def test_a_passage_in_every_document_and_very_long_texts(spark):
    """Copies, overlapping cuts of one passage in different surroundings, and a text of 1 MB."""
    passage = words(40, 99)
    rows = [(i, words(8, i) + passage[i % 30 : 90 + i % 60] + words(8, i // 3)) for i in range(600)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]
    long_text = words(200_000, 5)
    rows += [(2000, long_text), (2001, "x" + long_text[500_000:] + "y"), (2002, "ab" * 40_000)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_pieces_of_copies_are_sent_once():
    """However many documents of a part hold a passage, one of them sends its pieces."""
    passage = words(40, 7).encode()
    few, many = ([(i, i, passage) for i in range(n)] for n in (2, 500))
    sent = []
    for rows in (few, many):
        keys, ids, bodies = map(list, zip(*rows, strict=True))
        part = suffix_dedup.Part(keys, ids, bodies, set(zip(keys, ids, strict=True)), 50, 24, 4)
        sent.append(len(part.bucket))
        assert (part.least == 0).all() and part.several.all()
    assert sent[0] == sent[1]


def test_texts_without_their_passages(docs, nothing):
    rows = {r.doc_id: r for r in suffix_dedup.without_passages(docs).collect() if r.doc_id is not None}
    assert suffix_dedup.without_passages(docs).columns == docs.columns and suffix_dedup.without_passages(nothing).count() == 0
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows.values())
    before = {r.doc_id: r for r in docs.collect() if r.doc_id is not None}
    assert rows[0].text == before[0].text and rows[1].text == "" and rows[5].text is None and rows[6].text == ""
    # The end of document 4 is its own; its beginning is that of document 3.
    assert before[4].text.endswith(rows[4].text) and 0 < len(rows[4].text) < len(before[4].text) - 250
    # A cut within a character gives the character back.
    assert rows[9].text == "éq" or rows[9].text == "q"
    assert all((rows[i].kept, rows[i].row, rows[i].lang) == (before[i].kept, before[i].row, before[i].lang) for i in rows)
    assert suffix_dedup.kept_text("aéb".encode(), np.array([[2, 4]])).decode() == "aé"
