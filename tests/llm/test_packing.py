"""Packing against a plain version of the pieces and of the sum-of-squares rule."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers as tokenizers
from tokenizers import Tokenizer

from seqprism.llm import packing

from .rows import words


def plain_rule(lengths, size):
    """The rule by trying every open sequence and summing all squares."""
    gaps, out = [], [None] * len(lengths)
    total = lambda gaps: sum(n * n for g, n in collections.Counter(gaps).items() if g)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(total([*gaps[:k], g - lengths[i], *gaps[k + 1 :]]), g, k) for k, g in enumerate(gaps) if g >= lengths[i]]
        if fits:
            out[i] = min(fits)[2]
            gaps[out[i]] -= lengths[i]
        else:
            out[i] = len(gaps)
            gaps.append(size - lengths[i])
    return out, gaps


def test_sum_of_squares_is_the_plain_rule():
    draw = random.Random(1)
    for _ in range(60):
        lengths = [draw.randint(1, 12) for _ in range(draw.randint(1, 40))]
        sequence, offset = packing.sum_of_squares(np.array(lengths), 16)
        _, gaps = plain_rule(lengths, 16)
        used = collections.Counter()
        for s, n in zip(sequence.tolist(), lengths, strict=True):
            used[s] += n
        assert sorted(16 - n for n in used.values()) == sorted(gaps)


def test_pieces_and_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 4)
    file = tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    extra = spark.createDataFrame([(50, words(30_000, 4), "en", "s", 1, "k", 7), (51, words(6000, 5), None, None, 1, "k", 7)], docs.schema)
    table = docs.unionByName(extra)
    rows = packing.pack_documents(table, file).collect()
    text = {r.doc_id: r.text or "" for r in table.collect()}
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.piece, r.start, r.length, r.ids_crc32))
    for key, t in text.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or min(len(ids), 2048)
        edges = [0, *range(head, len(ids) + 1, 2048)]
        want = {(n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))}
        assert got[key] == want
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for own in fill.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and sum(x[1] for x in own) <= 2048
    assert all(own == [(0, 2048)] for s, own in fill.items() if s < 0) and any(s < 0 for s in fill)
