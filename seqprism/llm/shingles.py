"""Word shingles of many documents at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACE = mixed(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a binary column, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at.astype(np.int64)


def spans(sizes: np.ndarray, most: int = 1 << 19) -> list[tuple[int, int]]:
    """Runs of documents of about `most` bytes together."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            out.append((first, i))
            first, held = i, 0
        held += size
    return [*out, (first, len(sizes))] if len(sizes) else out


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of bytes that aren't white space, in order."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = np.append(0, ends[:-1])
    begins = begins[begins < len(data)]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(solid)
    number = np.cumsum(first)[at] - 1
    place = at - starts[number]
    with np.errstate(over="ignore"):
        value = _BYTE[data[at]] * _PLACE[place & 4095]
        heads = np.searchsorted(at, starts)
        total = np.add.reduceat(value, heads)
        size = np.diff(np.append(heads, len(at))).astype(np.uint64)
        return mixed(total + size * _ODD), np.searchsorted(ends, starts, side="right")


def shingle_hashes(words: np.ndarray, doc: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of `size` words; of a shorter document, of all its words."""
    if not len(words):
        return words, doc
    with np.errstate(over="ignore"):
        joined = np.zeros(len(words), np.uint64)
        for k in range(size):
            shifted = words[k:] if k == 0 else np.append(words[k:], np.zeros(min(k, len(words)), np.uint64))
            inside = np.append(doc[k:], np.full(min(k, len(doc)), -1)) == doc
            joined += np.where(inside, shifted, np.uint64(0)) * _PLACE[k + 7]
        full = np.append(doc[size - 1 :], np.full(min(size - 1, len(doc)), -1))[: len(doc)] == doc
        opening = np.append(True, doc[1:] != doc[:-1])
        short = opening & ~full
        keep = full | short
        return mixed(joined[keep] + np.where(full[keep], np.uint64(0), _ODD)), doc[keep]


def multisets(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, count) of the distinct shingles of each document, documents in order."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])) if len(hashes) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    return hashes[heads], doc[heads], np.diff(np.append(heads, len(hashes)))


def occurrence_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One key for each occurrence: sets of these have the Jaccard similarity of the multisets."""
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return np.repeat(hashes, counts) + mixed(number.astype(np.uint64)) * np.uint64(2)
