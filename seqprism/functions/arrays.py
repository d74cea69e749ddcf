"""k-mers of whole columns of sequences as numbers, for work on many rows at once inside a task.

A k-mer's number is its base-4 number with A, C, G, T as digits; 4^k stands for one with other letters or
beyond the sequence's end.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGIT = np.full(256, 4, np.uint8)
DIGIT[list(b"ACGT")] = range(4)
OTHER = str.maketrans("ACGT", "TGCA")
#: A, C, G, T for both cases of these letters, 0 for all other bytes.
UPPER = np.zeros(256, np.uint8)
UPPER[list(b"ACGTacgt")] = list(b"ACGTACGT")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings one after the other, offsets); a null has none."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "") if column.null_count else column
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return text, offsets - offsets[0]


def pieces(offsets: np.ndarray, letters: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of rows of about so many letters; a longer row is alone."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + letters, side="right")) - 1)
        yield at, end
        at = end


def gathered(batches: Iterable[pa.RecordBatch], column: int, letters: int) -> Iterable[pa.RecordBatch]:
    """The rows of the batches in batches of at most so many letters in a column of strings, each as large as
    whole batches allow; a larger batch stays as it is."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and n + own > letters:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
        held.append(batch)
        n += own
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def numbers(text: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The number of the k-mer that begins at each letter, as many as there are letters."""
    digits, n = DIGIT[text], max(0, len(text) - k + 1)
    out = np.full(len(text), 4**k, np.int32)
    if n:
        number, odd = np.zeros(n, np.int32), np.zeros(n, bool)
        for i in range(k):
            number = number * 4 + digits[i : i + n]
            odd |= digits[i : i + n] > 3
        out[:n] = np.where(odd, 4**k, number)
    last = (offsets[1:, None] - np.arange(1, k)).ravel()
    out[last[(last >= 0) & (last < len(text))]] = 4**k
    return out


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each row's letters, 0 for a row without any."""
    if len(offsets) < 2:
        return np.zeros(0, values.dtype)
    sums = np.add.reduceat(np.append(values, values.dtype.type(0)), offsets[:-1])
    return np.where(offsets[1:] > offsets[:-1], sums, 0)


def spellings(k: int) -> list[str]:
    """All k-mers by number."""
    return list(map("".join, itertools.product("ACGT", repeat=k)))


def value_tables(of: dict[str, float], kmin: int, kmax: int) -> dict[int, np.ndarray]:
    """For each length the weights of all k-mers by number, both strands alike; unknown ones are 0, and so
    is the last entry, which stands for k-mers with other letters."""
    tables = {k: np.zeros(4**k + 1) for k in range(kmin, kmax + 1)}
    digits = str.maketrans("ACGT", "0123")
    for kmer, weight in of.items():
        if len(kmer) in tables:
            for strand in (kmer, kmer.translate(OTHER)[::-1]):
                tables[len(kmer)][int(strand.translate(digits), 4)] = weight
    return tables


def cut_out(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings of so many bytes from each first one."""
    ends = np.cumsum(size, dtype=np.int64)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
    places = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(text[at].tobytes())]).cast(pa.string())


def tiles(text: np.ndarray, offsets: np.ndarray, width: int) -> pa.Array:
    """For each row the list of its letters A, C, G, T, upper-case and in order, in runs of `width`; the last
    may be shorter, and a row without any has none."""
    places = np.flatnonzero(UPPER[text])
    first = np.searchsorted(places, offsets)
    size = np.diff(first)
    n = -(-size // width)
    ends = np.cumsum(n)
    begin = np.repeat(first[:-1] - width * (ends - n), n) + width * np.arange(ends[-1] if len(ends) else 0)
    runs = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(np.append(begin, len(places)).astype(np.int32)), pa.py_buffer(UPPER[text[places]])])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), runs)
