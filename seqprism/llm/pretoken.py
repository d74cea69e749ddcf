"""Cutting text into pieces that a byte-level BPE treats separately, with a bounded memo per worker."""

from __future__ import annotations

from collections.abc import Callable

import regex

#: A blank after white space: the blank may then belong to a longer run of white space.
_UNSAFE = regex.compile(r"\s ")
#: Any other blank starts a new match of the pattern, whatever stands before it.
_SAFE_BLANK = regex.compile(r"(?<=\S) ")

#: Entries of a memo; it is emptied when full, which costs time and never changes a result.
MEMO_ENTRIES = 600_000


def chunks(text: str) -> list[str]:
    """Pieces that, each but the first prefixed with one blank, join to text; no match of the
    pattern crosses from one into another."""
    return _SAFE_BLANK.split(text) if _UNSAFE.search(text) else text.split(" ")


class ChunkMemo(dict):
    """Maps a chunk to its packed ids; computes missing ones by encode(chunk) -> bytes."""

    def __init__(self, encode: Callable[[str], bytes], entries: int = MEMO_ENTRIES):
        super().__init__()
        self.encode, self.entries = encode, entries

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        ids = self.encode(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids
