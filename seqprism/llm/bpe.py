"""Byte-level BPE by Aho-Corasick matches and backtracking (operator 3).

Bytes are mapped to Latin-1 characters, so one automaton over the vocabulary gives the longest
token that starts at each byte. The encoder takes longest matches and steps back to shorter ones
where the token before and the new one would not have stood side by side after the merges. That
test depends on the two tokens alone and is memoised; each byte is visited a bounded number of
times, so the work is linear in the piece, with the merges' exact result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .pretoken import MEMO_ENTRIES, ChunkMemo, chunks

#: Token pairs whose compatibility is remembered.
PAIR_ENTRIES = 400_000


class BacktrackingBPE:
    """Encoder and decoder for a rank file (base64 token, blank, rank on each line)."""

    def __init__(self, rank_file: str, pattern: str, memo_entries: int = MEMO_ENTRIES):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.lengths = [len(token) for token in self.vocabulary]
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        self._shorter: dict[int, int | None] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._matches = ChunkMemo(self._encode_match, memo_entries // 2)
        self.memo = ChunkMemo(self._encode_chunk, memo_entries)

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self._shorter:
            text = self.vocabulary[token]
            self._shorter[token] = next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), None)
        return self._shorter[token]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a token that no merge made."""
        if token not in self._halves:
            text, found, left = self.vocabulary[token], None, self.shorter(token)
            while left is not None and found is None:
                right = self.ranks.get(text[self.lengths[left] :])
                if right is not None and left < token and right < token and self._stand(left, right, token):
                    found = left, right
                left = self.shorter(left)
            self._halves[token] = found
        return self._halves[token]

    def _stand(self, left: int, right: int, before: int) -> bool:
        """Whether left and right stay apart until merge number `before`.

        Both tokens are undone from their youngest merge back; at each state the pair that touches
        the border must have no merge older than the one that was undone last.
        """
        while True:
            merged = self.ranks.get(self.vocabulary[left] + self.vocabulary[right])
            if merged is not None and merged < before:
                return False
            undo_left, undo_right = self.halves(left), self.halves(right)
            if undo_left and (left > right or not undo_right):
                # The left token's merge came later; among equals the left place merges first.
                before, left = left, undo_left[1]
            elif undo_right:
                before, right = right + 1, undo_right[0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIR_ENTRIES:
                self._pairs.clear()
            known = self._pairs[key] = self._stand(left, right, len(self.vocabulary) + 1)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        lengths, compatible = self.lengths, self.compatible
        longest = [0] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end - lengths[token] + 1] = token
        open_ends = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if open_ends[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == len(piece):
                    return out
                at, token = end, longest[end]
            elif (fewer := self.shorter(token)) is not None:
                token = fewer
            else:
                # No token fits here after the one before: that one is tried shorter.
                open_ends[at] = 0
                token = out.pop()
                at -= lengths[token]

    def _encode_match(self, match: str) -> bytes:
        return array("I", self.encode_piece(match.encode("utf-8", "surrogatepass"))).tobytes()

    def _split(self, text: str) -> bytes:
        return b"".join(map(self._matches.__getitem__, self.pattern.findall(text)))

    def _encode_chunk(self, chunk: str) -> bytes:
        return self._split(" " + chunk)

    def pack(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; b"" for null."""
        if not text:
            return b""
        first, *rest = chunks(text)
        return self._split(first) + b"".join(map(self.memo.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.pack(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str) -> BacktrackingBPE:
    """One encoder, with its memos, for all tasks of a worker."""
    return BacktrackingBPE(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids binary): the packed ids of every whole text. Null or empty text: no ids. Rows with
    a null or repeated key are kept as they are; other columns are dropped."""

    def run(batches):
        bpe = encoder(rank_file, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.pack(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["key", "ids"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids binary").withColumnRenamed("key", key)


def round_trip_digests(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: n_tokens, SHA-256 of the packed ids and of the bytes that the ids decode to.

    Null or empty text: 0 tokens and the digests of nothing. One narrow pass, no shuffle.
    """

    def run(batches):
        bpe = encoder(rank_file, pattern)
        sha = hashlib.sha256
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for t in batch.column(1).to_pylist():
                packed = bpe.pack(t)
                counts.append(len(packed) // 4)
                ids_sha.append(sha(packed).hexdigest())
                decoded_sha.append(sha(bpe.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
