"""Best-fit packing by the sum-of-squares rule (operator 2).

A pass over the texts turns each document into token pieces, a few integers each, which are dealt by
a hash into blocks of bounded size. Each block is packed alone: a piece of full length is a sequence
of its own, any other goes where the sum of squared counts of open sequences per residual gap becomes smallest. Blocks do
not see each other, which costs at most a few part-filled sequences per block.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .pretoken import ChunkMemo, chunks

#: Short pieces that one block packs, on average; each document has one at most.
BLOCK_PIECES = 60_000
#: Fixed value: how byte-level tokenizer files split text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class DocumentTokenizer:
    """Packed ids of whole texts by a byte-level tokenizer file, as the tokenizers library gives them
    without special tokens. The merges run in tiktoken's core over the file's vocabulary, whose ids
    are in merge order: the same ids at a quarter of the time. Chunks are remembered."""

    def __init__(self, file: str):
        import tiktoken

        with open(file, encoding="utf-8") as text:
            whole = json.load(text)
        model = whole["model"]
        byte = byte_characters()
        made = [model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
        if made != sorted(made):
            raise ValueError(f"{file}: ids are not in the order of the merges")
        ranks = {bytes(byte[c] for c in token): rank for token, rank in model["vocab"].items() if all(c in byte for c in token)}
        merged = set(made)
        ranks = {token: rank for token, rank in ranks.items() if rank in merged or len(token) == 1}
        self.encode = tiktoken.Encoding("document", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # Tokens that the file adds are found in a text before it is split, the longest first.
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in whole.get("added_tokens", [])}
        self.literal = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.memo = ChunkMemo(lambda chunk: self.ids(" " + chunk))

    def ids(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def pack(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = chunks(text)
        return self.ids(first) + b"".join(map(self.memo.__getitem__, rest))

    def pack_document(self, text: str | None) -> bytes:
        """As pack(), with the ids of the file's added tokens where the text holds them, as the library
        does by default."""
        if not text or self.literal is None:
            return self.pack(text)
        return b"".join(self.added[part] if i % 2 else self.pack(part) for i, part in enumerate(self.literal.split(text)))


@lru_cache(maxsize=2)
def document_tokenizer(file: str) -> DocumentTokenizer:
    return DocumentTokenizer(file)


def cut_points(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all of full size but the first."""
    head = length % size or min(length, size)
    return [(0, head), *((start, size) for start in range(head, length, size))]


def pieces(docs: DataFrame, tokenizer_file: str, size: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, and ids if asked for.

    Null or empty text: the end id alone. Repeated rows and null keys give pieces of their own.
    """

    def run(batches):
        tokenize, end = document_tokenizer(tokenizer_file), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            owner, rows, ids = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                packed = tokenize.pack_document(t) + end
                view = memoryview(packed)
                for number, (start, length) in enumerate(cut_points(len(packed) // 4, size)):
                    own = view[4 * start : 4 * (start + length)]
                    owner.append(i)
                    rows.append((number, start, length, zlib.crc32(own)))
                    if with_ids:
                        ids.append(bytes(own))
            number, start, length, crc = np.array(rows, "i8").reshape(-1, 4).T
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number.astype("i4")), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), names=["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, sequences numbered from 0.

    Pieces come by falling length. For a piece of length s, an open sequence with gap g becomes one
    with gap g - s; with N(g) open sequences of gap g the sum of squares changes by
    2 * (N(g - s) - N(g)) + 2, or by 1 - 2 * N(s) where the piece fills the sequence. The smallest
    change wins, then the smallest gap. A new sequence is opened only where no open one has room:
    for a finite set of pieces that needs fewer sequences than weighing a new one by its square too.
    """
    count = np.zeros(size + 1, np.int64)
    holders: list[list[int]] = [[] for _ in range(size + 1)]
    used: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        open_now = np.flatnonzero(count[s:size])
        gap = size
        if open_now.size:
            change = 2 * (count[open_now] - count[open_now + s]) + 2
            if open_now[0] == 0:
                change[0] = 1 - 2 * count[s]
            gap = int(open_now[np.argmin(change)]) + s
        if gap == size:
            number = len(used)
            used.append(0)
        else:
            number = holders[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = number, used[number]
        used[number] += s
        if left := gap - s:
            holders[left].append(number)
            count[left] += 1
    return sequence, offset


def pack_pieces(rows: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces(), which are read twice.

    Pieces of full size are sequences of their own (negative ids) and meet in no task; the others are
    dealt into blocks of BLOCK_PIECES on average, however long their documents are.
    """
    names = [*rows.columns, "sequence_id", "offset"]
    full = rows.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = rows.where(F.col("length") < size)
    blocks = max(1, -(-short.count() // BLOCK_PIECES))
    spread = F.xxhash64("key", "start", "length", "ids_crc32")

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = sum_of_squares(block["length"].to_numpy(), size)
        return block.assign(sequence_id=(block["block"].to_numpy() << 36) + sequence, offset=offset)[names]

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return short.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("long")).groupBy("block").applyInPandas(pack, shape).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_file: str, size: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens.

    One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset. Null text: empty, so
    the end id alone; repeated rows and null keys are packed as rows of their own. An empty table
    gives no rows. Ties between pieces of equal length are broken by input order.
    """
    return pack_pieces(cut(pieces(docs, tokenizer_file, size, end_id, text, key)), size).withColumnRenamed("key", key)
