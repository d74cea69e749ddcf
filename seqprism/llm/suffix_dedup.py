"""Removal of repeated byte passages by external suffix sorting (operator 9).

A byte goes if a `window`-byte string that covers it also starts in a document with a smaller id.

1. Of documents with equal texts only the one with the smallest id is searched; the others are removed
   whole. Texts are dealt by a hash into parts of bounded size, once: every step below works on a part.
2. Every window has a landmark: the least hash among its `gram`-byte strings. A run of windows with one
   landmark, with all bytes they cover, is a piece. A part names its distinct pieces, each with the
   least document that has it, to the bucket of the landmark. Equal windows have equal landmarks.
3. A bucket tells every part which of its pieces matter (another document has the landmark, too) and
   whether a smaller document outside the part has the same piece. If so, the piece goes wherever it
   stands in the part; else the part sends the piece's bytes to the bucket, once.
4. A bucket sorts the suffixes of its distinct pieces by external induction with common prefixes; runs
   of suffixes with a common prefix of `window` bytes are equal windows, and a window is removed from
   a piece whose least document is larger than the least one of the run.
5. The part cuts what its occurrences of the pieces lose.

A piece in very many texts is one entry for each part, not for each text, and its bytes travel once,
so no group grows with the number of copies. Pieces reach the sort as a stream that is spooled to
scratch files of the task, and the sort holds a bounded number of entries: a bucket may be far larger
than memory. (These files are the task's own and go with it; a task that is lost starts anew.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import cut
from .suffix_sort import BUDGET, Scratch, induced, slices

#: Bytes of text that a part, and so a bucket, holds on average.
PART_BYTES = 6 << 20
#: Bytes that are hashed at once: the arrays then stay in the processor's cache.
SPAN = 1 << 17
#: Entries that a sort holds in memory.
SORT_BUDGET = BUDGET

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(32)) * _ODD
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram-byte string, by joining strings of doubling length."""
    with np.errstate(over="ignore"):
        part, length, made, have = _BYTE[data], 1, None, 0
        while True:
            if gram & length:
                if made is None:
                    made = part
                else:
                    size = len(data) - have - length + 1
                    made = made[:size] * _ODD + part[have : have + size]
                have += length
            if have == gram:
                return _mixed(made)
            size = len(data) - 2 * length + 1
            part = part[:size] * np.uint64(2 * length + 0x5851F42D4C957F2D) + part[length : length + size]
            length *= 2


def sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """least over each run of width values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = least(out[:-step], out[step:])
        have += step
    return out


def landmarks(data: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows, hash of all its bytes) of each run of windows with the
    same landmark.

    data: documents one after another, each ending at one of ends. A run has as many windows as a
    window has grams at most; longer ones (of periodic text) are split.
    """
    if len(data) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    width = window - gram + 1
    grams = gram_hashes(data, gram)
    least = sliding(grams | np.uint64(1), width, np.minimum)
    starts = np.append(0, ends[:-1])
    usable = ends - starts >= window
    edges = np.zeros(len(least) + 1, np.int32)
    np.add.at(edges, starts[usable], 1)
    np.add.at(edges, ends[usable] - window + 1, -1)
    least[np.cumsum(edges[:-1]) == 0] = 0
    heads = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    length = np.diff(np.append(heads, len(least)))
    heads, length = heads[least[heads] != 0], length[least[heads] != 0]
    parts = -(-length // width)
    number = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(heads, parts) + number * width
    count = np.minimum(np.repeat(heads + length, parts) - first, width)
    # Grams end to end cover the run's bytes; the last one ends where they do.
    name, size = _mixed(count.astype(np.uint64)), count + window - 1
    with np.errstate(over="ignore"):
        for k in range(0, 2 * window - gram, gram):
            name = _mixed(name * _ODD + grams[first + np.minimum(k, size - gram)])
    return least[first], first, count, name


def _spans(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents of about SPAN bytes together."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > SPAN:
            out.append((first, i))
            first, held = i, 0
        held += size
    return [*out, (first, len(sizes))] if len(sizes) else out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(buckets)


class Part:
    """The searched texts of one part, and their pieces.

    Pieces are numbered by (bucket, landmark, name); `least` is the smallest key with the piece here,
    `several` whether more than one document here has its landmark.
    """

    def __init__(self, keys: np.ndarray, rows: np.ndarray, bodies: list[bytes], searched: set[tuple[int, int]], window: int, gram: int, buckets: int):
        self.window, self.position = window, {}
        for i, pair in enumerate(zip(keys, rows, strict=True)):
            # Repeated rows are one document.
            if pair in searched:
                self.position.setdefault(pair, i)
        own = list(self.position.values())
        self.place = {i: k for k, i in enumerate(own)}
        sizes = np.array([len(bodies[i]) for i in own], np.int64)
        self.data = np.frombuffer(b"".join(bodies[i] for i in own), np.uint8)
        self.offsets = np.append(0, np.cumsum(sizes))
        found = []
        for a, b in _spans(sizes):
            begin = self.offsets[a]
            hashed, at, count, name = landmarks(self.data[begin : self.offsets[b]], self.offsets[a + 1 : b + 1] - begin, window, gram)
            found.append((hashed, at + begin, count, name))
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        hashed, at, count, name = (np.concatenate(x) for x in zip(empty, *found, strict=True))
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        key = np.array([keys[i] for i in own], np.int64)[doc] if len(own) else np.empty(0, np.int64)
        bucket = _bucket(hashed, buckets).astype(np.int64)
        short = hashed.astype(np.uint32)
        order = np.lexsort((at, key, name, short, bucket))
        self.at, self.count, self.doc, self.key = at[order], count[order], doc[order], key[order]
        bucket, short, name = bucket[order], short[order], name[order]
        mark = np.append(True, (bucket[1:] != bucket[:-1]) | (short[1:] != short[:-1])) if len(order) else np.empty(0, bool)
        new = mark | np.append(True, name[1:] != name[:-1]) if len(order) else mark
        self.heads = np.flatnonzero(new)
        self.number = np.cumsum(new) - 1
        self.bucket, self.short, self.name, self.least = bucket[self.heads], short[self.heads], name[self.heads], self.key[self.heads]
        marks = np.flatnonzero(mark)
        if len(marks):
            mixed = np.minimum.reduceat(self.doc, marks) != np.maximum.reduceat(self.doc, marks)
            self.several = mixed[(np.cumsum(mark) - 1)[self.heads]]
        else:
            self.several = np.empty(0, bool)
        self.bounds = np.append(np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])), len(self.bucket)) if len(self.bucket) else np.zeros(1, np.int64)

    def bundles(self) -> Iterator[tuple[int, slice]]:
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            yield int(self.bucket[a]), slice(a, b)

    def states(self, mail: dict[int, bytes]) -> np.ndarray:
        """What the buckets say of each piece: 0 nothing, 1 a smaller document has it, 2 it is sorted."""
        out = np.zeros(len(self.bucket), np.uint8)
        for bucket, own in self.bundles():
            if bucket in mail:
                out[own] = np.frombuffer(mail[bucket], np.uint8)
        return out


_PAIR = "part int, key long, row long"
_NAMED = "bucket int, part int, short binary, name binary, least binary, several binary"
_STATES = "part int, bucket int, states binary"
_BYTES = "bucket int, part int, piece binary, size binary, least binary, bytes binary"
_SPANS = "part int, bucket int, piece binary, begin binary, end binary"
#: What comes to a part besides its texts: searched rows, states of pieces, spans of sorted pieces.
_MAIL = "part int, key long, row long, bucket int, states binary, piece binary, begin binary, end binary"


def _read_part(texts: pa.Table, mail: pa.Table, window: int, gram: int, buckets: int) -> tuple[Part, list, list, list, list[dict]]:
    keys, rows, bodies = (texts.column(c).to_pylist() for c in ("key", "row", "bytes"))
    letters = mail.select(["key", "row", "bucket", "states", "piece", "begin", "end"]).to_pylist()
    searched = {(x["key"], x["row"]) for x in letters if x["row"] is not None}
    return Part(keys, rows, bodies, searched, window, gram, buckets), keys, rows, bodies, letters


def _table(rows: list[tuple], shape: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in shape.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _part_number(texts: pa.Table) -> int:
    return texts.column("part")[0].as_py()


def _name_pieces(window: int, gram: int, buckets: int):
    def run(texts: pa.Table, mail: pa.Table) -> pa.Table:
        if not len(texts) or not len(mail):
            return _table([], _NAMED)
        own, *_ = _read_part(texts, mail, window, gram, buckets)
        number = _part_number(texts)
        return _table([(b, number, own.short[x].tobytes(), own.name[x].tobytes(), own.least[x].tobytes(), own.several[x].tobytes()) for b, x in own.bundles()], _NAMED)

    return run


def _rate_pieces(named: pa.Table) -> pa.Table:
    """For the pieces that each part named: states, as Part.states() reads them.

    The landmark's low half is enough within a bucket of bounded size; the piece's own hash joins it to
    96 bits beside the bucket. Pieces of which the part has the least key are sorted; so are those that
    two parts have with the same key (of documents with one id).
    """
    parts, bucket = named.column("part").to_pylist(), named.column("bucket")[0].as_py()
    joined = lambda c, kind: np.frombuffer(b"".join(named.column(c).to_pylist()), kind)
    short, name, least, several = joined("short", np.uint32), joined("name", np.uint64), joined("least", np.int64), joined("several", bool)
    order = np.lexsort((least, name, short))
    mark = np.append(True, short[order][1:] != short[order][:-1])
    new = mark | np.append(True, name[order][1:] != name[order][:-1])
    first = least[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    heads = np.flatnonzero(mark)
    size = np.diff(np.append(heads, len(order)))
    matters = ((size > 1) | np.logical_or.reduceat(several[order], heads))[np.cumsum(mark) - 1]
    states = np.empty(len(order), np.uint8)
    states[order] = np.where(matters, np.where(least[order] == first, 2, 1), 0)
    out, done = [], 0
    for part, packed in zip(parts, named.column("short").to_pylist(), strict=True):
        n = len(packed) // 4
        if states[done : done + n].any():
            out.append((part, bucket, states[done : done + n].tobytes()))
        done += n
    return _table(out, _STATES)


def _send_pieces(window: int, gram: int, buckets: int):
    def run(texts: pa.Table, mail: pa.Table) -> pa.Table:
        if not len(texts) or not len(mail):
            return _table([], _BYTES)
        own, _, _, _, letters = _read_part(texts, mail, window, gram, buckets)
        states, number, out = own.states({x["bucket"]: x["states"] for x in letters if x["states"] is not None}), _part_number(texts), []
        for bucket, x in own.bundles():
            chosen = np.flatnonzero(states[x] == 2)
            if len(chosen):
                at = own.heads[x][chosen]
                size = own.count[at] + window - 1
                flat = np.repeat(own.at[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                out.append((bucket, number, chosen.astype(np.uint32).tobytes(), size.astype(np.uint32).tobytes(), own.least[x][chosen].tobytes(), own.data[flat].tobytes()))
        return _table(out, _BYTES)

    return run


class Shard:
    """The distinct pieces of one bucket, spooled as they come: a text in which each is followed by 0,
    and of each piece where it starts, its size, least key, part and number there."""

    KINDS = {"text": np.uint16, "start": np.int64, "size": np.int32, "least": np.int64, "part": np.int32, "piece": np.uint32}

    def __init__(self, budget: int):
        self.scratch = Scratch(budget)
        self.paths = {c: self.scratch.path() for c in self.KINDS}
        self.files = {c: open(path, "wb") for c, path in self.paths.items()}
        self.length = self.pieces = 0

    def add(self, part: int, piece: np.ndarray, size: np.ndarray, least: np.ndarray, data: np.ndarray) -> None:
        stops = np.cumsum(size + 1)
        text = np.zeros(int(stops[-1]), np.uint16)
        inside = np.ones(len(text), bool)
        inside[stops - 1] = False
        text[inside] = data.astype(np.uint16) + 1
        rows = {"text": text, "start": stops - size - 1 + self.length, "size": size, "least": least, "part": np.full(len(size), part), "piece": piece}
        for c, values in rows.items():
            self.files[c].write(np.asarray(values, self.KINDS[c]).tobytes())
        self.length += len(text)
        self.pieces += len(size)

    def spans(self, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, piece, begin, end) of the runs of bytes that pieces lose, part by part as they came."""
        for file in self.files.values():
            file.close()
        with self.scratch as scratch:
            load = lambda c: np.memmap(self.paths[c], self.KINDS[c], "r") if len(self) > scratch.budget else np.fromfile(self.paths[c], self.KINDS[c])
            text, start, size, least, part, piece = map(load, self.KINDS)
            gone = scratch.array(self.length, bool)
            for at in smaller_elsewhere(induced(text, 257, window, scratch), start, size, least, window, scratch):
                gone[at] = True
            edge = 0
            for a, b in slices(self.pieces, max(1, scratch.batch // window)):
                stop = int(start[b - 1]) + int(size[b - 1]) + 1
                own = np.concatenate([[0], np.asarray(gone[edge:stop]).view(np.int8), [0]])
                change = np.diff(own)
                begin, end = np.flatnonzero(change == 1) + edge, np.flatnonzero(change == -1) + edge
                owner = np.searchsorted(start[a:b], begin, "right") - 1 + a
                for p in np.unique(part[owner]) if len(owner) else ():
                    x = part[owner] == p
                    yield int(p), piece[owner[x]], begin[x] - start[owner[x]], end[x] - start[owner[x]] + window - 1
                edge = stop

    def __len__(self) -> int:
        return self.length


def smaller_elsewhere(order: Iterator[tuple[np.ndarray, np.ndarray]], start: np.ndarray, size: np.ndarray, least: np.ndarray, window: int, scratch: Scratch) -> Iterator[np.ndarray]:
    """Places of every window that a piece with a smaller key has, too.

    A run of equal windows that goes on beyond a batch is spooled until its least key is known.
    """
    spool, lowest = scratch.spool(), np.iinfo(np.int64).max

    def owner_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(start, at, "right") - 1

    def closed() -> Iterator[np.ndarray]:
        for a, b in slices(len(spool), scratch.batch):
            at = spool.read(a, b)["at"]
            yield at[least[owner_of(at)] > lowest]
        spool.clear()

    for places, lcp in order:
        for a, b in slices(len(places), scratch.batch):
            at, new = places[a:b], lcp[a:b] < window
            owner = owner_of(at)
            usable = start[owner] + size[owner] - at >= window
            # Suffixes too short for a window share none with their neighbours beyond their piece.
            run = np.cumsum(new)
            at, owner, run = at[usable], owner[usable], run[usable]
            total = int(new.sum())
            key = np.asarray(least[owner])
            opening = run == 0
            if opening.any():
                spool.put(at[opening], np.zeros(int(opening.sum()), np.uint8))
                lowest = min(lowest, int(key[opening].min()))
            if total:
                yield from closed()
                lowest = np.iinfo(np.int64).max
                whole = (run > 0) & (run < total)
                if whole.any():
                    heads = np.flatnonzero(np.append(True, run[whole][1:] != run[whole][:-1]))
                    lows = np.repeat(np.minimum.reduceat(key[whole], heads), np.diff(np.append(heads, int(whole.sum()))))
                    yield at[whole][key[whole] > lows]
                tail = (run == total) & (run > 0)
                if tail.any():
                    spool.put(at[tail], np.zeros(int(tail.sum()), np.uint8))
                    lowest = int(key[tail].min())
    yield from closed()


def _sort_shards(window: int, budget: int):
    """Of a stream of bundles in the order of their buckets, the spans that pieces lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, shard = None, None

        def finish() -> Iterator[pa.RecordBatch]:
            if shard is not None:
                rows = [(part, bucket, *(np.asarray(x, np.uint32).tobytes() for x in (piece, begin, end))) for part, piece, begin, end in shard.spans(window)]
                yield from _table(rows, _SPANS).to_batches()

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    yield from finish()
                    bucket, shard = row["bucket"], Shard(budget)
                numbers = (np.frombuffer(row[c], kind) for c, kind in (("piece", np.uint32), ("size", np.uint32), ("least", np.int64), ("bytes", np.uint8)))
                piece, size, least, data = numbers
                shard.add(row["part"], piece, size.astype(np.int64), least, data)
        yield from finish()

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching (begin, end) pairs as maximal runs."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    heads = np.flatnonzero(new)
    return np.stack([spans[heads, 0], reach[np.append(heads[1:], len(spans)) - 1]], axis=1)


def lost_spans(part: Part, letters: list[dict]) -> list[np.ndarray]:
    """The maximal (begin, end) runs that each searched text of a part loses."""
    window = part.window
    states = part.states({x["bucket"]: x["states"] for x in letters if x["states"] is not None})
    base = {bucket: own.start for bucket, own in part.bundles()}
    # Occurrences of a piece that a smaller document has, here or elsewhere, go whole.
    state = states[part.number]
    whole = np.flatnonzero((state == 1) | ((state == 2) & (part.key > part.least[part.number])))
    docs, begins, ends = [part.doc[whole]], [part.at[whole]], [part.at[whole] + part.count[whole] + window - 1]
    tails = np.append(part.heads[1:], len(part.at))
    for x in letters:
        if x["piece"] is not None:
            piece, begin, end = (np.frombuffer(x[c], np.uint32).astype(np.int64) for c in ("piece", "begin", "end"))
            piece = piece + base[x["bucket"]]
            size = tails[piece] - part.heads[piece]
            of = np.repeat(np.arange(len(piece)), size)
            at = np.repeat(part.heads[piece], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            own = part.key[at] == part.least[part.number[at]]
            at, of = at[own], of[own]
            docs.append(part.doc[at])
            begins.append(part.at[at] + begin[of])
            ends.append(part.at[at] + end[of])
    doc, begin, end = (np.concatenate(x) for x in (docs, begins, ends))
    order = np.argsort(doc, kind="stable")
    doc, begin, end = doc[order], begin[order] - part.offsets[doc[order]], end[order] - part.offsets[doc[order]]
    bounds = np.searchsorted(doc, np.arange(len(part.offsets)))
    none = np.empty((0, 2), np.int64)
    return [merged(np.stack([begin[a:b], end[a:b]], axis=1)) if b > a else none for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def removal(docs: DataFrame, finish, schema: Callable[[StructField], StructType], window: int, gram: int, text: str, key: str, carry: list[str] = ()) -> DataFrame:
    """The rows of finish(texts, spans) for each part: texts as an Arrow table (key, bytes, rest), spans
    a list of (begin, end) arrays, one for each row. schema: that of the rows, given the field `rest`.

    Null text: empty. Rows with a null id neither lose bytes nor take them from others; rows with
    equal ids don't take from each other. The struct `rest` holds the columns named in carry, and
    `known`, whether the text is not null.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"), F.struct(F.col(text).isNotNull().alias("known"), *[docs[c].alias(f"of_{c}") for c in carry]).alias("rest"))
    row, other = F.xxhash64("bytes"), F.xxhash64(F.lit(1), F.col("bytes"))
    usable = (F.length("bytes") >= window) & F.col("key").isNotNull()
    light = cut(rows.where(usable).select("key", row.alias("row"), other.alias("other"), F.length("bytes").cast("long").alias("size")))
    total = light.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-total // PART_BYTES))
    part = F.pmod(F.xxhash64("key", "row"), F.lit(parts)).cast("int").alias("part")
    # A document is its id and the hash of its text; equal texts are told by 128 bits.
    searched = light.groupBy("row", "other").agg(F.min("key").alias("key")).select("key", "row").distinct().select(part, "key", "row").repartition(tasks, "part")

    # Every use takes the same columns, so the plan has this exchange once.
    texts = rows.select("key", row.alias("row"), "bytes", "rest").select(part, "key", "row", "bytes", "rest").repartition(max(tasks, parts // 4), "part")

    def letters(*sent: DataFrame) -> DataFrame:
        names = [f.split(" ") for f in _MAIL.split(", ")]
        whole = [df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast({"int": "int", "long": "bigint", "binary": "binary"}[kind])).alias(c) for c, kind in names]) for df in sent]
        out = whole[0]
        for df in whole[1:]:
            out = out.unionByName(df)
        return out

    def at_parts(f, shape, *sent: DataFrame) -> DataFrame:
        return texts.groupBy("part").cogroup(letters(*sent).groupBy("part")).applyInArrow(f, shape)

    named = at_parts(_name_pieces(window, gram, parts), _NAMED, searched)
    states = named.groupBy("bucket").applyInArrow(_rate_pieces, _STATES).repartition(tasks, "part")
    pieces = at_parts(_send_pieces(window, gram, parts), _BYTES, searched, states)
    dealt = pieces.repartition(max(tasks, parts // 4), "bucket").sortWithinPartitions("bucket")
    spans = dealt.mapInArrow(_sort_shards(window, SORT_BUDGET), _SPANS)

    def cut_part(texts: pa.Table, mail: pa.Table) -> pa.Table:
        own, keys, rows, bodies, letters = _read_part(texts, mail, window, gram, parts)
        lost, found = lost_spans(own, letters) if len(own.position) else [], []
        for i, (k, r, body) in enumerate(zip(keys, rows, bodies, strict=True)):
            if (k, r) in own.position:
                found.append(lost[own.place[own.position[k, r]]])
            else:
                # Not the least document with its text: all of it stands in another one.
                found.append(np.array([[0, len(body)]] if k is not None and len(body) >= window else [], np.int64).reshape(-1, 2))
        return finish(keys, bodies, texts.column("rest").combine_chunks(), found)

    return at_parts(cut_part, schema(rows.schema["rest"]), searched, states, spans)


def passage_digests(docs: DataFrame, window: int = 50, gram: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    Null and empty texts, and those shorter than a window, lose nothing; nor do rows with a null id.
    Repeated rows give equal results. An empty table gives no rows.
    """

    def finish(keys: list, bodies: list[bytes], rest: pa.Array, found: list[np.ndarray]) -> pa.Table:
        out = []
        for body, spans in zip(bodies, found, strict=True):
            kept = b"".join(body[a:b] for a, b in zip([0, *spans[:, 1].tolist()], [*spans[:, 0].tolist(), len(body)], strict=True))
            out.append((len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(keys, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = StructType([*(StructField(c, LongType()) for c in ("key", "n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())])
    return removal(docs, finish, lambda rest: schema, window, gram, text, key).withColumnRenamed("key", key)


def kept_text(body: bytes, spans: np.ndarray) -> bytes:
    """body without the spans; one that begins or ends within a character gives that character back."""
    at, parts = 0, []
    for begin, end in spans.tolist():
        while begin < end and body[begin] & 0xC0 == 0x80:
            begin += 1
        while begin < end < len(body) and body[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(body[at:begin])
        at = end
    return b"".join([*parts, body[at:]])


def without_passages(docs: DataFrame, window: int = 50, gram: int = 24, text: str = "text", key: str = "doc_id", size: str = "n_chars") -> DataFrame:
    """The rows of docs with repeated passages cut from their text, and `size` counted anew.

    A span that begins or ends within a character gives that character back, so texts stay valid.
    Documents that lose all their bytes stay, with an empty text; null texts stay null. Rows with a
    null id stay as they are, repeated rows are cut alike, an empty table gives no rows.
    """
    others = [c for c in docs.columns if c != text]

    def finish(keys: list, bodies: list[bytes], rest: pa.Array, found: list[np.ndarray]) -> pa.Table:
        return pa.table([rest, pa.array([kept_text(b, s) for b, s in zip(bodies, found, strict=True)], pa.binary())], names=["rest", "kept"])

    result = removal(docs, finish, lambda rest: StructType([rest, StructField("kept", BinaryType())]), window, gram, text, key, carry=others)
    new = F.when(F.col("rest.known"), F.col("kept").cast("string"))
    columns = {c: F.col("rest")[f"of_{c}"] for c in others} | {text: new}
    if size in others:
        columns[size] = F.when(F.col("rest.known"), F.length(new).cast(docs.schema[size].dataType)).otherwise(columns[size])
    return result.select(*[columns[c].alias(c) for c in docs.columns])
