"""Near-duplicates by weighted minwise hashing of word-shingle multisets (operator 8).

Each shingle with its count is a point process: on the plane of time and weight it drops points at
unit rate, each with a register at random, and a document sees the points below the shingle's count.
A register holds the time of its first visible point over all shingles, so two documents agree in a
register with the probability of their weighted Jaccard similarity. The process is hierarchical: the
weight axis is cut at 0, 1, 2, 4, 8, ...; each stretch has one process of its own rate, and only a
stretch that the count cuts is looked into, by the point's place within it. Points beyond the time at
which all registers are surely full are not drawn, so most shingles cost one number.

Registers are banded. Each bucket of a band is linked through its hub, the member with the largest
buckets, and each link is verified on the whole multisets. Buckets whose members are then not all
connected are searched exactly: those outside the bucket's largest component are compared with all
others, in tasks of bounded bytes, through an inverted index of the task's shingles. Buckets, hubs and
copies of very many members are cut into parts wherever they are joined, and a text's identity is
128 bits of it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join, stored, text_id
from .components import components
from .shingles import byte_column, mixed, multisets, occurrence_keys, shingle_hashes, spans, word_hashes

#: At similarity 0.8 a pair shares no band of 26 with 5 registers each once in 30,000 times.
BANDS, ROWS = 26, 5
WORDS, SIMILARITY = 5, 0.8
#: Bytes of shingles of a bucket in one part of its tasks.
PART_BYTES = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _draw(seeds: np.ndarray, number: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(seeds + np.uint64(number + 1) * _ODD)


def signatures(hashes: np.ndarray, doc: np.ndarray, counts: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """First visible times, docs x registers; infinity for a document without shingles."""
    first = np.full((docs, registers), np.inf)
    weight = np.bincount(doc, weights=counts, minlength=docs)
    todo = weight > 0
    reach = math.log(registers) + 6
    while todo.any():
        limit = np.where(todo, registers * reach / np.maximum(weight, 1), -1.0)
        lower, width, stretch = 0, 1, 0
        while True:
            own = np.flatnonzero((counts > lower) & todo[doc])
            if not len(own):
                break
            with np.errstate(over="ignore"):
                seeds = mixed(hashes[own] ^ np.uint64(stretch + 1) * np.uint64(0xD6E8FEB86659FD93))
            owner, room, time, drawn = doc[own], counts[own] - lower, np.zeros(len(own)), 0
            while len(owner):
                uniform = ((_draw(seeds, 2 * drawn) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
                time = time - np.log(uniform) / width
                soon = time <= limit[owner]
                seeds, owner, room, time = seeds[soon], owner[soon], room[soon], time[soon]
                chance = _draw(seeds, 2 * drawn + 1)
                place = chance >> np.uint64(32) & np.uint64(width - 1)
                seen = place.astype(np.int64) < room
                register = ((chance & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(first.reshape(-1), owner[seen] * registers + register[seen], time[seen])
                drawn += 1
            lower, width, stretch = lower + width, max(1, lower + width), stretch + 1
        todo &= np.isinf(first).any(axis=1)
        reach *= 2
    return first


def band_keys(first: np.ndarray) -> np.ndarray:
    """docs x BANDS keys, each of ROWS registers."""
    bits = mixed(np.ascontiguousarray(first).view(np.uint64)).reshape(len(first), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
        for r in range(ROWS):
            key = mixed(key + bits[:, :, r])
    return key


def _shingled(data: np.ndarray, offsets: np.ndarray, a: int, b: int):
    own = offsets[a : b + 1] - offsets[a]
    words, doc = word_hashes(data[offsets[a] : offsets[b]], own[1:])
    return multisets(*shingle_hashes(words, doc, WORDS))


def _bands(batches):
    for batch in batches:
        data, offsets = byte_column(batch.column(1))
        for a, b in spans(np.diff(offsets)):
            hashes, doc, counts = _shingled(data, offsets, a, b)
            first = signatures(hashes, doc, counts, b - a, BANDS * ROWS)
            some = np.flatnonzero(~np.isinf(first[:, 0]))
            keys = band_keys(first[some]).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(some)), bands], names=["node", "bands"])


def _gram_sets(batches):
    for batch in batches:
        data, offsets = byte_column(batch.column(1))
        for a, b in spans(np.diff(offsets)):
            hashes, doc, counts = _shingled(data, offsets, a, b)
            keys, owner = occurrence_keys(hashes, counts), np.repeat(doc, counts)
            keys = keys[np.lexsort((keys, owner))]
            ends = np.cumsum(np.bincount(owner, minlength=b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([k.tobytes() for k in np.split(keys, ends[:-1])], pa.binary())], names=["node", "grams"])


def _verify(batches):
    """Of pairs with both shingle sets, those of enough similarity."""
    for batch in batches:
        good = []
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            small, large = sorted((len(x) // 8, len(y) // 8))
            if small < SIMILARITY * large:
                continue
            joined = np.sort(np.frombuffer(x + y, np.uint64))
            common = int(np.count_nonzero(joined[1:] == joined[:-1]))
            if common >= SIMILARITY * (small + large - common) - 1e-9:
                good.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))], names=["a", "b"])


def verified(pairs: DataFrame, grams: DataFrame, total: int) -> DataFrame:
    """The pairs (node, hub), as links (a, b), whose multisets overlap enough. total: number of pairs."""
    own = pairs.join(grams.select("node", "grams"), "node")
    hubs = pairs.groupBy("hub").agg(F.count("*").alias("n")).join(grams.select(F.col("node").alias("hub"), F.col("grams").alias("hub_grams")), "hub")
    return salted_join(own, cut(hubs), "hub", "node", total).select("node", "hub", "grams", "hub_grams").mapInArrow(_verify, "a binary, b binary")


def cross_links(grams: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between a member in left and one in right (index arrays) of different components, by the
    overlap of their sets of shingles; one into each other component connects as much as all."""
    sizes = np.array([len(g) for g in grams])
    values, number = np.unique(np.concatenate([grams[i] for i in right]), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(number, kind="stable")
    owner, heads = owner[order], np.searchsorted(number[order], np.arange(len(values) + 1))
    out = []
    for i in left.tolist():
        at = np.searchsorted(values, grams[i])
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == grams[i])]
        size = heads[at + 1] - heads[at]
        flat = np.repeat(heads[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        common = np.bincount(owner[flat], minlength=len(right))
        alike = common >= SIMILARITY * (sizes[i] + sizes[right] - common) - 1e-9
        linked = right[alike & (component[right] != component[i])]
        _, one = np.unique(component[linked], return_index=True)
        out += [(i, j) for j in linked[one].tolist()]
    return out


def _search(members: pd.DataFrame) -> pd.DataFrame:
    grams = [np.frombuffer(g, np.uint64) for g in members["grams"]]
    node, other = members["node"].to_numpy(), members["other"].to_numpy()
    component = np.unique(members["component"].to_numpy(), return_inverse=True)[1]
    links = cross_links(grams, component, np.flatnonzero(other), np.flatnonzero(~other)) if other.any() and not other.all() else []
    return pd.DataFrame({"a": [node[i] for i, _ in links], "b": [node[j] for _, j in links]})


def search_tasks(labelled: DataFrame, grams: DataFrame, total: int) -> DataFrame:
    """(band, i, j, node, component, other): what each task of the open buckets compares.

    labelled: band, node, component. In a bucket with more than one component, the members outside the
    largest one (`other`) are dealt into parts i, all members into parts j, of PART_BYTES of shingles
    each; the task (i, j) compares part i of the former with part j of the latter. So a bucket of n
    bytes with m outside makes n * m / PART_BYTES^2 tasks.
    """
    sized = labelled.join(grams.select("node", F.length("grams").cast("long").alias("bytes")), "node")
    kinds = sized.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("content"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("content2"))
    bands = kinds.groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max(F.struct("n", "component", "bytes"))["bytes"].alias("main_bytes"),
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("kinds"), F.bit_xor("content").alias("content"), F.bit_xor("content2").alias("content2"),
    )
    # Buckets with the same members are searched once; two members were compared as hub and member.
    wanted = bands.where("kinds > 1 AND n > 2").groupBy("n", "content", "content2").agg(F.min_by(F.struct("band", "main", "main_bytes", "bytes"), "band").alias("b")).select("b.*", "n")
    parts = lambda size: F.greatest(F.ceil(size / PART_BYTES), F.lit(1)).cast("int")
    wanted = cut(wanted.select("band", "main", "n", parts(F.col("bytes") - F.col("main_bytes")).alias("outside"), parts(F.col("bytes")).alias("whole")))
    members = salted_join(labelled, wanted, "band", "node", total)
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    of = lambda is_other: ("band", "node", "component", F.lit(is_other).alias("other"))
    every = members.withColumns({"i": F.explode_outer(F.sequence(F.lit(0), F.col("outside") - 1)), "j": part("whole")}).select(*of(False), "i", "j")
    few = members.where("component <> main").withColumns({"i": part("outside"), "j": F.explode_outer(F.sequence(F.lit(0), F.col("whole") - 1))}).select(*of(True), "i", "j")
    return every.unionByName(few)


def near_links(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(node, component) of the texts that are linked with another one.

    rows: key, node, bytes; classes: node, class_id. Equal texts have equal bands, so all rows are
    hashed where they are and one row of each text goes on: no text moves for this.
    """
    banded = cut(rows.select("node", "bytes").mapInArrow(_bands, "node binary, bands array<long>").groupBy("node").agg(F.first("bands").alias("bands")))
    members = banded.select("node", F.explode("bands").alias("band"))
    total = banded.count() * BANDS
    shared = cut(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    inside = cut(salted_join(members, shared, "band", "node", total))
    if inside.isEmpty():
        return None
    degree = cut(inside.groupBy("node").agg(F.sum("n").alias("degree")))
    wanted = degree.select("node").join(classes, "node").select("node", F.col("class_id").alias("key"))
    sets = rows.join(wanted, ["node", "key"]).select("node", "bytes").mapInArrow(_gram_sets, "node binary, grams binary")
    grams = stored(sets.groupBy("node").agg(F.first("grams").alias("grams")))

    hubs = cut(inside.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"), F.count("*").alias("n")))
    pairs = cut(salted_join(inside.select("band", "node"), hubs, "band", "node", total).where("node <> hub").select("node", "hub").distinct())
    links = cut(verified(pairs, grams, total))
    found = components(links)
    labelled = cut(inside.select("band", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    tasks = search_tasks(labelled, grams, total)
    last = cut(tasks.join(grams, "node").groupBy("band", "i", "j").applyInPandas(_search, "a binary, b binary"))
    return found if last.isEmpty() else components(links.unionByName(last))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, node (of its text), class_id, component_id and kept.

    class_id: the smallest key with the same text. component_id: the smallest key reachable by links
    of similarity 0.8 or more, its own included; kept: whether that is its own. Texts with fewer than
    five words have one shingle of them all. Null texts and texts without a word are linked with
    nothing, not even with each other; rows with a null key have null ids and are kept.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), filled.cast("binary").alias("bytes"), filled.rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    node = text_id(F.col("bytes"))
    light = cut(rows.select("key", node.alias("node"), (F.col("worded") & F.col("key").isNotNull()).alias("worded")))
    classes = cut(light.where("worded").groupBy("node").agg(F.min("key").alias("class_id"), F.count("*").alias("n")))
    total = light.count()
    found = near_links(rows.where("worded AND key IS NOT NULL").select("key", node.alias("node"), "bytes"), classes)
    if found is None:
        placed = classes.select("node", "class_id", F.col("class_id").alias("component_id"), "n")
    else:
        joined = cut(classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
        least = cut(joined.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count("*").alias("members")))
        placed = salted_join(joined, least, "component", "node", total, "members").select("node", "class_id", "component_id", "n")
    out = salted_join(light.where("worded"), cut(placed), "node", "key", total).select("node", "key", "worded", "class_id", "component_id").unionByName(light.where("NOT worded").select("node", "key", "worded", F.col("key").alias("class_id"), F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), "node", "class_id", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs without near-duplicates: one row of each component stays, columns as they are."""
    verdict = near_duplicates(docs, text, key).where("kept AND class_id IS NOT NULL").groupBy(F.col(key).alias("kept_key"), F.col("node").alias("kept_node")).agg(F.first("component_id").alias("kept_component"))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    filled = F.coalesce(F.col("row")[text], F.lit(""))
    marked = row.select("row", F.col("row")[key].cast("long").alias("key"), text_id(filled).alias("node"), filled.rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    alone = marked.where("NOT worded OR key IS NULL").select("row.*")
    single = marked.where("worded AND key IS NOT NULL").join(verdict, (F.col("key") == F.col("kept_key")) & (F.col("node") == F.col("kept_node")))
    # Repeated rows are one document; those of one key and text are in one partition already.
    return single.dropDuplicates(["key", "node"]).select("row.*").unionByName(alone)
