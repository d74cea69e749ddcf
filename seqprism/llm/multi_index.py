"""Near-duplicate vectors by an inverted multi-index (operator 4).

Two codebooks, one for each half of the normalised vectors, make a grid of cells. Every vector is
held in the cell of its nearest codewords and visits the nearest cells in the order of the
multi-sequence traversal; how many is set on a sample, so that of two vectors at the threshold one
visits the other's cell with the target probability. A cell compares its members with its visitors in
double precision. Cells with very many of either are cut into blocks, and equal vectors are one
vector with a count. What leaves a block is a number of links per vector and a spanning forest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join
from .components import components

#: Vectors that codebooks and visits are fitted on, about, and for each codeword: codewords grow with
#: the square root of the vectors, so the sample does, too, beyond the first number.
SAMPLE, SAMPLE_PER_WORD = 4096, 16
#: Vectors per cell that the number of codewords aims at; members and visitors in one block. Blocks
#: are larger where there are more than 2^30 visits, so that at most some 2^20 cells are cut.
PER_CELL, MEMBERS, VISITORS, CUT_CELLS = 64, 1024, 4096, 1 << 20
RECALL = 0.999


def codebook(points: np.ndarray, words: int, seed: int, rounds: int = 15) -> np.ndarray:
    """k-means from distinct random points; fewer words if there are fewer points."""
    random = np.random.default_rng(seed)
    own = np.unique(points, axis=0)
    centers = own[random.permutation(len(own))[:words]]
    for _ in range(rounds):
        near = distances(points, centers).argmin(axis=1)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, points)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers**2).sum(axis=1)


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide**2).sum(axis=1, keepdims=True))


def nearest_words(d: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the `most` smallest distances of each row, in order; equal ones by index."""
    if most >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    some = np.sort(np.argpartition(d, most, axis=1)[:, :most], axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def codewords(count: int) -> int:
    """Codewords of each half for that many vectors."""
    return max(2, int(np.sqrt(count / PER_CELL)))


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    visits: int

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = self.first.shape[1]
        return distances(vectors[:, :middle], self.first), distances(vectors[:, middle:], self.second)

    def order(self, vectors: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first.

        The pair of the a-th and b-th nearest codeword (from 0) has (a + 1)(b + 1) - 1 pairs before
        it at least, so only pairs with a product within the number of visits can be among them.
        """
        one, two = self.halves(vectors)
        a, b = np.array([(a, b) for a in range(min(visits, one.shape[1])) for b in range(min(visits // (a + 1), two.shape[1]))]).T
        by_one, by_two = nearest_words(one, visits), nearest_words(two, visits)
        total = np.take_along_axis(one, by_one, 1)[:, a] + np.take_along_axis(two, by_two, 1)[:, b]
        best = np.argsort(total, axis=1, kind="stable")[:, :visits]
        return by_one[np.arange(len(vectors))[:, None], a[best]] * two.shape[1] + by_two[np.arange(len(vectors))[:, None], b[best]]


def fit(sample: np.ndarray, count: int, threshold: float, seed: int = 1) -> Index:
    """Codebooks, and the visits at which random pairs at the threshold are met with RECALL."""
    middle = sample.shape[1] // 2 or 1
    words = codewords(count)
    index = Index(codebook(sample[:, :middle], words, seed), codebook(sample[:, middle:] if sample.shape[1] > 1 else sample[:, :0], words, seed + 1), 1)
    random = np.random.default_rng(seed)
    own = sample[random.integers(0, len(sample), 4000)]
    other = random.normal(size=own.shape)
    other -= (other * own).sum(axis=1, keepdims=True) * own
    other /= np.maximum(np.sqrt((other**2).sum(axis=1, keepdims=True)), 1e-12)
    other = threshold * own + np.sqrt(1 - threshold**2) * other
    cells = len(index.first) * len(index.second)

    def rank(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        one, two = index.halves(x)
        home = index.order(y, 1)[:, 0]
        at, by = np.divmod(home, len(index.second))
        rows = np.arange(len(x))
        own_total = one[rows, at] + two[rows, by]
        # Cells before: for each codeword of one half, how many of the other are near enough.
        two_sorted = np.sort(two, axis=1)
        before = np.zeros(len(x), np.int64)
        for k in range(one.shape[1]):
            before += np.array([np.searchsorted(t, limit) for t, limit in zip(two_sorted, own_total - one[:, k], strict=True)])
        return before

    met = np.minimum(rank(own, other), rank(other, own))
    index.visits = int(min(cells, np.quantile(met, RECALL) + 2))
    return index


def _vectors(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.asarray(batch.column(at).flatten(), np.float32).reshape(len(batch), -1)


def _tally(index: Index):
    """(cell, role, n): members (role 0) and visitors (role 1) of the cells."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            seen = index.order(unit(_vectors(batch, 2)), index.visits)
            for role, cells in ((0, seen[:, 0]), (1, seen.ravel())):
                own, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(np.full(len(own), role, np.int32)), pa.array(n.astype(np.int64))], names=["cell", "role", "n"])

    return run


def _deal(index: Index, blocks: dict[tuple[int, int], int]):
    """Bundles of members and visitors for every block of a cell."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            raw, node, count = _vectors(batch, 2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            seen = index.order(unit(raw), index.visits)
            out = []
            for role, cells, rows in ((0, seen[:, 0], np.arange(len(raw))), (1, seen.ravel(), np.repeat(np.arange(len(raw)), seen.shape[1]))):
                order = np.argsort(cells, kind="stable")
                cells, rows = cells[order], rows[order]
                for own in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(cells)) + 1):
                    cell = int(cells[own[0]])
                    mine, others = blocks.get((cell, role), 1), blocks.get((cell, 1 - role), 1)
                    part = (node[rows[own]].view(np.uint64) >> np.uint64(7)) % np.uint64(mine)
                    for p in np.unique(part).tolist():
                        chosen = rows[own[part == p]]
                        for o in range(others):
                            low, high = (p, o) if role == 0 else (o, p)
                            out.append((cell, int(low), int(high), role, node[chosen].tobytes(), count[chosen].tobytes(), raw[chosen].tobytes()))
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cell", "members", "visitors", "role", "nodes", "counts", "vectors"])

    return run


def _compare(index: Index, dims: int, threshold: float):
    def run(bundles: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for role in (0, 1):
            own = bundles[bundles["role"] == role]
            node, count = (np.frombuffer(b"".join(own[c]), np.int64) for c in ("nodes", "counts"))
            order = np.argsort(node, kind="stable")
            vectors = np.frombuffer(b"".join(own["vectors"]), np.float32).reshape(-1, dims)
            sides.append((node[order], count[order], unit(vectors[order]) if len(order) else vectors))
        (member, member_count, held), (visitor, visitor_count, came) = sides
        if not len(member) or not len(visitor):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        near = (came @ held.T >= threshold) & (visitor[:, None] != member)
        # A pair is met once more if the member visits the visitor's cell: each is then counted there.
        came_from = index.order(came, 1)[:, 0]
        homes, home = np.unique(came_from, return_inverse=True)
        goes = (index.order(held, index.visits)[:, :, None] == homes).any(axis=1) if len(homes) <= 64 else np.stack([np.isin(homes, row) for row in index.order(held, index.visits)])
        once = near & ~goes[:, home].T
        to_visitor = near @ member_count
        to_member = once.T @ visitor_count
        # A spanning forest of the block's links: least labels along links until nothing changes.
        none = np.iinfo(np.int64).max
        by_visitor, by_member = visitor.copy(), member.copy()
        while True:
            new_visitor = np.minimum(by_visitor, np.where(near, by_member, none).min(axis=1))
            new_member = np.minimum(by_member, np.where(near, new_visitor[:, None], none).min(axis=0))
            if (new_visitor == by_visitor).all() and (new_member == by_member).all():
                break
            by_visitor, by_member = new_visitor, new_member
        a, b = np.concatenate([visitor, member]), np.concatenate([by_visitor, by_member])
        links = np.concatenate([to_visitor, to_member])
        keep = (a != b) | (links > 0)
        return pd.DataFrame({"a": a[keep], "b": b[keep], "links": links[keep]})

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Per row: key, n_links, component_id, kept.

    n_links: other rows with a cosine of `threshold` or more; component_id: the smallest key
    reachable by links, its own included. Vectors that are null, empty, zero or hold null or
    non-finite components have no links, nor have rows with a null key. Vectors of different lengths
    have no cosine: each length has an index of its own (and its own few jobs). Repeated rows count as
    rows; an empty table gives no rows.
    """
    column = F.col(vector)
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col(key).isNotNull() & column.isNotNull() & F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))
    own = rows.select(F.col(key).cast("long").alias("key"), column.cast("array<float>").alias("v"), sound.alias("sound"))
    # Equal vectors are told by 128 bits.
    own = own.select("key", "v", "sound", F.when(F.col("sound"), F.struct(F.size("v").alias("dims"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))).alias("node"))
    light = cut(own.select("key", "sound", "node"))
    none = light.where("NOT sound").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    found, total = none, light.count()
    for r in light.where("sound").groupBy("node.dims").agg(F.count("*").alias("n")).orderBy("dims").collect():
        usable = own.where(F.col("sound") & (F.size("v") == r["dims"]))
        placed = _near_of_width(usable, r["dims"], threshold)
        same = light.where(F.col("node.dims") == r["dims"])
        found = found.unionByName(salted_join(same.select("key", "node"), placed, "node", "key", total).select("key", "n_links", "component_id"))
    return found.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def _near_of_width(usable: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(node, n, n_links, component_id) of each distinct vector; usable: key, v, node, all of one length."""
    classes = cut(usable.groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("id", F.monotonically_increasing_id()))
    count = classes.count()
    wanted = max(SAMPLE, SAMPLE_PER_WORD * codewords(count))
    share = min(1 << 20, int(wanted / max(1, count) * (1 << 20)) + 1)
    # About `wanted` vectors reach the driver.
    sample = classes.where(F.pmod(F.col("node.h1"), F.lit(1 << 20)) < share).orderBy("node").select("v").limit(2 * wanted).toPandas()["v"]
    sample = unit(np.stack([np.asarray(v, np.float32) for v in (sample if len(sample) else classes.select("v").limit(1).toPandas()["v"])]))
    index = fit(sample, count, threshold)
    vectors = classes.select(F.col("id").alias("node"), "n", "v")
    largest = max(1, count * (index.visits + 1) // CUT_CELLS)
    limit = F.when(F.col("role") == 0, F.lit(max(MEMBERS, largest))).otherwise(F.lit(max(VISITORS, largest)))
    # Only cells to be cut come to the driver: each has more than `largest` members or visitors.
    tallies = vectors.mapInArrow(_tally(index), "cell long, role int, n long").groupBy("cell", "role").agg(F.sum("n").alias("n"))
    blocks = {(r.cell, r.role): r.parts for r in tallies.where(F.col("n") > limit).select("cell", "role", F.ceil(F.col("n") / limit).cast("int").alias("parts")).collect()}
    shape = "cell long, members int, visitors int, role int, nodes binary, counts binary, vectors binary"
    dealt = vectors.mapInArrow(_deal(index, blocks), shape)
    found = cut(dealt.groupBy("cell", "members", "visitors").applyInPandas(_compare(index, dims, threshold), "a long, b long, links long"))
    linked = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    parts = components(found.select("a", "b")).select(F.col("node").alias("id"), "component")
    joined = cut(classes.select("node", "id", "least", "n").join(linked, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))
    least = cut(joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    placed = salted_join(joined, least, "component", "id", count, "members")
    return cut(placed.select("node", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"))
