"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 13).

Every distinct vector is a node. Nearness is the inner product; one more dimension brings all nodes to
the same norm, so that nodes near each other have like products with any query. The graph begins with
the nearest of each node within blocks of some orders by random directions. In each round of the
descent a node sees its neighbours and nodes that it is a neighbour of, and these propose each other:
neighbours of neighbours, joined by Spark. Nodes are numbered along one of the orders, so that a
bucket of consecutive nodes wants much the same vectors, and gets each once.

A query keeps a beam of its best nodes, and in each round goes to the buckets of the best that are not
yet expanded, where their neighbours' vectors are, and comes back with what it likes of these. Products
are in half precision until then; the last beams are scored in double precision on the original
vectors. Hubs are no hot keys: what a node sees in return is bounded before the shuffle, a bucket asks
for a vector once, and one that very many queries go to is copied for parts of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_length, salted_join, stored


@dataclass(frozen=True)
class Settings:
    """Degrees of the graph and widths of the search; the index has every vector whatever they are."""

    #: Neighbours of a node, nodes that it sees in return, proposals to a node from one list, rounds.
    degree: int = 48
    back: int = 32
    proposals: int = 8
    rounds: int = 4
    #: Orders that the graph begins with, digits of each, directions of a digit, rows of a block, nearest of it.
    orders: int = 6
    digits: int = 4
    directions: int = 16
    block: int = 512
    start: int = 32
    #: Nodes of a bucket as a power of two, in the descent and in the graph that is searched, and queries of one.
    bits: int = 10
    graph_bits: int = 8
    query_bits: int = 8
    #: Visits to one copy of a bucket in a round, at least.
    visits: int = 20_000
    #: Best nodes of a query, those expanded in a round, rounds, and nodes that every query begins with.
    beam: int = 160
    expand: int = 50
    searches: int = 4
    entries: int = 256
    #: Best nodes of a query that are scored in double precision.
    verified: int = 64


@dataclass
class Index:
    """members: (class, key); nodes: (node, class, v, half); graph: a row for each bucket, with the
    neighbours of its nodes, both ways, and these neighbours' vectors."""

    members: DataFrame
    nodes: DataFrame
    graph: DataFrame
    settings: Settings


def usable(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, class, v): rows with a key whose vector is not null, empty or zero and has finite entries only.
    Equal vectors are one class, told by its length and 128 bits."""
    column = F.col(vector)
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col(key).isNotNull() & column.isNotNull() & F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))
    # Adding 0 makes one zero of two.
    own = rows.where(sound).select(F.col(key).alias("key"), F.transform(column.cast("array<double>"), lambda x: x + 0.0).alias("v"))
    return own.select("key", F.struct(F.size("v").alias("dims"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).alias("class"), "v")


def norm(v: Column) -> Column:
    """Of the part that the largest entry leaves, so that no square overflows."""
    most = F.array_max(F.transform(v, F.abs))
    return most * F.sqrt(F.aggregate(v, F.lit(0.0), lambda held, x: held + (x / most) * (x / most)))


def _pack(largest: float, s: Settings):
    """Half-precision vectors of norm 1 (the entries over the largest norm, and what that lacks), and a
    code for each order: for each digit the nearest of some random directions."""
    known: dict[tuple[int, int, int], np.ndarray] = {}

    def directions(order: int, digit: int, dims: int) -> np.ndarray:
        if (order, digit, dims) not in known:
            known[order, digit, dims] = np.random.default_rng((order, digit, dims)).normal(size=(dims, s.directions)).astype(np.float32)
        return known[order, digit, dims]

    def run(batches):
        for batch in batches:
            for at, matrix in by_length(batch.column(1)):
                x = matrix / largest
                wide = np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(axis=1)))]).astype(np.float32)
                codes = np.zeros((len(wide), s.orders), np.int64)
                for order in range(s.orders):
                    for digit in range(s.digits):
                        codes[:, order] = codes[:, order] * s.directions + (wide @ directions(order, digit, wide.shape[1])).argmax(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(wide) + 1) * s.orders, pa.int32()), pa.array(codes.ravel()))
                half = pa.array([row.tobytes() for row in wide.astype(np.float16)], pa.binary())
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, half, lists], names=["class", "v", "half", "codes"])

    return run


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of half-precision numbers; shorter ones are filled with zeros, and never meet longer ones."""
    own = [np.frombuffer(v, np.float16) for v in column.to_pylist()]
    out = np.zeros((len(own), max(map(len, own), default=1)), np.float16)
    for row, v in zip(out, own, strict=True):
        row[: len(v)] = v
    return out


def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a list column in a row, and the lengths of the lists."""
    own = table.column(name).combine_chunks()
    return own.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)


def listed(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def best(row: np.ndarray, other: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best of each row, best first, each `other` once (the first of equal ones)."""
    order = np.lexsort((other, row))
    first = np.ones(len(order), bool)
    first[1:] = (row[order][1:] != row[order][:-1]) | (other[order][1:] != other[order][:-1])
    order = order[first]
    order = order[np.lexsort((other[order], -score[order], row[order]))]
    begins = np.concatenate([[True], row[order][1:] != row[order][:-1]]) if len(order) else np.zeros(0, bool)
    begun = np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
    return order[np.arange(len(order)) - begun < most]


EDGES = "node long, nbrs array<long>, scores array<float>"


def _nearest_of_blocks(s: Settings):
    """The nearest of each node among its block: consecutive rows of one length."""

    def emit(nodes: list[int], halves: list[bytes]) -> pa.RecordBatch:
        x = np.stack([np.frombuffer(h, np.float16) for h in halves]).astype(np.float32)
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        most = min(s.start, len(x) - 1)
        places = np.argpartition(-near, most - 1, axis=1)[:, :most] if most else np.zeros((len(x), 0), int)
        sizes = np.full(len(x), most)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), listed(np.array(nodes)[places].ravel(), sizes, pa.int64()), listed(np.take_along_axis(near, places, 1).ravel(), sizes, pa.float32())], names=["node", "nbrs", "scores"])

    def run(batches):
        nodes, halves = [], []
        for batch in batches:
            for node, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if nodes and (len(nodes) == s.block or len(half) != len(halves[0])):
                    yield emit(nodes, halves)
                    nodes, halves = [], []
                nodes.append(node)
                halves.append(half)
        if nodes:
            yield emit(nodes, halves)

    return run


def _first_lists(s: Settings):
    """The best of all orders for each node of a bucket."""

    def run(edges: pa.Table) -> pa.Table:
        other, sizes = flat(edges, "nbrs")
        score, _ = flat(edges, "scores")
        nodes, of = np.unique(edges.column("node").to_numpy(), return_inverse=True)
        row = np.repeat(of, sizes)
        kept = best(row, other, score, s.degree)
        held = np.bincount(row[kept], minlength=len(nodes))
        return pa.table([pa.array(nodes), listed(other[kept], held, pa.int64()), listed(score[kept], held, pa.float32()), listed(np.ones(len(kept), bool), held, pa.bool_())], names=["node", "nbrs", "scores", "fresh"])

    return run


def _propose(s: Settings):
    """Within a bucket: what the nodes that one node sees are to each other. One row for each bucket
    that gets proposals; pairs of two that this node has seen together before are left out."""

    def run(seen: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors.column("node").to_numpy()
        order = np.argsort(ids)
        ids, low = ids[order], vectors.column("low").to_numpy()[order]
        x = matrix(vectors.column("half"))[order]
        other, sizes = flat(seen, "nbrs")
        fresh, _ = flat(seen, "fresh")
        owner = np.repeat(seen.column("node").to_numpy(), sizes)
        # A node that is both a neighbour and seen in return is fresh if either is.
        pick = best(owner, other, fresh.astype(np.float32), len(other))
        by_owner = pick[np.argsort(owner[pick], kind="stable")]
        ends = np.flatnonzero(np.diff(owner[by_owner])) + 1
        to, of, score = [], [], []
        for own in np.split(by_owner, ends):
            if not len(own):
                continue
            places = np.searchsorted(ids, other[own])
            g = x[places].astype(np.float32)
            near = g @ g.T
            new = fresh[own]
            near[~(new[:, None] | new[None, :])] = -np.inf
            np.fill_diagonal(near, -np.inf)
            near[near <= low[places][:, None]] = -np.inf
            most = min(s.proposals, len(own))
            top = np.argpartition(-near, most - 1, axis=1)[:, :most]
            found = np.take_along_axis(near, top, 1)
            a, b = np.nonzero(found > -np.inf)
            to.append(places[a])
            of.append(places[top[a, b]])
            score.append(found[a, b])
        to, of, score = (np.concatenate(c) if c else np.zeros(0, k) for c, k in ((to, np.int64), (of, np.int64), (score, np.float32)))
        pairs, once = np.unique(to * len(ids) + of, return_index=True)
        to, of, score = ids[pairs // max(1, len(ids))], ids[pairs % max(1, len(ids))], score[once]
        # Sorted by receiver, so each bucket is a run.
        home = to >> s.bits
        cuts = np.flatnonzero(np.diff(home)) + 1
        held = np.diff(np.concatenate([[0], cuts, [len(home)]])) if len(home) else np.zeros(0, int)
        dest = home[np.concatenate([[0], cuts])] if len(home) else home
        return pa.table([pa.array(dest, pa.int64()), listed(to, held, pa.int64()), listed(of, held, pa.int64()), listed(score, held, pa.float32())], names=["bucket", "to", "of", "score"])

    return run


def _accept(s: Settings):
    """The best of a node's neighbours and what is proposed to it; the latter are fresh."""

    def run(nodes: pa.Table, proposed: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node")
        ids = nodes.column("node").to_numpy()
        other, sizes = flat(nodes, "nbrs")
        score, _ = flat(nodes, "scores")
        to, of, new = (flat(proposed, c)[0] for c in ("to", "of", "score"))
        row = np.concatenate([np.repeat(np.arange(len(ids)), sizes), np.searchsorted(ids, to)]).astype(np.int64)
        others = np.concatenate([other, of]).astype(np.int64)
        fresh = np.arange(len(row)) >= len(other)
        # Of equal pairs the one that is there already comes first.
        kept = best(row, others, scores := np.concatenate([score, new]).astype(np.float32), s.degree)
        held = np.bincount(row[kept], minlength=len(ids))
        return nodes.select(["node", "half"]).append_column("nbrs", listed(others[kept], held, pa.int64())).append_column("scores", listed(scores[kept], held, pa.float32())).append_column("fresh", listed(fresh[kept], held, pa.bool_()))

    return run


STATE = "node long, half binary, nbrs array<long>, scores array<float>, fresh array<boolean>"


def seen_in_return(state: DataFrame, s: Settings, order: list[Column], extra: str) -> DataFrame:
    """(node, nbrs, extra): for each node the first `back` of those whose neighbour it is.

    The bound holds before the shuffle, too: a task sends that many for each node at most.
    """
    edges = state.select(F.col("node").alias("of"), F.explode(F.arrays_zip("nbrs", "scores", "fresh")).alias("e"))
    edges = edges.select(F.col("e.nbrs").alias("node"), "of", F.col("e.scores").alias("score"), F.col("e.fresh").alias("fresh"))
    placed = edges.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("place") <= s.back)
    return placed.groupBy("node").agg(F.collect_list("of").alias("nbrs"), F.collect_list("score" if extra == "scores" else extra).alias(extra))


def lists_and_vectors(state: DataFrame, s: Settings, bits: int, order: list[Column], extra: str) -> tuple[DataFrame, DataFrame]:
    """By bucket (`place`): what its nodes see, and (by `bucket`) the vectors of all that, each once."""
    back = seen_in_return(state, s, order, extra)
    seen = state.select("node", "nbrs", extra).unionByName(back).select(F.shiftright("node", bits).alias("place"), "node", "nbrs", extra).repartition("place")
    low = F.when(F.size("scores") >= s.degree, F.array_min("scores")).otherwise(F.lit(float("-inf")).cast("float")).alias("low")
    wanted = seen.select(F.col("place").alias("bucket"), F.explode("nbrs").alias("node")).distinct()
    return seen, wanted.join(state.select("node", "half", low), "node")


def descend(state: DataFrame, s: Settings, number: int) -> DataFrame:
    """One round: neighbours of neighbours propose each other, and every node takes the best."""
    seen, vectors = lists_and_vectors(state, s, s.bits, [F.desc("fresh"), F.xxhash64(F.lit(number), "of", "node").asc(), F.col("of").asc()], "fresh")
    proposed = seen.groupBy("place").cogroup(vectors.groupBy("bucket")).applyInArrow(_propose(s), "bucket long, to array<long>, of array<long>, score array<float>")
    own = state.select("*", F.shiftright("node", s.bits).alias("place"))
    return stored(own.groupBy("place").cogroup(proposed.groupBy("bucket")).applyInArrow(_accept(s), STATE))


GRAPH = "bucket long, width int, ids binary, halves binary, nodes binary, sizes binary, nbrs binary"


def _bundle(seen: pa.Table, vectors: pa.Table) -> pa.Table:
    """A bucket in one row: ids and vectors of the neighbours, and for each of its nodes their places there."""
    ids = vectors.column("node").to_numpy()
    order = np.argsort(ids)
    ids, x = ids[order], matrix(vectors.column("half"))[order]
    other, sizes = flat(seen, "nbrs")
    owner = np.repeat(seen.column("node").to_numpy(), sizes)
    pairs = np.unique(np.stack([owner, other]), axis=1)
    nodes, held = np.unique(pairs[0], return_counts=True)
    places = np.searchsorted(ids, pairs[1])
    # Vectors of different lengths are never neighbours, so the filling meets none of its length.
    row = [seen.column("place")[0].as_py(), x.shape[1], ids.tobytes(), x.tobytes(), nodes.tobytes(), held.astype(np.int64).tobytes(), places.astype(np.int64).tobytes()]
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["bucket", "width", "ids", "halves", "nodes", "sizes", "nbrs"])


def build(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", settings: Settings | None = None) -> Index | None:
    """The graph over all usable vectors; None if there is none."""
    s = settings or Settings()
    own = usable(rows, vector, key)
    members = stored(own.select("class", "key").distinct())
    classes = own.groupBy("class").agg(F.first("v").alias("v"))
    largest = own.agg(F.max(norm(F.col("v")))).first()[0]
    if largest is None:
        return None
    hashes = "struct<dims:int,h1:bigint,h2:bigint>"
    packed = classes.mapInArrow(_pack(largest, s), f"class {hashes}, v array<double>, half binary, codes array<long>")
    along = lambda code: [F.col("class.dims"), code, F.col("class.h1")]
    nodes = stored(packed.repartitionByRange(*along(F.col("codes")[0])).sortWithinPartitions(*along(F.col("codes")[0])).withColumn("node", F.monotonically_increasing_id()))
    first = None
    for order in range(s.orders):
        placed = nodes.select("node", "half", F.col("class"), F.col("codes")[order].alias("code"))
        found = placed.repartitionByRange(*along(F.col("code"))).sortWithinPartitions(*along(F.col("code"))).select("node", "half").mapInArrow(_nearest_of_blocks(s), EDGES)
        first = found if first is None else first.unionByName(found)
    lists = first.groupBy(F.shiftright("node", s.bits)).applyInArrow(_first_lists(s), "node long, nbrs array<long>, scores array<float>, fresh array<boolean>")
    state = stored(nodes.select("node", "half").join(lists, "node").select("node", "half", "nbrs", "scores", "fresh"))
    for number in range(s.rounds):
        state = descend(state, s, number)
    seen, vectors = lists_and_vectors(state, s, s.graph_bits, [F.desc("score"), F.col("of").asc()], "scores")
    graph = seen.groupBy("place").cogroup(vectors.groupBy("bucket")).applyInArrow(_bundle, GRAPH)
    return Index(members, nodes.drop("codes"), stored(graph), s)


BEAMS = "query long, bucket long, half binary, beam array<long>, scores array<float>, expanded array<boolean>, next array<long>"


def _chosen(nodes: np.ndarray, scores: np.ndarray, expanded: np.ndarray, s: Settings) -> tuple:
    """The beam after new nodes came, and which of it are expanded next."""
    order = np.lexsort((nodes, -scores))[: s.beam]
    nodes, scores, expanded = nodes[order], scores[order], expanded[order].copy()
    todo = np.flatnonzero(~expanded)[: s.expand]
    expanded[todo] = True
    return nodes, scores, expanded, nodes[todo]


def _begin(entries: list[tuple[int, bytes]], s: Settings):
    """Beams of the nearest entries, and of the query's own node if it has one."""
    groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(h) for _, h in entries}:
        own = [(n, np.frombuffer(h, np.float16)) for n, h in entries if len(h) == size]
        groups[size] = np.array([n for n, _ in own]), np.stack([h for _, h in own]).astype(np.float32)

    def run(batches):
        for batch in batches:
            rows = []
            for query, bucket, half, home in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, x = groups.get(len(half), (np.zeros(0, np.int64), np.zeros((0, len(half) // 2), np.float32)))
                score = x @ np.frombuffer(half, np.float16).astype(np.float32)
                top = np.argsort(-score, kind="stable")[:8]
                ids, score = ids[top], score[top]
                if home is not None and home not in ids:
                    ids, score = np.append(ids, home), np.append(score, np.float32(1.0))
                rows.append((query, bucket, half, *(c.tolist() for c in _chosen(ids.astype(np.int64), score.astype(np.float32), np.zeros(len(ids), bool), s))))
            yield from _beams(rows).to_batches()

    return run


def _beams(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "bucket", "half", "beam", "scores", "expanded", "next"])


def _visit(s: Settings):
    """What queries find at the nodes of a bucket that they expand: for each query one row."""

    def run(visits: pa.Table, bucket: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()))
        out = []
        if len(bucket) and len(visits):
            of = lambda c, kind: np.frombuffer(bucket.column(c)[0].as_buffer(), kind)
            ids, nodes, sizes, nbrs = (of(c, np.int64) for c in ("ids", "nodes", "sizes", "nbrs"))
            x = of("halves", np.float16).reshape(len(ids), bucket.column("width")[0].as_py())
            begin = np.cumsum(sizes) - sizes
            # A node without neighbours has no place in the bucket.
            visits = visits.filter(pa.array(np.isin(visits.column("node").to_numpy(), nodes))).sort_by("query")
            rows = list(zip(*(visits.column(c).to_pylist() for c in ("query", "home", "half", "low")), strict=True))
            at = np.searchsorted(nodes, visits.column("node").to_numpy())
            ends = np.flatnonzero(np.diff(visits.column("query").to_numpy())) + 1
            for own in np.split(np.arange(len(rows)), ends) if rows else ():
                query, home, half, low = rows[own[0]]
                places = np.unique(np.concatenate([nbrs[begin[n] : begin[n] + sizes[n]] for n in at[own]]))
                q = np.frombuffer(half, np.float16).astype(np.float32)
                score = x[places, : len(q)].astype(np.float32) @ q
                top = np.argsort(-score, kind="stable")[: s.beam]
                top = top[score[top] >= low]
                out.append((query, home, ids[places[top]].tolist(), score[top].tolist()))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query", "home", "ids", "scores"])

    return run


def _return(s: Settings):
    """The queries of a bucket with what they found: better nodes enter the beams."""

    def run(queries: pa.Table, found: pa.Table) -> pa.Table:
        came: dict[int, list] = {}
        for query, ids, scores in zip(*(found.column(c).to_pylist() for c in ("query", "ids", "scores")), strict=True):
            came.setdefault(query, []).append((ids, scores))
        out = []
        for query, bucket, half, *held in zip(*(queries.column(c).to_pylist() for c in ("query", "bucket", "half", "beam", "scores", "expanded", "next")), strict=True):
            ids = np.array([*held[0], *(i for own, _ in came.get(query, ()) for i in own)], np.int64)
            scores = np.array([*held[1], *(x for _, own in came.get(query, ()) for x in own)], np.float32)
            expanded = np.concatenate([np.array(held[2], bool), np.zeros(len(ids) - len(held[0]), bool)])
            # The first of equal ids: what the beam has.
            _, once = np.unique(ids, return_index=True)
            out.append((query, bucket, half, *(c.tolist() for c in _chosen(ids[once], scores[once], expanded[once], s))))
        return _beams(out)

    return run


def expand(beams: DataFrame, graph: DataFrame, s: Settings) -> DataFrame:
    """One round of the search. Buckets that more queries go to than `visits`, and a 100,000th of all
    visits, are copied, so that no task gets more of them."""
    low = F.when(F.size("scores") >= s.beam, F.array_min("scores")).otherwise(F.lit(float("-inf")).cast("float"))
    visits = beams.select("query", F.col("bucket").alias("home"), "half", low.alias("low"), F.explode("next").alias("node")).withColumn("to", F.shiftright("node", s.graph_bits))
    counts = stored(visits.groupBy("to").agg(F.count("*").alias("n")))
    limit = max(s.visits, -(-(counts.agg(F.sum("n")).first()[0] or 0) // 100_000))
    copies = counts.where(F.col("n") > limit).select(F.col("to").alias("hot"), F.ceil(F.col("n") / limit).cast("int").alias("copies"))
    salt = F.pmod(F.xxhash64("query"), F.coalesce("copies", F.lit(1))).cast("int")
    salted = visits.join(F.broadcast(copies), F.col("to") == F.col("hot"), "left").withColumn("salt", salt).drop("hot", "copies")
    places = graph.join(counts.select("to"), F.col("bucket") == F.col("to"), "left_semi").join(F.broadcast(copies), F.col("bucket") == F.col("hot"), "left")
    places = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("hot", "copies")
    found = salted.groupBy("to", "salt").cogroup(places.groupBy("bucket", "salt")).applyInArrow(_visit(s), "query long, home long, ids array<long>, scores array<float>")
    return stored(beams.groupBy("bucket").cogroup(found.groupBy("home")).applyInArrow(_return(s), BEAMS))


def _query_halves(batches):
    """Query vectors of norm 1 in half precision; their last entry is 0."""
    for batch in batches:
        for at, x in by_length(batch.column(1)):
            x = x / np.abs(x).max(axis=1, keepdims=True)
            wide = np.column_stack([x / np.sqrt((x**2).sum(axis=1, keepdims=True)), np.zeros(len(x))]).astype(np.float16)
            own = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([row.tobytes() for row in wide], pa.binary()), own.column(2)], names=["query", "half", "home"])


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(query, node, score): the best nodes found of each query, scored on the original vectors.

    queries: query long, v array<double>, home: the node of an equal vector, or null. All are sound.
    """
    s = index.settings
    # A bounded sample of nodes that any query can begin with.
    entries = [(r["node"], bytes(r["half"])) for r in index.nodes.select("node", "half").orderBy(F.xxhash64("node")).limit(s.entries).collect()]
    halves = queries.select("query", "v", "home").mapInArrow(_query_halves, "query long, half binary, home long")
    ordered = halves.repartitionByRange("home", "query").sortWithinPartitions("home", "query")
    dealt = ordered.select("query", F.shiftright(F.monotonically_increasing_id(), s.query_bits).alias("bucket"), "half", "home")
    beams = stored(dealt.mapInArrow(_begin(entries, s), BEAMS))
    for _ in range(s.searches):
        beams = expand(beams, index.graph, s)
    found = beams.select("query", F.explode(F.slice("beam", 1, s.verified)).alias("node"))
    scored = found.join(index.nodes.select("node", F.col("v").alias("other")), "node").join(queries.select("query", "v"), "query")
    product = F.aggregate(F.zip_with("v", "other", lambda x, y: x * y), F.lit(0.0), lambda held, x: held + x)
    return scored.select("query", "node", product.alias("score"))


def nearest_rows(rows: DataFrame, top: int = 20, every: int = 20, vector: str = "embedding", key: str = "vec_id", settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, key, score): of every row whose key is divisible by `every`, the `top` nearest rows found.

    All rows with a key and a sound vector are candidates but those with the query's own key; rows that
    are null, empty, zero or hold null or non-finite entries take no part, nor do rows with a null
    key. Vectors of different lengths have no product. Repeated rows (key and vector) are one, equal
    vectors of different keys are nearest by key; an empty table gives no rows.
    """
    index = build(rows, vector, key, settings)
    kind = rows.schema[key].dataType.simpleString()
    if index is None:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    named = index.members.join(index.nodes.select("class", "node"), "class").select("node", "key")
    asking = stored(named.where(F.col("key") % every == 0))
    queries = stored(asking.select("node").distinct().join(index.nodes.select("node", "v"), "node").select(F.col("node").alias("query"), "v", F.col("node").alias("home")))
    # A key has as many vectors as `own`, so that many entries of a list are the query's own at most.
    own = named.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("key"))).where(F.col("place") <= top + own)
    found = search(index, queries).join(first.select("node", "key"), "node")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    lists = found.withColumn("place", place).where(F.col("place") <= top + own).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "key", "score"))).alias("found"))
    counts = asking.groupBy("node").agg(F.count("*").alias("n"))
    side = lists.select(F.col("query").alias("node"), "found").join(counts, "node")
    total = asking.count()
    answered = salted_join(asking.withColumnRenamed("key", "query_id"), side, "node", "query_id", total)
    others = F.slice(F.filter("found", lambda x: x["key"] != F.col("query_id")), 1, top)
    # A key with several vectors has an answer for each; the best of them together are its answer.
    each = answered.select("query_id", F.explode(others).alias("x")).select("query_id", "x.key", "x.score")
    if own > 1:
        each = each.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), F.col("key").alias(key), "score")
