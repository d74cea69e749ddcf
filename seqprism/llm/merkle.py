"""Merkle manifest of a dataset: a root for each group and over all, and a proof for each row (operator 12).

Leaves are sorted by range of (group, order). The numbers of rows of each group in each partition tell
where a partition's first group goes on from, so every row has its place in its group, and each task
builds the complete aligned subtrees of its run. The ragged nodes at the borders, a few for each
partition, are shuffled by the coordinate of the aligned block of SPAN levels that they are in; each
block is finished by itself, and its top is a node of the next round. Proofs come down the same way.
The roots of all groups are the leaves of one more tree, built by the same code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_remainder, stored

#: Children of a node; levels that are finished at once, and so leaves of an aligned block.
ARITY, SPAN = 8, 5

Levels = list[dict[int, str]]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(levels: Levels, full: Callable[[int, list[int]], bool], single: Callable[[int], bool]) -> None:
    """Adds the parents of all full runs, level by level, until a level is the group's only node."""
    for level in range(len(levels) - 1):
        if single(level):
            return
        own = levels[level]
        for parent, run in groupby(sorted(own), key=lambda i: i // ARITY):
            if full(level, run := list(run)):
                levels[level + 1][parent] = digest("".join(own[i] for i in run))


def local_levels(first: int, leaves: list[str], ends: bool, span: int) -> Levels:
    """Complete nodes over consecutive leaves of one aligned block; `ends`: the last is the group's last."""
    levels: Levels = [dict(enumerate(leaves, first)), *({} for _ in range(span))]
    last = first + len(leaves) - 1

    def full(level: int, run: list[int]) -> bool:
        return run[0] % ARITY == 0 and (len(run) == ARITY or ends and run[-1] == last // ARITY**level)

    climb(levels, full, lambda level: ends and last < ARITY**level)
    return levels


def loose(levels: Levels) -> list[tuple[int, int]]:
    """(level, index) of the nodes whose parent isn't among the levels."""
    return [(level, i) for level, own in enumerate(levels) for i in own if level + 1 == len(levels) or i // ARITY not in levels[level + 1]]


def block_levels(nodes: list[tuple[int, int, str]], block: int, span: int) -> Levels:
    """All levels of an aligned block, from the ragged nodes that cover it. A first block that ends with
    one node below the top level is the whole group."""
    levels: Levels = [{} for _ in range(span + 1)]
    for level, index, held in nodes:
        levels[level][index] = held
    climb(levels, lambda level, run: True, lambda level: block == 0 and len(levels[level]) == 1 and not any(levels[level + 1 :]))
    return levels


def paths(levels: Levels, upper: Callable[[int, int], list[str]]) -> Callable[[int, int], list[str]]:
    """The path of a node: digests before and after it in its run, in turn, level by level; above the
    highest node at hand follows upper()."""
    known: dict[tuple[int, int], list[str]] = {}

    def path(level: int, index: int) -> list[str]:
        if (level, index) not in known:
            if level + 1 == len(levels) or index // ARITY not in levels[level + 1]:
                known[level, index] = upper(level, index)
            else:
                own, first = levels[level], index - index % ARITY
                sides = [range(first, index), range(index + 1, first + ARITY)]
                known[level, index] = ["".join(own.get(i, "") for i in side) for side in sides] + path(level + 1, index // ARITY)
        return known[level, index]

    return path


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and the siblings of its path give."""
    for before, after in zip(path[::2], path[1::2], strict=True):
        leaf = digest(before + leaf + after)
    return leaf


def chunks(batches, offsets: dict[int, tuple[int, bool]], span: int) -> Iterator[tuple[int, str, int, list[tuple], bool]]:
    """(bundle, group, first index, rows, ends) of the runs of one group in one aligned block.

    Rows begin with (at, group, leaf). offsets: for a partition, leaves of its first group before it and
    whether its last group goes on. Bundles take runs until they have a block's number of rows.
    """
    block = ARITY**span
    held: list[tuple] = []
    part = group = None
    index = number = size = 0
    goes_on = False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part is None:
                part, group = row[0] >> 33, row[1]
                index, goes_on = offsets.get(part, (0, False))
            if held and (row[1] != group or index % block == 0):
                yield part << 33 | number, group, index - len(held), held, row[1] != group
                size += len(held)
                if size >= block:
                    number, size = number + 1, 0
                held = []
            if row[1] != group:
                group, index = row[1], 0
            held.append(row)
            index += 1
    if held:
        yield part << 33 | number, group, index - len(held), held, not goes_on


@dataclass
class Tree:
    """Sorted leaves, offsets of partitions, and for each ragged node its path up and its group's root."""

    leaves: DataFrame
    offsets: Broadcast
    tops: DataFrame  # group, root
    upper: DataFrame  # bundle, group, level, idx, path, root
    span: int


NODES = "bundle long, group string, level int, idx long, digest string"


def _loose_nodes(offsets: Broadcast, span: int):
    def run(batches):
        for bundle, group, first, rows, ends in chunks(batches, offsets.value, span):
            levels = local_levels(first, [r[2] for r in rows], ends, span)
            own = loose(levels)
            columns = [[bundle] * len(own), [group] * len(own), [n for n, _ in own], [i for _, i in own], [levels[n][i] for n, i in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["bundle", "group", "level", "idx", "digest"])

    return run


def _finish(span: int):
    """One block: for each ragged node its path up to the block's top; the first row leads to the next round."""

    def run(nodes: pa.Table) -> pa.Table:
        own = list(zip(*(nodes.column(c).to_pylist() for c in ("level", "idx", "digest")), strict=True))
        levels = block_levels(own, nodes.column("block")[0].as_py(), span)
        level, index, _ = own[0]
        while level < span and index // ARITY in levels[level + 1]:
            level, index = level + 1, index // ARITY
        path = paths(levels, lambda level, index: [])
        more = {"path": ([path(n, i) for n, i, _ in own], pa.list_(pa.string())), "top": ([levels[level][index]] * len(own), pa.string()), "lead": ([n == 0 for n in range(len(own))], pa.bool_())}
        out = nodes.drop_columns(["digest"])
        for name, (values, kind) in more.items():
            out = out.append_column(name, pa.array(values, kind))
        return out

    return run


def build(leaves: DataFrame, order: list[Column], span: int = SPAN) -> Tree:
    """leaves: group (not null), leaf, and other columns; sorted by group and order, then by leaf.

    Memory: a task holds one block's nodes. Only offsets, two numbers for each partition, reach the
    driver. Leaves that are equal in all of it may be in any partition.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    ranged = leaves.repartitionByRange(F.col("group"), *order, F.col("leaf"), spread).sortWithinPartitions(F.col("group"), *order, F.col("leaf"))
    placed = cut(ranged.select(F.monotonically_increasing_id().alias("at"), "group", "leaf", *[c for c in leaves.columns if c not in ("group", "leaf")]))
    pieces = placed.groupBy("group", F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    by_part = Window.partitionBy("group").orderBy("part")
    told = pieces.select("part", F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("part").over(by_part).isNotNull().alias("goes_on"))
    # A partition's first group alone has rows before it, and its last alone goes on.
    rows = told.where("before > 0 OR goes_on").groupBy("part").agg(F.max("before").alias("before"), F.max("goes_on").alias("goes_on")).collect()
    offsets = leaves.sparkSession.sparkContext.broadcast({r["part"]: (r["before"], r["goes_on"]) for r in rows})
    nodes = stored(placed.select("at", "group", "leaf").mapInArrow(_loose_nodes(offsets, span), NODES))
    rounds = []
    while True:
        block = F.expr(f"idx div CAST(pow({ARITY}, {span} - level) AS BIGINT)").alias("block")
        done = stored(nodes.select("*", block).groupBy("group", "block").applyInArrow(_finish(span), "bundle long, group string, level int, idx long, block long, path array<string>, top string, lead boolean"))
        rounds.append(done)
        nodes = done.where("lead").select(F.lit(None).cast("long").alias("bundle"), "group", F.lit(0).alias("level"), F.col("block").alias("idx"), F.col("top").alias("digest"))
        if not done.agg(F.max("block")).first()[0]:
            break
    tops = nodes.select("group", F.col("digest").alias("root"))
    above = rounds.pop().select("bundle", "group", "level", "idx", "path", F.col("top").alias("root"))
    while rounds:
        higher = above.select("group", F.col("idx").alias("block"), F.col("path").alias("further"), "root")
        above = rounds.pop().join(higher, ["group", "block"]).select("bundle", "group", "level", "idx", F.concat("path", "further").alias("path"), "root")
    return Tree(placed, offsets, tops, above, span)


def prove(tree: Tree, upper: DataFrame, keep: list[str], emit: Callable[[tuple, list[str], str], tuple], names: list[str], kinds: list[str]) -> DataFrame:
    """For each leaf what emit(its columns `keep`, its whole path, root) returns.

    upper: as the tree's, its paths going on as far as wanted. Leaves meet the paths of their bundle,
    which is a bounded number of both.
    """
    offsets, span = tree.offsets, tree.span
    fields = {f.name: f.dataType.simpleString() for f in tree.leaves.schema}
    shape = ", ".join(f"{c} {fields[c]}" for c in ("group", "leaf", *[k for k in keep if k != "leaf"]))

    def place(batches):
        for bundle, _, first, rows, ends in chunks(batches, offsets.value, span):
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array([bundle] * len(rows), pa.int64()), pa.array(range(first, first + len(rows)), pa.int64()), pa.array([ends] * len(rows), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names=["bundle", "idx", "ends", "group", "leaf", *[k for k in keep if k != "leaf"]])

    rest = [k for k in keep if k != "leaf"]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [arrow[fields[c]] for c in ("group", "leaf", *rest)]
    out = pa.schema([(n, arrow[k]) for n, k in zip(names, kinds, strict=True)])

    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        further = {(g, n, i): (p, r) for g, n, i, p, r in zip(*(above.column(c).to_pylist() for c in ("group", "level", "idx", "path", "root")), strict=True)}
        rows = sorted(zip(*(leaves.column(c).to_pylist() for c in ("group", "idx", "ends", "leaf", *rest)), strict=True), key=lambda r: (r[0], r[1]))
        found = []
        for (group, _), some in groupby(rows, key=lambda r: (r[0], r[1] // ARITY**span)):
            own = list(some)
            levels = local_levels(own[0][1], [r[3] for r in own], own[0][2], span)
            roots = {further[group, n, i][1] for n, i in loose(levels)}
            path = paths(levels, lambda level, index, group=group: further[group, level, index][0])
            (root,) = roots
            found += [emit(r[3:], path(0, r[1]), root) for r in own]
        columns = list(zip(*found, strict=True)) if found else [()] * len(out)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    placed = tree.leaves.select("at", "group", "leaf", *rest).mapInArrow(place, f"bundle long, idx long, ends boolean, {shape}")
    cogrouped = placed.groupBy("bundle").cogroup(upper.groupBy("bundle"))
    return cogrouped.applyInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:`, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, changed: dict[str, Column] | None = None, where: Column | None = None, span: int = SPAN) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of the columns in their order. `changed` gives other values of columns for the
    rows of `where`: folded_root is what such a row gives with the siblings of the manifest, and
    verified tells whether that is the root. Nulls are `-` in a leaf; the null group comes first and so
    do null keys; rows of one key are ordered by leaf, so repeated rows have leaves of their own; empty
    and very long texts are hashed like any other; an empty table gives no rows.
    """
    of = {c: F.col(c) for c in columns}
    other = F.when(where, leaf_of([(changed or {}).get(c, of[c]) for c in columns])) if where is not None else F.lit(None).cast("string")
    # A marker before the group's name keeps null apart and first.
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stored(docs.select(named.alias("group"), leaf_of(list(of.values())).alias("leaf"), F.col(key).alias("key"), other.alias("other")))
    tree = build(leaves, [F.col("key").asc_nulls_first()], span)
    tops = build(tree.tops.select(F.lit("").alias("group"), F.col("root").alias("leaf"), F.col("group").alias("name")), [F.col("name").asc()], span)
    over = stored(prove(tops, tops.upper, ["leaf", "name"], lambda r, path, root: (r[1], "\n".join(path), root), ["group", "further", "whole"], ["string", "string", "string"]))
    # A lone group has no levels above it: its path is the empty string.
    further = F.when(F.col("further") == "", F.array().cast("array<string>")).otherwise(F.split("further", "\n"))
    upper = tree.upper.join(over, "group").select("bundle", "group", "level", "idx", F.concat("path", further).alias("path"), F.concat_ws(" ", "root", "whole").alias("root"))

    def emit(row: tuple, path: list[str], roots: str) -> tuple:
        leaf, name, tampered = row
        subroot, root = roots.split(" ")
        folded = fold(tampered or leaf, path)
        return name, leaf, subroot, root, digest("".join(path)), folded, folded == root

    kind = docs.schema[key].dataType.simpleString()
    found = prove(tree, upper, ["leaf", "key", "other"], emit, ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], [kind, *["string"] * 5, "boolean"])
    return found.withColumnRenamed("key", key)


def document_manifest(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """manifest() of documents by lang, with the upper case of every third id's text lost in between."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": lowered}, id_remainder("doc_id", 3) == 0, span)


def oracle_sql(levels: int = 8, group_levels: int = 4) -> str:
    """document_manifest() as DuckDB SQL, for groups of up to 8^levels rows."""
    fields = lambda text: "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ord(CAST(doc_id AS VARCHAR)[i]))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295)"
    steps: list[str] = []

    def tree(name: str, leaves: str, n: int) -> None:
        """Levels of a tree over `leaves` (grp, idx, h, n), and what stands before and after each node."""
        steps.append(f"{name}0 AS (SELECT grp, idx, h, n FROM {leaves})")
        for i in range(n):
            steps.append(f"{name}_run{i} AS (SELECT grp, idx // 8 AS up, list(h ORDER BY idx) AS hs, any_value(n) AS n FROM {name}{i} GROUP BY ALL)")
            steps.append(f"{name}{i + 1} AS (SELECT grp, up AS idx, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 7) // 8 AS n FROM {name}_run{i})")

    def walk(name: str, own: str, n: int, place: str, grp: str) -> str:
        """Folds `own` through the tree, gathering its siblings in proof."""
        for i in range(n):
            before = f"CASE WHEN r.n = 1 THEN '' ELSE array_to_string(r.hs[1:({place} // {8**i}) % 8], '') END"
            after = f"CASE WHEN r.n = 1 THEN '' ELSE array_to_string(r.hs[({place} // {8**i}) % 8 + 2:], '') END"
            folded = f"CASE WHEN r.n = 1 THEN folded ELSE sha256({before} || folded || {after}) END"
            steps.append(f"{own}_{name}{i} AS (SELECT w.* EXCLUDE (folded, proof), {folded} AS folded, proof || {before} || {after} AS proof FROM {own}{'' if i == 0 else f'_{name}{i - 1}'} w JOIN {name}_run{i} r ON r.grp = w.{grp} AND r.up = w.{place} // {8 ** (i + 1)})")
        return f"{own}_{name}{n - 1}"

    steps.append("crc_table AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)")
    steps.append(f"hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {fields('text')} AS h, CASE WHEN {crc} % 3 = 0 THEN {fields('''translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')''')} ELSE {fields('text')} END AS folded FROM documents, crc_table)")
    steps.append("numbered AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n, '' AS proof FROM hashed)")
    tree("t", "numbered", levels)
    steps.append(f"roots AS (SELECT grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n, '' AS grp FROM t{levels})")
    tree("g", "roots", group_levels)
    at = walk("t", "numbered", levels, "idx", "grp")
    steps.append(f"grouped AS (SELECT w.* EXCLUDE (grp, idx, n), r.h AS subroot, r.idx AS spot, '' AS whole FROM {at} w JOIN roots r ON r.name = w.grp)")
    last = walk("g", "grouped", group_levels, "spot", "whole")
    return f"WITH {', '.join(steps)} SELECT doc_id, w.h AS leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified FROM {last} w, g{group_levels} r"
