"""Sharding along a Hilbert curve over several metadata dimensions (operator 1).

Each dimension is quantised to a few bits: strings by equal depth (the share of rows with a smaller
value), sizes by octaves of eight steps. The curve index of the cell orders the rows, so a run of
rows is narrow in every dimension, and files cut from the runs can be pruned by any of them. All of
it is DataFrame operations; no row set is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 8


def curve_states(dims: int) -> tuple[list[int], list[int]]:
    """The curve as an automaton: for state * 2^dims + cell bits, its digit and the next state.

    A state is an entry corner and a direction of the sub-cube (state = direction * 2^dims + corner).
    Cells are visited in the order of the reflected Gray code, turned by the state.
    """
    corners, mask = 1 << dims, (1 << dims) - 1

    def turn(bits: int, by: int) -> int:
        by %= dims
        return (bits << by | bits >> (dims - by)) & mask

    def order_of(gray: int) -> int:
        rank = 0
        while gray:
            rank ^= gray
            gray >>= 1
        return rank

    def trailing_ones(value: int) -> int:
        return ((value ^ (value + 1)).bit_length() - 1) % dims

    def entry(digit: int) -> int:
        step = 2 * ((digit - 1) // 2)
        return 0 if digit == 0 else step ^ step >> 1

    def direction(digit: int) -> int:
        if digit == 0:
            return 0
        return trailing_ones(digit - 1 if digit % 2 == 0 else digit)

    digits, following = [], []
    for state in range(dims * corners):
        way, corner = divmod(state, corners)
        for bits in range(corners):
            digit = order_of(turn(bits ^ corner, -(way + 1)))
            digits.append(digit)
            next_corner = corner ^ turn(entry(digit), way + 1)
            following.append((way + direction(digit) + 1) % dims * corners + next_corner)
    return digits, following


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position of a cell on the curve; cells are integers below 2^bits, most significant bit first."""
    dims = len(cells)
    digits, following = curve_states(dims)
    digit, after = (F.array(*map(F.lit, values)) for values in (digits, following))

    def step(held: Column, bit: Column) -> Column:
        at = held["state"] * (1 << dims)
        for i, cell in enumerate(cells):
            at = at + F.call_function("shiftright", cell, bit).bitwiseAND(1) * (1 << (dims - 1 - i))
        return F.struct(F.get(after, at).alias("state"), (held["index"] * (1 << dims) + F.get(digit, at)).cast("long").alias("index"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.array(*[F.lit(b) for b in reversed(range(bits))]), start, step)["index"]


def octave_cell(size: Column) -> Column:
    """Cell of a size of 8 or more: eight steps to each doubling, 255 at most."""
    octave = F.length(F.bin(size)) - 4
    step = F.floor(size / F.pow(F.lit(2), octave)).cast("int").bitwiseAND(7)
    return F.least(F.lit(255), octave * 8 + step).cast("int")


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in partitions by range of the order columns, with part and row (its place in the part),
    checkpointed, so that later reads see the same parts."""
    at = F.monotonically_increasing_id()
    # The id holds the partition above bit 33 and the row below it.
    placed = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).withColumn("at", at)
    return cut(placed).withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND((1 << 33) - 1)}).drop("at")


def before_parts(parts: DataFrame, amount: Column) -> DataFrame:
    """(part, before): the amount in all parts before; one row for each partition of ranged()."""
    sums = parts.groupBy("part").agg(amount.alias("amount"))
    return sums.select("part", (F.sum("amount").over(Window.orderBy("part")) - F.col("amount")).alias("before"))


def equal_depth(values: DataFrame, column: str, n: str, total: int, bits: int = BITS) -> DataFrame:
    """(column, cell): the share of rows with a smaller value, in 2^bits steps; nulls come first."""
    counts = ranged(values.groupBy(column).agg(F.sum(n).alias("n")), [column])
    smaller = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    return counts.join(F.broadcast(before_parts(counts, F.sum("n"))), "part").select(column, F.floor(smaller * (1 << bits) / total).cast("int").alias("cell"))


def hilbert_ranks(docs: DataFrame, strings: list[str], text: str = "text", key: str = "doc_id") -> tuple[DataFrame, int]:
    """Every row's key, size, text_crc32, curve index and place (from 0) on the curve; row count.

    The dimensions are the string columns and the size. Null strings lie before all others, a null
    text counts as empty, equal indexes are ordered by key; repeated rows take places of their own.
    """
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(key).alias("key"), (bytes_ + 8).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        *[F.col(c).cast("string").alias(f"dim{i}") for i, c in enumerate(strings)],
    ).withColumn("size_cell", octave_cell(F.col("size")))
    dims = [f"dim{i}" for i in range(len(strings))]
    rows = cut(rows)
    combined = cut(rows.groupBy(*dims, "size_cell").agg(F.count("*").alias("n")))
    total = combined.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total == 0:
        return rows.select("key", "size", "text_crc32", F.lit(0).cast("long").alias("hilbert_index"), F.lit(0).cast("long").alias("place")), 0
    curve = combined
    for i, dim in enumerate(dims):
        cells = equal_depth(combined, dim, "n", total).select(F.col(dim).alias("value"), F.col("cell").alias(f"cell{i}"))
        curve = curve.join(cells, F.col(dim).eqNullSafe(F.col("value"))).drop("value")
    index = curve_index([*[F.col(f"cell{i}") for i in range(len(dims))], F.col("size_cell")])
    curve = curve.select(*[F.col(d).alias(f"of_{d}") for d in dims], F.col("size_cell").alias("of_size"), index.alias("hilbert_index"))
    same = F.col("size_cell") == F.col("of_size")
    for d in dims:
        same &= F.col(d).eqNullSafe(F.col(f"of_{d}"))
    indexed = ranged(rows.join(curve, same).select("key", "size", "text_crc32", "hilbert_index"), ["hilbert_index", "key", "text_crc32"])
    offsets = before_parts(indexed, F.count("*"))
    return indexed.join(F.broadcast(offsets), "part").select("key", "size", "text_crc32", "hilbert_index", (F.col("before") + F.col("row")).alias("place")), total


def hilbert_shards(docs: DataFrame, shards: int, strings: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Cuts the curve into runs whose row counts are at most one apart.

    Returns key, size, text_crc32, law (`rows`), shard, slot (gapless from 0), grown_shard (null),
    hilbert_index. An empty table gives no rows.
    """
    ranks, total = hilbert_ranks(docs, strings, text, key)
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranks.withColumn("shard", shard.cast("int")).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert_index",
    )


def write_shards(docs: DataFrame, path: str, shards: int, strings: list[str], text: str = "text", key: str = "doc_id") -> None:
    """Writes whole rows as one folder per shard, each sorted by slot. Keys must be unique."""
    placed = hilbert_shards(docs, shards, strings, text, key).select(key, "shard", "slot")
    docs.join(placed, key).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def oracle_sql(shards: int, strings: list[str]) -> str:
    """hilbert_shards() over `documents` as DuckDB SQL."""
    dims = len(strings) + 1
    digits, following = curve_states(dims)
    cells = [*[f"cell{i}" for i in range(dims - 1)], "size_cell"]
    steps, last = [], "combined_cells"
    for b in reversed(range(BITS)):
        bits = " + ".join(f"(({c} >> {b}) & 1) * {1 << (dims - 1 - i)}" for i, c in enumerate(cells))
        steps.append(f"at{b} AS (SELECT *, state * {1 << dims} + {bits} + 1 AS q FROM {last}), to{b} AS (SELECT * EXCLUDE (q, state, idx), t.following[q] AS state, idx * {1 << dims} + t.digits[q] AS idx FROM at{b}, curve_table t_, (SELECT digits, following FROM curve_table) t)".replace(", curve_table t_", ""))
        last = f"to{b}"
    depth = ", ".join(f"depth{i} AS (SELECT {c} AS v, CAST(floor((sum(count(*)) OVER (ORDER BY {c} NULLS FIRST) - count(*)) * {1 << BITS} / (SELECT count(*) FROM documents)) AS INT) AS cell{i} FROM documents GROUP BY {c})" for i, c in enumerate(strings))
    joins = " ".join(f"JOIN depth{i} ON d.{c} IS NOT DISTINCT FROM depth{i}.v" for i, c in enumerate(strings))
    crc = "CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(nibbles) // 2), lambda i: strpos('0123456789ABCDEF', nibbles[2 * i + 1]) * 16 - 16 + strpos('0123456789ABCDEF', nibbles[2 * i + 2]) - 1)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS BIGINT)"
    return f"""
WITH crc_table AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sized AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {", ".join(strings)}, string_split(hex(encode(coalesce(text, ''))), '') AS nibbles FROM documents),
summed AS (SELECT * EXCLUDE (nibbles, t), CASE WHEN size = 8 THEN 0 ELSE {crc} END AS text_crc32 FROM sized, crc_table),
{depth},
curve_table AS (SELECT {digits} AS digits, {following} AS following),
combined_cells AS (SELECT d.doc_id, d.size, d.text_crc32, {", ".join(f"cell{i}" for i in range(dims - 1))}, CAST(least(255, (length(bin(size)) - 4) * 8 + ((size >> (length(bin(size)) - 4)) & 7)) AS INT) AS size_cell, 0 AS state, CAST(0 AS BIGINT) AS idx FROM summed d {joins}),
{", ".join(steps)},
placed AS (SELECT doc_id, size, text_crc32, idx, row_number() OVER (ORDER BY idx, doc_id NULLS FIRST, text_crc32) - 1 AS place, count(*) OVER () AS n FROM {last})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {shards} // n AS INT) AS shard, CAST(place - (place * {shards} // n * n + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, idx AS hilbert_index FROM placed"""
