"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprism.session import prepare


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut(), in a compressed Parquet table of the shared folder; for wide rows, and for the rounds of
    a loop: a checkpoint keeps what is known of its plan's order and partitions, and that multiplies
    from round to round until planning takes longer than the work."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(rows: DataFrame, side: DataFrame, key: str, spread: str, total: int, n: str = "n") -> DataFrame:
    """rows joined (inner) with side, which has one row for each key and in n how many rows have it.

    Keys of very many rows are cut by a hash of the column `spread`, and their row of side is repeated
    for each cut: no task gets more than about `limit` rows of one key. total: number of rows, so that
    there are 100,000 such keys at most, which are broadcast as two numbers each.
    """
    limit = max(1_000, -(-total // 100_000))
    salts = lambda: F.ceil(F.greatest(F.col(n), F.lit(1)) / limit).cast("int")
    hot = side.where(F.col(n) > limit).select(F.col(key).alias("_hot"), salts().alias("_salts"))
    salt = F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")
    return salted.join(side.withColumn("_salt", F.explode_outer(F.sequence(F.lit(0), salts() - 1))), [key, "_salt"]).drop("_salt")


def text_id(text: Column) -> Column:
    """128 bits that stand for a text (its MD5): at any size no two texts are taken for one."""
    return F.unhex(F.md5(text.cast("binary")))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, inside one expression."""
    return F.transform(F.array(value), body)[0]


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor: the split of labelled rows (a null id gives null)."""
    return F.crc32(F.col(column).cast("string")) % divisor


def by_length(column: pa.Array, most: int = 4096):
    """(rows, matrix of their entries) for each length of the list column's vectors but 0, `most` rows at a time."""
    starts = column.offsets.to_numpy()
    sizes, values = np.diff(starts), column.values.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        for some in np.array_split(rows, -(-len(rows) // most)):
            yield some, values[starts[some][:, None] + np.arange(size)]
