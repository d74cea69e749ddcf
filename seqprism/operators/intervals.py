"""Overlaps of closed intervals on the same chromosome, by bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import cut, sums_before


def overlaps(left: DataFrame, right: DataFrame, bin_size: int, right_prefix: str = "r_") -> DataFrame:
    """All pairs of overlapping rows, columns of right prefixed, and `overlap` (places in common).

    Both sides have chrom, start, end (inclusive). The join is on (chrom, bin); of the bins that a
    pair shares only the first counts, so no pair comes twice and nothing must be made distinct.
    """
    binned = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    b = binned(right)
    b = b.select(*[F.col(c).alias(right_prefix + c) for c in b.columns])
    r = lambda c: F.col(right_prefix + c)
    same = (F.col("chrom") == r("chrom")) & (F.col("_bin") == r("_bin")) & (F.col("start") <= r("end")) & (r("start") <= F.col("end"))
    first = F.col("_bin") == F.floor(F.greatest(F.col("start"), r("start")) / bin_size)
    common = F.least(F.col("end"), r("end")) - F.greatest(F.col("start"), r("start")) + 1
    return binned(left).join(b, same & first).withColumn("overlap", common).drop("_bin", right_prefix + "_bin")


def without_overlap(left: DataFrame, right: DataFrame, bin_size: int, key: str) -> DataFrame:
    """Rows of left that no row of right overlaps; key: unique in left."""
    met = overlaps(left, right, bin_size).select(key).distinct()
    return left.join(met, key, "left_anti")


def covered_share(regions: DataFrame, repeats: DataFrame, bin_size: int, key: str) -> DataFrame:
    """regions with repeat_share: overlapping repeat places by width (0 without any)."""
    sums = overlaps(regions, repeats, bin_size).groupBy(key).agg(F.sum("overlap").alias("_covered"))
    width = F.col("end") - F.col("start") + 1
    return regions.join(sums, key, "left").withColumn("repeat_share", F.coalesce("_covered", F.lit(0)) / width).drop("_covered")


def screen_repeats(regions: DataFrame, repeats: DataFrame, bin_size: int, key: str, most: float = 0.5) -> DataFrame:
    """Regions of which repeats cover no more than `most`."""
    return covered_share(regions, repeats, bin_size, key).where(F.col("repeat_share") <= most).drop("repeat_share")


def random_regions(genome: DataFrame, taken: DataFrame, n: int, width: int, seed: int, oversample: int = 4, screen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """n windows at places uniform over the genome, free of `taken` and of each other.

    Candidate i lies at a place from a hash of (seed, i), so the result depends on nothing else. Of
    two candidates that overlap the one with the smaller number stays (a candidate that lost itself
    still excludes later ones, one that the screen drops doesn't), so more candidates never change what
    was found among fewer. They grow, twofold at least, until n are found or one growth finds none more:
    only then are there fewer than n. genome: chrom, length; one row per chromosome, of any number.
    screen: the rows (id, chrom, start, end) that stay. The n windows found are held as a checkpoint.
    """
    spark = genome.sparkSession
    total = genome.agg(F.sum("length")).first()[0] or 0
    if not total or not n:
        return genome.select(F.lit(0).cast("long").alias("id"), "chrom", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).limit(0)
    # Chromosomes by the bins of the whole genome that they reach into: about as many as first candidates.
    tried, upto, held = 0, n * oversample, -1
    size = -(-total // upto)
    spread = sums_before(genome.where("length > 0").select("chrom", "length"), [F.col("chrom")], "length", "first")
    binned = cut(spread.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("first") + F.col("length") - 1) / size)))))
    free = None
    while True:
        more = _free_regions(spark.range(tried, upto), binned, size, taken, total, width, seed)
        more = cut(more if screen is None else screen(more))
        # Of candidates at one place all but the first lose, and exclude no more than it does.
        free = more if free is None else _first_at_place(free.unionByName(more))
        losers = overlaps(free, free, max(width, 1000)).where("r_id < id").select("id").distinct()
        found = cut(free.join(losers, "id", "left_anti").orderBy("id").limit(n))
        number = found.count()
        if number >= n or number == held:
            return found
        # As many more as the share that stayed asks for, twice as many in all at least.
        factor = min(8, max(2, -(-5 * n // (4 * number)))) if number else 8
        tried, upto, held = upto, upto * factor, number


def _free_regions(tried: DataFrame, binned: DataFrame, size: int, taken: DataFrame, total: int, width: int, seed: int) -> DataFrame:
    """The windows of the candidates that lie within a chromosome and are not taken."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    drawn = tried.withColumn("place", number % F.lit(total)).withColumn("_bin", F.floor(F.col("place") / size))
    start = F.col("place") - F.col("first")
    fits = drawn.join(binned, "_bin").where((start >= 0) & (start + width <= F.col("length"))).select("id", "chrom", start.alias("start"))
    return without_overlap(_first_at_place(fits.withColumn("end", F.col("start") + width - 1)), taken, max(width, 1000), "id")


def _first_at_place(regions: DataFrame) -> DataFrame:
    return regions.groupBy("chrom", "start", "end").agg(F.min("id").alias("id")).select("id", "chrom", "start", "end")
