"""Sites as they are trained on: screened, of classes that are large enough, with random regions as a class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprism.config import AnalysisConfig
from seqprism.sources.readers import CHUNK, region_sequences

from . import intervals, labels
from .ranking import cut

#: Places of a bin in which regions and repeats meet.
BIN = 1000


def screen(repeats: DataFrame, chunks: DataFrame, most: float, chunk: int = CHUNK) -> Callable[[DataFrame], DataFrame]:
    """Of regions (id, chrom, start, end) those that repeats cover by `most` at most and that have no N."""

    def kept(regions: DataFrame) -> DataFrame:
        few = intervals.screen_repeats(regions, repeats, BIN, "id", most)
        return region_sequences(few, chunks, chunk).where(~F.contains(F.upper("seq"), F.lit("N"))).drop("seq")

    return kept


def random_sites(sites: DataFrame, genome: DataFrame, chunks: DataFrame, config: AnalysisConfig, repeats: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(site_id, chrom, start, end, annotation, seq): as many windows as the smallest class has sites, free of
    all sites and of each other, labelled `Random`; fewer where the genome has no more room. Their ids are
    -1, -2 and so on by candidate. With repeats they are screened. genome: chrom, length; chunks: its
    letters; sites have chrom, start, end."""
    kept = screen(repeats, chunks, config.max_repeat_share, chunk) if repeats is not None else None
    found = intervals.random_regions(genome, sites.select("chrom", "start", "end"), labels.smallest(sites), config.window, config.seed, screen=kept)
    return region_sequences(found, chunks, chunk).select((-1 - F.col("id")).alias("site_id"), "chrom", "start", "end", F.lit(labels.BACKGROUND).alias("annotation"), F.upper("seq").alias("seq"))


def training_sites(sites: DataFrame, config: AnalysisConfig, genome: DataFrame | None = None, chunks: DataFrame | None = None, repeats: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(site_id, chrom, start, end, annotation, seq) by the options of config, in this order: sites that
    repeats cover too far go (screen_repeats), small classes merge into others (merge_low) or go, random
    regions come in (random_regions), classes named like a label get another name.

    sites: the same columns; site_id is unique and not negative. Null annotations are a class without a name;
    an empty table gives no rows.
    """
    own = sites.select("site_id", "chrom", "start", "end", "annotation", "seq")
    if config.screen_repeats:
        if repeats is None:
            raise ValueError("screen_repeats needs the places of repeats")
        own = intervals.screen_repeats(own, repeats, BIN, "site_id", config.max_repeat_share)
    if config.merge_low:
        own = labels.merge_low(own, config.min_subclass, config.seed).withColumn("annotation", F.col("merged")).drop("merged")
    else:
        own = labels.keep_frequent(own, config.min_subclass)
    if config.random_regions:
        if genome is None or chunks is None:
            raise ValueError("random_regions needs a genome and its letters")
        # Candidates are drawn in rounds, which all read these.
        own, chunks = cut(own), cut(chunks)
        repeats = cut(repeats) if config.screen_repeats else None
        columns = own.columns
        own = own.unionByName(random_sites(own, genome, chunks, config, repeats, chunk).select(columns))
    return labels.renamed(own)
