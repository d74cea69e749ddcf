"""Workflows from files to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprism.operators import infer
from seqprism.sources import readers


def score_fasta(spark: SparkSession, path: str, coefficients: str, kmin: int, kmax: int, **options) -> DataFrame:
    """(site_id, name, model, logit, prob) of every record of FASTA files under a table of coefficients with
    one column per model. Letters other than A, C, G, T weigh nothing; records shorter than kmin are left out."""
    weights, intercepts = readers.coefficients(spark, coefficients)
    seqs = readers.fasta(spark, path, **options).withColumn("seq", F.upper("seq"))
    return infer.posteriors(seqs, weights, kmin, kmax, intercepts, ("name",), any_letters=True)
