"""Posteriors of a stream of sequences: per row, without state, so it runs on unbounded input."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprism.functions.sequence import kmer_weight, windows


def score_rows(seqs: DataFrame, weights: dict[str, dict[str, float]], kmin: int, kmax: int, intercepts: dict[str, float] | None = None) -> DataFrame:
    """seqs (with seq) and `posterior`: a map of model to probability.

    weights: model to k-mer to weight, as many literals as the model has coefficients. Works alike on a
    batch and on a stream; rows are scored one by one inside the JVM.
    """
    def logit(model: str) -> Column:
        places = {w: i for i, w in enumerate(w for k in range(kmin, kmax + 1) for w in map("".join, product("ACGT", repeat=k)))}
        filled = [0.0] * len(places)
        for kmer, weight in weights[model].items():
            filled[places[kmer]] = float(weight)
        table = F.array(*map(F.lit, filled))
        total = F.lit(float((intercepts or {}).get(model, 0.0)))
        for k in range(kmin, kmax + 1):
            total = total + F.aggregate(_looked_up(k, table), F.lit(0.0), lambda held, w: held + w)
        return total

    def _looked_up(k: int, table: Column) -> Column:
        return F.transform(windows(F.col("seq"), k), lambda s: kmer_weight(s, k, kmin, table))

    values = [F.struct(F.lit(model).alias("model"), logit(model).alias("logit")) for model in sorted(weights)]
    scored = seqs.withColumn("_logits", F.array(*values))
    highest = F.array_max(F.transform("_logits", lambda x: x["logit"]))
    weighed = scored.withColumn("_highest", highest).withColumn("_parts", F.transform("_logits", lambda x: F.exp(x["logit"] - F.col("_highest"))))
    total = F.aggregate("_parts", F.lit(0.0), lambda held, x: held + x)
    posterior = F.map_from_arrays(F.transform("_logits", lambda x: x["model"]), F.transform("_parts", lambda x: x / F.col("_total")))
    return weighed.withColumn("_total", total).withColumn("posterior", posterior).drop("_logits", "_highest", "_parts", "_total")
