"""Toxic passages as maximal scoring segments of token log-odds (operator 10).

The numbers of toxic and clean training texts with each token give its log-odds, with a Dirichlet
prior that expects the token in both kinds alike; a score is what is left of the log-odds after two
of its standard deviations, so that each token counts as far as it is certain, for or against. Equal
texts count once, and so does a token that a text repeats. Every token costs a small drift besides. A
linear-time scan finds every maximal scoring segment of a text. Under chance, segments that score S
or more occur in m tokens about K m exp(-lambda S) times: their scores above a threshold are
exponential with the rate lambda, and K comes from how many of them all clean texts have, those with
none included. A segment counts with -log of how many as good its text's number of tokens gives by
chance, where that is positive: what chance gives in a long text counts no more than in a short one. A
document's strength is the logarithm of the sum, and its score a logistic function of it.

Three folds of the training texts are scored by the tokens of the other two, and threshold, lambda, K
and the logistic function come from these scores: no text rates tokens that it chose itself.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, stored

#: Labelled documents of each kind that are learnt from, about; chosen by a hash of the id.
SAMPLE_DOCUMENTS = 20_000
#: Prior texts with a token, standard deviations taken off its log-odds, cost of each token.
PRIOR, DOUBT, DRIFT = 3.0, 2.0, 0.1
FOLDS = 3
#: Share of clean segments below the threshold of the extreme-value fit.
COMMON = 0.9

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


@dataclass
class SegmentModel:
    scores: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    scale: float = 1.0  # lambda
    log_k: float = 0.0
    offset: float = -20.0
    slope: float = 0.0

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(first token, end, score) of every maximal scoring segment."""
        get = self.scores.get
        return maximal_segments([(i, s) for i, w in enumerate(words) if (s := get(w)) is not None])

    def significance(self, score: float, n_tokens: int) -> float:
        """-log of the expected number of segments this good in that many tokens of clean text."""
        return self.scale * score - self.log_k - np.log(max(n_tokens, 1))

    def strength(self, scores: list[float], n_tokens: int) -> float:
        """Logarithm of (one more than) the sum of the segments' positive significances."""
        return float(np.log1p(sum(max(0.0, self.significance(s, n_tokens)) for s in scores)))

    def probability(self, strength: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.offset + self.slope * strength, -40, 40))))


def maximal_segments(scored: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence in which the listed (place, log-odds) tokens differ
    from 0 and every token costs DRIFT besides.

    A scan over the scored tokens keeps candidates with the running sum before (low) and after (high)
    each; a new one joins the last candidate that began lower if that one ended lower, too. Each join
    removes candidates, so the time is linear.
    """
    found: list[list[float]] = []  # first, end, low, high, index of the nearest candidate with less low
    total, at = 0.0, 0
    for place, odds in scored:
        total -= (place - at) * DRIFT
        at = place + 1
        gain = odds - DRIFT
        if gain <= 0:
            total += gain
            continue
        item = [place, place + 1, total, total + gain, -1]
        total += gain
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= item[2]:
                k = int(found[k][4])
            if k < 0 or found[k][3] >= item[3]:
                item[4] = k
                found.append(item)
                break
            item = [found[k][0], item[1], found[k][2], item[3], -1]
            del found[k:]
    return [(int(a), int(b), high - low) for a, b, low, high, _ in found]


def sampled(docs: DataFrame, labels: DataFrame, text: str, key: str) -> tuple[DataFrame, dict[int, float]]:
    """(text, mark, fold) of the texts to learn from, once each, and the share taken of each kind.

    A text is toxic if any label row of any of its documents says so. At most about SAMPLE_DOCUMENTS
    ids of each kind are taken, so they are broadcast and no text moves before it is chosen.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("label_key")).agg((F.max("toxic") > 0).cast("int").alias("mark"))
    marks = marks.where(id_remainder("label_key", 5) != 0)
    sizes = {r["mark"]: r["n"] for r in marks.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    shares = {k: min(1.0, SAMPLE_DOCUMENTS / n) for k, n in sizes.items()}
    most = F.when(F.col("mark") == 1, F.lit(int(shares.get(1, 0) * (1 << 20)))).otherwise(F.lit(int(shares.get(0, 0) * (1 << 20))))
    chosen = marks.where(F.pmod(F.xxhash64("label_key"), F.lit(1 << 20)) < most)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    own = texts.join(F.broadcast(chosen), F.col("key") == F.col("label_key"))
    once = own.groupBy(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.first("text").alias("text"), F.max("mark").alias("mark"))
    return once.select("text", "mark", F.pmod("h2", F.lit(FOLDS)).cast("int").alias("fold")), shares


def _count(batches):
    for batch in batches:
        counts = Counter()
        for text, mark, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts.update((w, fold, mark) for w in set(tokens(text)))
        columns = zip(*((*k, n) for k, n in counts.items()), strict=True) if counts else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["token", "fold", "mark", "n"])


def certain_odds(toxic: Column, clean: Column, share: float) -> Column:
    """What DOUBT standard deviations leave of a token's log-odds. share: that of toxic ones among all
    (text, token) pairs."""
    a, b = toxic + PRIOR * share, clean + PRIOR * (1 - share)
    odds = F.log(a / share) - F.log(b / (1 - share))
    return F.signum(odds) * F.greatest(F.abs(odds) - DOUBT * F.sqrt(1 / a + 1 / b), F.lit(0.0))


def token_scores(learn: DataFrame) -> list[dict[str, float]]:
    """Scores by all texts but those of each fold, and at last by all texts; tokens without are left
    out. Their number is bounded by the sample's words."""
    counted = learn.select("text", "mark", "fold").mapInArrow(_count, "token string, fold int, mark int, n long")
    cells = [(f, m) for f in range(FOLDS) for m in (0, 1)]
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("mark") == m), F.col("n")).otherwise(0)).alias(f"n{f}_{m}") for f, m in cells]
    counts = stored(counted.groupBy("token").agg(*sums))
    totals = counts.agg(*[F.coalesce(F.sum(f"n{f}_{m}"), F.lit(0)).alias(f"n{f}_{m}") for f, m in cells]).first()
    columns = []
    for left_out in [*range(FOLDS), None]:
        used = [f for f in range(FOLDS) if f != left_out]
        toxic, clean = (sum(totals[f"n{f}_{m}"] for f in used) for m in (1, 0))
        if not toxic or not clean:
            columns.append(F.lit(0.0))
            continue
        of = lambda m, used=used: sum((F.col(f"n{f}_{m}") for f in used), F.lit(0))
        columns.append(certain_odds(of(1), of(0), toxic / (toxic + clean)))
    rows = counts.select("token", F.array(*columns).alias("scores")).where(F.exists("scores", lambda x: x != 0)).toPandas()
    return [{t: float(s[k]) for t, s in zip(rows["token"], rows["scores"], strict=True) if s[k] != 0} for k in range(FOLDS + 1)]


def _fold_segments(scores: list[dict[str, float]]):
    models = [SegmentModel(s) for s in scores]

    def run(batches):
        for batch in batches:
            found, size = [], []
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = tokens(text)
                found.append([s for _, _, s in models[fold].segments(words)])
                size.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64())), pa.array(size, pa.int64())], names=["mark", "segments", "size"])

    return run


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> SegmentModel:
    """The model; without labelled documents of both kinds it rates every text near 0. Null texts,
    labels and keys are left out."""
    chosen, shares = sampled(docs, labels, text, key)
    learn = stored(chosen)
    *folds, whole = token_scores(learn)
    model = SegmentModel(whole)
    if not whole:
        return model
    rated = stored(learn.mapInArrow(_fold_segments(folds), "mark int, segments array<double>, size long"))
    clean = rated.where("mark = 0")
    each = clean.select(F.explode("segments").alias("s"))
    model.threshold = each.agg(F.coalesce(F.percentile_approx("s", COMMON, 10_000), F.lit(0.0))).first()[0]
    over = each.where(F.col("s") > model.threshold).agg(F.count("*").alias("n"), F.avg(F.col("s") - model.threshold).alias("excess")).first()
    size = clean.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    model.scale = 1 / max(over["excess"] or 1.0, 1e-3)
    model.log_k = float(np.log(max(over["n"], 0.5) / max(size, 1)) + model.scale * model.threshold)
    level = F.log(F.greatest(F.col("size"), F.lit(1))) + model.log_k
    total = F.aggregate("segments", F.lit(0.0), lambda held, s: held + F.greatest(s * model.scale - level, F.lit(0.0)))
    rows = rated.select("mark", F.log1p(total).alias("strength")).toPandas()
    mark = rows["mark"].to_numpy() > 0
    weight = np.where(mark, 1 / shares.get(1, 1.0), 1 / shares.get(0, 1.0))
    model.offset, model.slope = logistic(rows["strength"].to_numpy(), mark, weight)
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope (not negative) of a one-variable logistic fit with a slight ridge."""
    center, spread = float(x.mean()), float(x.std()) or 1.0
    design = np.stack([np.ones(len(x)), (x - center) / spread], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 0.1 * np.array([0.0, w[1]])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.1])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(0.0, float(w[1]) / spread)
    return float(w[0]) - slope * center, slope


def score_documents(docs: DataFrame, model: SegmentModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, score (0 to 1), predicted, n_passages (significant ones), worst_score.

    Null and empty texts have no segment, so the score of a text without any; repeated rows are scored
    alike; an empty table gives no rows. No shuffle.
    """

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                words = tokens(t)
                found = [s for _, _, s in model.segments(words)]
                score = model.probability(model.strength(found, len(words)))
                out.append((score, int(score >= 0.5), sum(model.significance(s, len(words)) > 3 for s in found), max(found, default=0.0)))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.int64(), pa.float64()), strict=True))], names=["key", "score", "predicted", "n_passages", "worst_score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, predicted int, n_passages long, worst_score double").withColumnRenamed("key", key)


def toxic_passages(docs: DataFrame, model: SegmentModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, first_token, end_token, passage, score, strength) of every significant toxic passage;
    strength: -log of how many as good clean text of that length would have. Null texts have none."""

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = tokens(t)
                for a, b, s in model.segments(words):
                    if (strength := model.significance(s, len(words))) > 3:
                        keys.append(i)
                        out.append((a, b, " ".join(words[a:b]), s, float(strength)))
            columns = zip(*out, strict=True) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()), strict=True))], names=["key", "first_token", "end_token", "passage", "score", "strength"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, first_token long, end_token long, passage string, score double, strength double").withColumnRenamed("key", key)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """score_documents() by a model of the rows that aren't held out (crc32 of the id modulo 5 is 0). Rows
    with a null key are not held out and teach nothing."""
    scored = score_documents(docs, fit(docs, labels, text, key), text, key)
    return scored.withColumn("held_out", F.coalesce(id_remainder(key, 5) == 0, F.lit(False)))
