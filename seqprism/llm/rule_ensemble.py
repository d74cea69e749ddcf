"""Quality classifier: a sparse ensemble of conjunctive rules (operator 6).

Shallow trees are boosted on text statistics of a bounded sample of labelled documents; every path of
every tree is a rule, a conjunction of comparisons. A logistic model with an absolute penalty gives
weight to few of the rules, and those are compiled into one Spark column expression: documents are
scored without leaving the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, let

#: Labelled documents that the rules are learnt from, about.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3

#: Characters that are counted, as patterns of one character.
COUNTED = {"symbols": r"[#*$%&|<>]", "exclamations": "!", "uppercase": "[A-Z]", "digits": "[0-9]", "lines": r"\n", "stops": r"[.,;:?]"}
FEATURES = ["n_chars", "n_words", "word_length", "distinct_words", "dup_lines", *COUNTED]


def features(text: Column) -> Column:
    """Struct of doubles, one for each of FEATURES, over the whole text (null: empty)."""

    def of_counts(c: Column) -> Column:
        share = lambda part, of: part / F.greatest(of, F.lit(1.0))
        values = {"n_chars": c["chars"], "n_words": c["words"], "word_length": share(c["chars"], c["words"]), "distinct_words": share(c["distinct"], c["words"]), "dup_lines": share(c["all_lines"] - c["own_lines"], c["all_lines"])}
        values |= {name: share(c[name], c["chars"]) for name in COUNTED}
        return F.struct(*[values[name].cast("double").alias(name) for name in FEATURES])

    def of_text(t: Column) -> Column:
        words = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))).alias("own"))
        lines = lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("own"))
        split = let(F.split(t, r"[\x20\x09-\x0D]+"), words)
        by_line = let(F.filter(F.split(t, "\n"), lambda x: F.length(x) > 0), lines)
        number = lambda x: x.cast("double")
        return let(F.struct(split.alias("w"), by_line.alias("l")), lambda s: F.struct(
            number(F.length(t)).alias("chars"), number(s["w"]["n"]).alias("words"), number(s["w"]["own"]).alias("distinct"), number(s["l"]["n"]).alias("all_lines"), number(s["l"]["own"]).alias("own_lines"),
            *[number(F.regexp_count(t, F.lit(p))).alias(name) for name, p in COUNTED.items()],
        ))

    return let(let(F.coalesce(text, F.lit("")), of_text), of_counts)


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, above, limit): value > limit, or value <= limit."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for feature, above, limit in self.conditions:
            out &= (x[:, feature] > limit) == above
        return out

    def column(self, values: Column) -> Column:
        out = F.lit(True)
        for feature, above, limit in self.conditions:
            value = values[FEATURES[feature]]
            out = out & (value > limit if above else value <= limit)
        return out


@dataclass
class RuleModel:
    offset: float
    rules: list[tuple[Rule, float]]

    def column(self, values: Column) -> Column:
        """Probability of label 1 from a features() struct."""
        total = F.lit(self.offset)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(values), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = self.offset + sum((weight * rule.holds(x) for rule, weight in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, limits: list[np.ndarray], depth: int, path: tuple = ()) -> list[tuple[tuple, float]]:
    """(path, value) of every node below the root of a boosted tree; leaves are those of most depth."""
    leaf = -gradient.sum() / (hessian.sum() + 1.0)
    nodes = [(path, leaf)] if path else []
    if depth == 0 or len(x) < 20:
        return nodes
    best, total_g, total_h = (1e-6, None, 0.0), gradient.sum(), hessian.sum()
    for feature, cuts in enumerate(limits):
        if not len(cuts):
            continue
        place = np.searchsorted(cuts, x[:, feature], side="left")
        g = np.cumsum(np.bincount(place, gradient, len(cuts) + 1))[:-1]
        h = np.cumsum(np.bincount(place, hessian, len(cuts) + 1))[:-1]
        n = np.cumsum(np.bincount(place, minlength=len(cuts) + 1))[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[(n < 5) | (len(x) - n < 5)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), feature, float(cuts[k]))
    _, feature, limit = best
    if feature is None:
        return nodes
    above = x[:, feature] > limit
    for side in (False, True):
        own = above == side
        nodes += grow(x[own], gradient[own], hessian[own], limits, depth - 1, (*path, (feature, side, limit)))
    return nodes


def boosted_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    limits = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    logit, rules = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        nodes = grow(x, p - y, p * (1 - p), limits, DEPTH)
        if not nodes:
            break
        inner = {path[:k] for path, _ in nodes for k in range(1, len(path))}
        for path, value in nodes:
            rule = Rule(tuple(sorted(path)))
            rules.setdefault(rule, None)
            if path not in inner:
                logit += RATE * value * Rule(path).holds(x)
    return list(rules)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Offset and weights by accelerated proximal gradient; the offset isn't penalised."""
    n, k = a.shape
    step = 4.0 / (np.linalg.norm(np.column_stack([np.ones(n), a]), 2) ** 2 / n)
    w, v, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    w[0] = v[0] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(v[0] + a @ v[1:])))
        new = v - step * np.append((p - y).mean(), a.T @ (p - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / t_new * (new - w), t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules and weights; the penalty is the largest whose loss on a third of the rows is near the best."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), [])
    rules = boosted_rules(x, y)
    if not rules:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), [])
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    _, own = np.unique(a, axis=1, return_index=True)
    rules, a = [rules[k] for k in sorted(own)], a[:, sorted(own)]
    test = np.arange(len(y)) % 3 == 0
    losses = []
    penalties = [0.02, 0.01, 0.005, 0.002, 0.001, 0.0005]
    for penalty in penalties:
        offset, w = lasso_logistic(a[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(offset + a[test] @ w))), 1e-9, 1 - 1e-9)
        losses.append(-np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)))
    penalty = next(p for p, loss in zip(penalties, losses, strict=True) if loss <= 1.05 * min(losses) + 1e-4)
    offset, w = lasso_logistic(a, y, penalty, 1500)
    return RuleModel(offset, [(rules[k], float(w[k])) for k in np.flatnonzero(np.abs(w) > 1e-6)])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> RuleModel:
    """Learns from about SAMPLE labelled documents, chosen by a hash of the id, that aren't held out.

    Their statistics alone reach the driver. A document is bad if any of its label rows says 0.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("label_key")).agg(F.min("quality").alias("mark"))
    n = max(1, labels.count())
    part = min(1 << 20, int(SAMPLE / n * (1 << 20)))
    marks = marks.where((id_remainder("label_key", 3) != 1) & (F.pmod(F.xxhash64("label_key"), F.lit(1 << 20)) < part))
    # About SAMPLE ids at most: broadcast, so that no text moves before it is chosen.
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(marks), F.col("key") == F.col("label_key"))
    got = rows.select("key", "mark", features(F.col("text")).alias("f")).select("key", "mark", "f.*").toPandas().sort_values(["key", *FEATURES])
    return fit_rules(got[FEATURES].to_numpy(float), (got["mark"].to_numpy() > 0).astype(float))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, held_out (crc32 of the id modulo 3 is 1), score, predicted.

    Null and empty texts have statistics of 0 and are scored by them; a null key is not held out;
    repeated rows are scored alike; an empty table gives no rows; without labels of both kinds every
    text has the same score.
    """
    model = fit(docs, labels, text, key)
    scored = docs.select(F.col(key).alias(key), let(features(F.col(text)), model.column).alias("score"))
    return scored.select(key, F.coalesce(id_remainder(key, 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that score 0.5 or more, columns as they are. One pass, no shuffle. Nulls, empty
    texts and repeated rows as in judge(); an empty table stays empty."""
    model = fit(docs, labels, text, key)
    return docs.where(let(features(F.col(text)), model.column) >= 0.5)
