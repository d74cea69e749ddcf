"""Position weight matrices: consensus, scores, discovery and their test against random sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqprism.config import AnalysisConfig
from seqprism.functions.sequence import canonical, windows

from .labels import without_background
from .ranking import cut

BASES = "ACGT"


def from_windows(rows: DataFrame, by: str = "motif", seq: str = "hill") -> DataFrame:
    """(motif, pos, a, c, g, t): base shares at each place of aligned sequences."""
    # Equal sequences are counted before they are spelled: short ones are few.
    distinct = rows.groupBy(by, seq).agg(F.count("*").alias("_n"))
    placed = distinct.select(by, "_n", F.posexplode(F.split(seq, "")).alias("pos", "base")).where(F.col("base") != "")
    counts = placed.groupBy(by, "pos").agg(F.sum("_n").alias("n"), *[F.sum(F.when(F.col("base") == b, F.col("_n")).otherwise(0)).alias(b) for b in BASES])
    return counts.select(by, "pos", *[(F.col(b) / F.col("n")).alias(b.lower()) for b in BASES])


def consensus(motifs: DataFrame, by: str = "motif") -> DataFrame:
    """(motif, consensus): the likeliest base at each place, the first by letter among equals."""
    best = F.array_min(F.array(*[F.struct((-F.col(b.lower())).alias("p"), F.lit(b).alias("base")) for b in BASES]))["base"]
    letters = motifs.select(by, F.struct("pos", best.alias("base")).alias("at"))
    ordered = F.transform(F.sort_array(F.collect_list("at")), lambda x: x["base"])
    return letters.groupBy(by).agg(F.array_join(ordered, "").alias("consensus"))


def reverse_complement(motifs: DataFrame, by: str = "motif") -> DataFrame:
    width = motifs.groupBy(by).agg((F.max("pos") + 1).alias("width"))
    return motifs.join(width, by).select(by, (F.col("width") - 1 - F.col("pos")).alias("pos"), F.col("t").alias("a"), F.col("g").alias("c"), F.col("c").alias("g"), F.col("a").alias("t"))


def consensus_kmers(consensi: DataFrame, kmin: int, kmax: int, by: str = "motif") -> DataFrame:
    """(motif, kmer): canonical k-mers of each consensus; repeated ones stay repeated."""
    parts = F.concat(*[F.transform(windows(F.col("consensus"), k), canonical) for k in range(kmin, kmax + 1)])
    return consensi.select(by, F.explode(parts).alias("kmer"))


def model_scores(kmers: DataFrame, weights: DataFrame, by: str = "motif") -> DataFrame:
    """(motif, model, score): the sum of a motif's k-mer weights under each model."""
    return kmers.join(weights, "kmer").groupBy(by, "model").agg(F.sum("weight").alias("score"))


def best_match(seq: str, matrix: np.ndarray) -> float:
    """Highest log-likelihood ratio of a motif against an even background on either strand."""
    codes = np.array([BASES.find(c) for c in seq.upper()])
    width = len(matrix)
    if len(codes) < width:
        return float("-inf")
    table = np.log((matrix + 0.01) / 1.04 / 0.25)
    table = np.column_stack([table, np.full(width, -10.0)])
    both = (table, np.column_stack([table[::-1, 3::-1], np.full(width, -10.0)]))
    view = np.lib.stride_tricks.sliding_window_view(codes, width)
    return float(max(t[np.arange(width), view].sum(axis=1).max() for t in both))


def roc(positive: np.ndarray, negative: np.ndarray) -> float:
    """Mann-Whitney: the chance that a positive beats a negative, ties counting half."""
    order = np.sort(negative)
    below, upto = np.searchsorted(order, positive, "left"), np.searchsorted(order, positive, "right")
    return float((below + upto).sum() / 2 / (len(positive) * len(negative)))


def shuffled(seqs: list[str], random: np.random.Generator) -> list[str]:
    """Negatives with the composition of each sequence; they need no genome."""
    return ["".join(random.permutation(list(s))) for s in seqs]


def discover(seqs: list[str], width: int, random: np.random.Generator, rounds: int = 30) -> np.ndarray | None:
    """One motif by expectation-maximisation, none or one occurrence per sequence, either strand.

    The start is the window with the best mean match to all sequences among a few dozen of them.
    """
    usable = [s for s in seqs if len(s) >= width and set(s) <= set(BASES)]
    if not usable:
        return None
    other = str.maketrans(BASES, "TGCA")
    codes = []
    for s in usable:
        for strand in (s, s.translate(other)[::-1]):
            codes.append(np.lib.stride_tricks.sliding_window_view(np.array([BASES.find(c) for c in strand]), width))
    owner = np.repeat(np.arange(len(usable)), [len(codes[2 * i]) + len(codes[2 * i + 1]) for i in range(len(usable))])
    view = np.concatenate(codes)
    hot = np.eye(4)[view]
    starts = random.choice(len(view), min(40, len(view)), replace=False)

    def fit(matrix: np.ndarray, n: int) -> tuple[np.ndarray, float]:
        share = 0.8
        for _ in range(n):
            odds = np.exp(np.einsum("nwb,wb->n", hot, np.log(matrix / 0.25)))
            places = np.bincount(owner, minlength=len(usable))
            joint = share / places[owner] * odds
            total = np.bincount(owner, joint, len(usable)) + 1 - share
            z = joint / total[owner]
            share = float(np.clip(z.sum() / len(usable), 0.05, 0.95))
            matrix = np.einsum("n,nwb->wb", z, hot) + 0.25
            matrix /= matrix.sum(axis=1, keepdims=True)
        return matrix, float(np.log(total).sum())

    first = [fit((np.eye(4)[view[i]] + 0.2) / 1.8, 2) for i in starts]
    return fit(max(first, key=lambda f: f[1])[0], rounds)[0]


def discover_all(seqs: list[str], count: int, min_width: int, max_width: int, seed: int, least_roc: float = 0.7) -> list[tuple[int, np.ndarray, float]]:
    """(number, matrix, roc) of the motifs that tell seqs from shuffled ones; numbers count rejected ones.

    Found motifs are masked before the next search.
    """
    random = np.random.default_rng(seed)
    left, out = list(seqs), []
    negative = shuffled(seqs, random)
    for number in range(count):
        best = None
        for width in range(min_width, max_width + 1):
            matrix = discover(left, width, random)
            if matrix is None:
                continue
            area = roc(np.array([best_match(s, matrix) for s in left]), np.array([best_match(s, matrix) for s in negative]))
            if best is None or area > best[1] + 1e-9:
                best = matrix, area
        if best is None:
            break
        matrix, area = best
        if area > least_roc:
            out.append((number, matrix, area))
        masked = []
        for s in left:
            view = [best_match(s[i : i + len(matrix)], matrix) for i in range(max(0, len(s) - len(matrix) + 1))]
            at = int(np.argmax(view)) if view else 0
            masked.append(s[:at] + "N" * len(matrix) + s[at + len(matrix) :] if view and view[at] > 0 else s)
        left = [piece for s in masked for piece in s.split("N") if len(piece) >= min_width]
    return out


def lower_share(seq: str) -> float:
    return sum(c.islower() for c in seq) / max(1, len(seq))


def search_windows(top: DataFrame, sites: DataFrame, width: int) -> DataFrame:
    """top with `window`: the letters of the site up to width / 2 from the hill's middle, in their case."""
    half = width // 2
    middle = F.col("start") + F.floor((F.col("len") - 1) / 2).cast("int")
    first = F.greatest(middle - half, F.lit(0))
    return sites.select("site_id", F.col("seq").alias("_site")).join(F.broadcast(top), "site_id").withColumn("window", F.substring("_site", first + 1, middle + half - first + 1)).drop("_site")


def cluster_motifs(assigned: DataFrame, sites: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(model, motif, pos, a, c, g, t, roc): motifs of each cluster of each model, named model_c{cluster}_{number}.

    assigned: model, cluster, site_id, start, len, score. A cluster's best top_hills hills are searched,
    without those whose window is lower-case (repeats) for more than max_lower_case. Random regions have
    no motifs.
    """
    assigned = without_background(assigned)
    order = Window.partitionBy("model", "cluster").orderBy(F.desc("score"), "site_id", "start")
    top = cut(assigned.select("model", "cluster", "site_id", "start", "len", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_hills))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seqs = [s.upper() for s in group.sort_values("rank")["window"] if lower_share(s) <= config.max_lower_case]
        model, number = group["model"].iloc[0], int(group["cluster"].iloc[0])
        found = discover_all(seqs, config.motifs_per_cluster, config.motif_min_width, config.motif_max_width, config.seed, config.motif_min_roc)
        rows = [(model, f"{model}_c{number}_{n}", pos, *map(float, row), area) for n, matrix, area in found for pos, row in enumerate(matrix)]
        return pd.DataFrame(rows, columns=["model", "motif", "pos", "a", "c", "g", "t", "roc"])

    shape = "model string, motif string, pos int, a double, c double, g double, t double, roc double"
    return search_windows(top, sites, config.motif_window).select("model", "cluster", "rank", "window").groupBy("model", "cluster").applyInPandas(run, shape)
