"""Clusters of k-mer profiles: choice of their number, assignment, medoids."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqprism.config import AnalysisConfig

from .ranking import cut, ranked
from .stats import hill_presence


def kmeans(points: np.ndarray, k: int, random: np.random.Generator, rounds: int = 10, tolerance: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(means, assignment) from k distinct points; fewer means if there are fewer distinct points.

    Starts are drawn one by one with a chance that grows with the square of the distance to those
    drawn before: uniform ones put two into one cluster too often.
    """
    own = np.unique(points, axis=0)
    starts = [int(random.integers(len(own)))]
    while len(starts) < min(k, len(own)):
        far = distances(own, own[starts]).min(axis=1) ** 2
        far[starts] = 0
        starts.append(int(random.choice(len(own), p=far / far.sum())))
    means = own[starts]
    for _ in range(rounds):
        near = distances(points, means).argmin(axis=1)
        new = np.array([points[near == c].mean(axis=0) if (near == c).any() else means[c] for c in range(len(means))])
        moved = np.abs(new - means).max()
        means = new
        if moved < tolerance:
            break
    return means, distances(points, means).argmin(axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0))


def silhouette(points: np.ndarray, near: np.ndarray) -> float:
    """Mean over all points; 0 for a point alone in its cluster."""
    d = distances(points, points)
    clusters = np.unique(near)
    if len(clusters) < 2:
        return 0.0
    sums = np.stack([d[:, near == c].sum(axis=1) for c in clusters], axis=1)
    sizes = np.array([(near == c).sum() for c in clusters])
    own = np.searchsorted(clusters, near)
    rows = np.arange(len(points))
    inside = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[rows, own] = np.inf
    outside = means.min(axis=1)
    score = (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-300)
    return float(np.where(sizes[own] > 1, score, 0).mean())


def stratified_draw(points: np.ndarray, strata: np.ndarray, random: np.random.Generator, most: int) -> np.ndarray:
    """A draw with replacement: from each stratum half its size, `most` at most."""
    own = [np.flatnonzero(strata == s) for s in np.unique(strata)]
    return points[np.concatenate([random.choice(x, max(1, min(most, len(x) // 2))) for x in own])]


def select_k(points: np.ndarray, strata: np.ndarray, spark, k_values=(2, 3, 4, 5, 6), bootstraps: int = 30, most: int = 1000, rounds: int = 10, seed: int = 42) -> tuple[DataFrame, int, np.ndarray]:
    """(quality rows, k, means): k with the largest median silhouette, the smallest of equals.

    points is a sample with a bound of its own (three strata of `most` rows); one task for each k and
    draw. quality: k, bootstrap, silhouette, ssd.
    """
    if len(points) == 0:
        raise ValueError("no profiles to cluster")
    grid = spark.createDataFrame([(k, b) for k in k_values for b in range(bootstraps)], "k int, bootstrap int").repartition(len(k_values) * bootstraps)

    def run(batches):
        for batch in batches:
            out = []
            for k, b in zip(batch["k"], batch["bootstrap"], strict=True):
                random = np.random.default_rng([seed, k, b])
                drawn = stratified_draw(points, strata, random, most)
                means, near = kmeans(drawn, k, random, rounds)
                ssd = float((distances(drawn, means)[np.arange(len(drawn)), near] ** 2).sum())
                out.append((k, b, silhouette(drawn, near), ssd, means.ravel().tolist()))
            yield pd.DataFrame(out, columns=["k", "bootstrap", "silhouette", "ssd", "means"])

    quality = grid.mapInPandas(run, "k int, bootstrap int, silhouette double, ssd double, means array<double>").cache()
    rows = quality.select("k", "bootstrap", "silhouette", "ssd").toPandas()
    median = rows.groupby("k")["silhouette"].median()
    best = int(min(median.index, key=lambda k: (-median[k], k)))
    chosen = rows[rows["k"] == best].sort_values(["silhouette", "bootstrap"], ascending=[False, True]).iloc[0]
    means = np.array(quality.where((F.col("k") == best) & (F.col("bootstrap") == int(chosen["bootstrap"]))).first()["means"]).reshape(-1, points.shape[1])
    return quality.drop("means"), best, means


def nearest(points: DataFrame, centroids: list[list[float]], vector: str, digits: int = 6) -> DataFrame:
    """points with cluster (place in the list, the first of equals) and distance, rounded.

    The centroids are literals: a handful of vectors, no join.
    """
    def to(center: list[float], k: int):
        squares = F.zip_with(vector, F.array(*map(F.lit, center)), lambda x, c: (x - c) * (x - c))
        return F.struct(F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)), digits).alias("distance"), F.lit(k).alias("cluster"))

    best = F.array_min(F.array(*[to(c, k) for k, c in enumerate(centroids)]))
    return points.withColumn("_best", best).withColumns({"cluster": F.col("_best.cluster"), "distance": F.col("_best.distance")}).drop("_best")


def large_clusters(sizes: DataFrame) -> DataFrame:
    """(cluster, n) of the clusters with at least min(floor(0.1 * largest), 500) members."""
    limit = F.least(F.floor(F.max("n").over(Window.partitionBy()) * 0.1), F.lit(500))
    return sizes.withColumn("_limit", limit).where("n >= _limit").drop("_limit")


def medoids(points: DataFrame, cluster: str, key: str, vector: str, block: int = 512, digits: int = 6) -> DataFrame:
    """(cluster, medoid, mean_distance): the member with the least mean distance to all members.

    Members are cut into blocks; a task holds two blocks and gives one partial sum per member.
    """
    sizes = points.groupBy(cluster).agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / block).cast("int")
    dealt = points.join(sizes, cluster).withColumns({"_parts": parts}).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
    sides = dealt.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = F.when(F.col("_side") == 0, F.col("_part")).otherwise(F.col("_other"))
    columns = F.when(F.col("_side") == 0, F.col("_other")).otherwise(F.col("_part"))
    tasks = sides.select(F.col(cluster).alias("cluster"), rows.alias("rows"), columns.alias("columns"), F.col("_side").alias("side"), F.col(key).alias("key"), F.col(vector).alias("vector"), F.col("_n").alias("n"))

    def partial(group: pd.DataFrame) -> pd.DataFrame:
        mine, others = group[group["side"] == 0], group[group["side"] == 1]
        if not len(mine) or not len(others):
            return pd.DataFrame({"cluster": [], "key": [], "n": [], "total": []}).astype({"cluster": group["cluster"].dtype, "key": "int64", "n": "int64", "total": "float64"})
        a, b = (np.stack([np.asarray(v, float) for v in side["vector"]]) for side in (mine, others))
        exact = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)) if len(a) * len(b) * a.shape[1] < 5e6 else distances(a, b)
        return pd.DataFrame({"cluster": mine["cluster"].to_numpy(), "key": mine["key"].to_numpy(), "n": mine["n"].to_numpy(), "total": exact.sum(axis=1)})

    kind = points.schema[cluster].dataType.simpleString()
    sums = tasks.groupBy("cluster", "rows", "columns").applyInPandas(partial, f"cluster {kind}, key long, n long, total double")
    means = sums.groupBy("cluster", "key").agg((F.sum("total") / F.first("n")).alias("mean"))
    rounded = means.withColumn("mean", F.round("mean", digits))
    return rounded.groupBy("cluster").agg(F.min_by("key", F.struct("mean", "key")).alias("medoid"), F.min("mean").alias("mean_distance"))


def canonical_kmers(kmin: int, kmax: int) -> list[str]:
    """All canonical k-mers, by length and then by letter."""
    other = str.maketrans("ACGT", "TGCA")
    return [w for k in range(kmin, kmax + 1) for w in map("".join, itertools.product("ACGT", repeat=k)) if w <= w.translate(other)[::-1]]


def profile_matrix(seqs: list[str], names: list[str], kmin: int, kmax: int) -> np.ndarray:
    """Counts of the canonical k-mers in names (columns) in each sequence (rows)."""
    other = str.maketrans("ACGT", "TGCA")
    out = np.zeros((len(seqs), len(names)))
    if not len(seqs):
        return out
    column = {name: i for i, name in enumerate(names)}
    width = max(map(len, seqs))
    letters = np.frombuffer("".join(s.ljust(width) for s in seqs).encode(), np.uint8).reshape(len(seqs), width)
    digit = np.full(256, -1)
    digit[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
    digits = digit[letters]
    for k in range(kmin, kmax + 1):
        if width < k:
            continue
        words = list(map("".join, itertools.product("ACGT", repeat=k)))
        place = np.array([column.get(min(w, w.translate(other)[::-1]), -1) for w in words])
        view = np.lib.stride_tricks.sliding_window_view(digits, k, axis=1)
        at = np.where((view >= 0).all(axis=2), place[np.maximum(view, 0) @ 4 ** np.arange(k)[::-1]], -1)
        row, spot = np.nonzero(at >= 0)
        np.add.at(out, (row, at[row, spot]), 1)
    return out


def cluster_hills(hills: DataFrame, config: AnalysisConfig, assigning: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(quality, assigned): each model's hills clustered by their k-mer profiles.

    hills: model, site_id, start, len, seq, score; all hills of a model with more than min_model_hills
    count. The profile's k-mers are those in more than the penetrance share of them. For each k and
    bootstrap a sample is drawn anew, with replacement, from the score tertiles of all hills. Means of
    small clusters are dropped, and every hill goes to the nearest of the rest.
    quality: model, k, bootstrap, silhouette, ssd, chosen; assigned: hills with cluster and distance, None
    unless assigning, which takes another pass over all hills.
    """
    spark = hills.sparkSession
    # Hills are found once: the range partitions of the ranks read their rows twice.
    found = cut(hills.select("model", "site_id", "start", "len", "seq", "score"))
    placed = cut(ranked(found, "model", [F.desc("score"), F.col("site_id").asc(), F.col("start").asc()]))
    sizes = {r.model: r.n for r in placed.groupBy("model").agg(F.count("*").alias("n")).collect() if r.n > config.min_model_hills}
    shape = "model string, site_id long, start int, len int, seq string, score double, rank long, cluster int, distance double"
    if not sizes:
        return spark.createDataFrame([], "model string, k int, bootstrap int, silhouette double, ssd double, chosen boolean"), spark.createDataFrame([], shape)

    names: dict[str, list[str]] = {model: [] for model in sizes}
    for r in hill_presence(found.withColumnRenamed("seq", "hill"), sorted(sizes), config.kmin, config.kmax).orderBy("model", "kmer").collect():
        if r.n / sizes[r.model] > config.penetrance:
            names[r.model].append(r.kmer)

    # A draw takes places in the order of scores: bounded numbers of rows, from all of them.
    plan = []
    for model, n in sorted(sizes.items()):
        third = n // 3
        for stratum in range(3):
            size = third if stratum < 2 else n - 2 * third
            plan += [(model, k, b, stratum, stratum * third, size, min(config.stratum_rows, third // 2)) for k in config.k_values for b in range(config.bootstraps)]
    strata = spark.createDataFrame(plan, "model string, k int, bootstrap int, stratum int, first long, size long, most int").repartition("model", "k", "bootstrap")
    draws = strata.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most") - 1)))
    hashed = F.xxhash64(F.lit(config.seed), "model", "k", "bootstrap", "stratum", "i")
    draws = draws.select("model", "k", "bootstrap", "stratum", "i", (F.col("first") + F.pmod(hashed, "size") + 1).alias("rank"))
    drawn = draws.join(placed.select("model", "rank", "seq"), ["model", "rank"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["stratum", "i"])
        model, k, b = group["model"].iloc[0], int(group["k"].iloc[0]), int(group["bootstrap"].iloc[0])
        points = profile_matrix(group["seq"].tolist(), names[model], config.kmin, config.kmax)
        means, near = kmeans(points, k, np.random.default_rng([config.seed, k, b]), config.cluster_rounds)
        ssd = float((distances(points, means)[np.arange(len(points)), near] ** 2).sum())
        return pd.DataFrame({"model": [model], "k": [k], "bootstrap": [b], "silhouette": [silhouette(points, near)], "ssd": [ssd], "means": [means.ravel().tolist()]})

    tried = cut(drawn.groupBy("model", "k", "bootstrap").applyInPandas(run, "model string, k int, bootstrap int, silhouette double, ssd double, means array<double>"))
    rows = tried.select("model", "k", "bootstrap", "silhouette").toPandas()
    chosen: dict[str, int] = {}
    centers: dict[str, np.ndarray] = {}
    for model, own in rows.groupby("model"):
        median = own.groupby("k")["silhouette"].median()
        k = chosen[model] = int(min(median.index, key=lambda k: (-median[k], k)))
        best = own[own["k"] == k].sort_values(["silhouette", "bootstrap"], ascending=[False, True]).iloc[0]
        means = tried.where((F.col("model") == model) & (F.col("k") == k) & (F.col("bootstrap") == int(best["bootstrap"]))).first()["means"]
        centers[model] = np.array(means).reshape(-1, len(names[model]))

    of = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
    quality = tried.drop("means").withColumn("chosen", F.col("k") == F.element_at(of, F.col("model")))
    if not assigning:
        return quality, None

    def assign(centers: dict[str, np.ndarray]):
        def run(batches):
            for batch in batches:
                for model, own in batch.groupby("model"):
                    if model in centers:
                        d = np.round(distances(profile_matrix(own["seq"].tolist(), names[model], config.kmin, config.kmax), centers[model]), 6)
                        yield own.assign(cluster=d.argmin(axis=1).astype(np.int32), distance=d.min(axis=1))

        return placed.mapInPandas(run, shape)

    members = assign(centers).groupBy("model", "cluster").agg(F.count("*").alias("n")).toPandas()
    for model, own in members.groupby("model"):
        limit = min(int(own["n"].max() * 0.1), 500)
        kept = sorted(own.loc[own["n"] >= limit, "cluster"])
        centers[model] = centers[model][kept]
    return quality, assign(centers)
