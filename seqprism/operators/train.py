"""Sparse hierarchical multinomial regression by consensus optimisation.

Leaves are classes, and each shared label is a node above them. The aim is the weighted negative log
likelihood plus 2 * lambda * sum |x_leaf - s_label| over all (leaf, label) pairs (against zero for a
leaf without labels), with s_label the lower median of its leaves, feature by feature. Rows are dealt
into blocks by a hash of the site, one for each partition. A block's rows, coefficients and multipliers
stay with it from round to round; sums over the blocks come up a tree. So the driver holds (features +
1) x (leaves + pairs) numbers, whatever the number of blocks.

Few features (k-mers of up to DENSE_KMAX letters) need no consensus: fit_dense() finds the same leaves with
all rows as one problem. Blocks only give sums over their rows, one pass for each step, and the driver holds
(features + 1) x (features + 1) numbers and the last MEMORY steps besides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprism.config import AnalysisConfig
from seqprism.functions import arrays

from .cluster import canonical_kmers
from .ranking import cut

#: Sites of one block at most, on average; more sites make more blocks.
BLOCK_SITES = 100_000
#: Rounds between checkpoints of the blocks' states: what a lost executor costs at most.
CHECKPOINT_ROUNDS = 10
#: Blocks whose sums the driver adds up itself; those of more come up a tree.
DRIVER_SUMS = 16
#: Rows of a dense block that are in double precision at once.
DENSE_ROWS = 2048
#: Longest k-mers of which so many are in a site that a block is a matrix: it has up to 700 columns at 5.
DENSE_KMAX = 5
#: Rows of a dense block in one product of a pass: as many as a processor's own memory holds.
PASS_ROWS = 512
#: Sites of a dense block at least, where blocks are made for the cores' sake.
LEAST_SITES = 4096
#: Steps that a dense fit remembers, and rounds in which it finds the least of its quadratic model.
MEMORY, MODEL_ROUNDS = 60, 60


def lower_median(values: np.ndarray) -> np.ndarray:
    """Along the first axis; the smaller of the middle two for an even number."""
    return np.sort(values, axis=0)[(len(values) - 1) // 2]


def lbfgs(objective, x: np.ndarray, memory: int = 5, eps: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Minimises a smooth convex function; stops at |g| < eps * max(1, |x|) or where no step helps."""
    value, gradient = objective(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.linalg.norm(gradient) < eps * max(1.0, np.linalg.norm(x)):
            break
        q, kept = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        slope = -(gradient @ q)
        if slope >= 0:
            q, slope, steps = gradient, -(gradient @ gradient), []
        size = 1.0 if steps else min(1.0, 1.0 / max(np.linalg.norm(q), 1e-12))
        for _ in range(40):
            new_value, new_gradient = objective(x - size * q)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * q, new_gradient - gradient
        x, value, gradient = x + s, new_value, new_gradient
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
    return x


@dataclass
class Rows:
    """Sparse rows: counts of features, class and weight of each site of a block."""

    heads: np.ndarray
    index: np.ndarray
    value: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    row: np.ndarray = field(init=False)

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self.label)), np.diff(np.append(self.heads, len(self.index))))

    def loss(self, x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted negative log likelihood of standardised features and its gradient; x is (d + 1) x
        leaves, intercepts first. Absent features count as zeros and are never stored."""
        slope = x[1:] / sd[:, None]
        leaves = x.shape[1]
        logit = np.stack([np.bincount(self.row, self.value * slope[self.index, c], len(self.label)) for c in range(leaves)], axis=1).astype(float)
        logit += x[0] - mean @ slope
        logit -= logit.max(axis=1, keepdims=True)
        total = np.log(np.exp(logit).sum(axis=1))
        rows = np.arange(len(self.label))
        value = float((self.weight * (total - logit[rows, self.label])).sum())
        delta = np.exp(logit - total[:, None])
        delta[rows, self.label] -= 1
        delta *= self.weight[:, None]
        down = np.stack([np.bincount(self.index, self.value * delta[self.row, c], len(mean)) for c in range(leaves)], axis=1).astype(float)
        sums = delta.sum(axis=0)
        return value, np.vstack([sums, (down - mean[:, None] * sums) / sd[:, None]])


@dataclass
class DenseRows:
    """Rows of which most features are present: a matrix of small counts, which two products go over."""

    counts: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    def loss(self, x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[float, np.ndarray]:
        """As of Rows."""
        found = self.sums(x, mean, sd, np.float64)
        return found.value, found.gradient

    def sums(self, x: np.ndarray, mean: np.ndarray, sd: np.ndarray, kind: type = np.float32) -> Smooth:
        """The loss, its gradient and the spread of the classes; kind: of the numbers in the products, whose sums
        are in double precision."""
        slope = x[1:] / sd[:, None]
        shift, slope = (x[0] - mean @ slope).astype(kind), slope.astype(kind)
        leaves = np.arange(x.shape[1])
        value, sums, down, spread = 0.0, np.zeros(len(leaves)), np.zeros(slope.shape), np.zeros((len(leaves), len(leaves)))
        held = np.empty((PASS_ROWS, len(slope)), kind)
        for at in range(0, len(self.label), PASS_ROWS):
            label, weight = self.label[at : at + PASS_ROWS], self.weight[at : at + PASS_ROWS]
            own, rows = held[: len(label)], np.arange(len(label))
            np.copyto(own, self.counts[at : at + PASS_ROWS], casting="unsafe")
            logit = own @ slope
            logit += shift
            logit -= logit.max(axis=1, keepdims=True)
            part = np.exp(logit)
            total = part.sum(axis=1)
            value += float((weight * (np.log(total) - logit[rows, label])).sum())
            part /= total[:, None]
            delta = part * weight[:, None].astype(kind)
            spread -= delta.T @ part
            spread[leaves, leaves] += delta.sum(axis=0)
            delta[rows, label] -= weight.astype(kind)
            down += own.T @ delta
            sums += delta.sum(axis=0)
        return Smooth(value, np.vstack([sums, (down - mean[:, None] * sums) / sd[:, None]]), spread)

    def gram(self) -> np.ndarray:
        """Weighted products of all pairs of columns, a column of ones first."""
        out = np.zeros((self.counts.shape[1] + 1, self.counts.shape[1] + 1))
        for at in range(0, len(self.label), DENSE_ROWS):
            own = self.counts[at : at + DENSE_ROWS]
            own = np.hstack([np.ones((len(own), 1), np.float32), own.astype(np.float32)])
            own *= np.sqrt(self.weight[at : at + DENSE_ROWS, None]).astype(np.float32)
            out += own.T @ own
        return out


@dataclass
class Smooth:
    """Over rows: the weighted loss, its gradient, and the weighted sum of diag(p) - p p' for the rows'
    probabilities p of the leaves."""

    value: float
    gradient: np.ndarray
    spread: np.ndarray

    def __add__(self, other: Smooth) -> Smooth:
        return Smooth(self.value + other.value, self.gradient + other.gradient, self.spread + other.spread)


@dataclass
class Model:
    features: list[str]
    leaves: list[str]
    labels: list[str]
    coefficients: np.ndarray  # (d + 1) x leaves, of raw counts; intercepts first
    label_weights: np.ndarray  # d x labels, of raw counts
    objective: list[float]

    def table(self, spark) -> DataFrame:
        """(model, feature, value): leaves with `(Intercept)`, labels without one."""
        rows = [(m, f, float(v)) for k, m in enumerate(self.leaves) for f, v in zip(["(Intercept)", *self.features], self.coefficients[:, k], strict=True)]
        rows += [(m, f, float(v)) for k, m in enumerate(self.labels) for f, v in zip(self.features, self.label_weights[:, k], strict=True)]
        return spark.createDataFrame(rows, "model string, feature string, value double")


def make_blocks(counts: DataFrame, sites: DataFrame, features: list[str], leaves: list[str], weights: dict[str, float], blocks: int) -> DataFrame:
    """One row per block: its sparse rows as binary columns.

    counts: site_id, kmer, cnt; sites: site_id, leaf. The numbers of features and leaves go as maps.
    """
    spark = counts.sparkSession
    numbers = spark.createDataFrame([(f, i) for i, f in enumerate(features)], "kmer string, at int")
    classes = spark.createDataFrame([(name, i, float(weights[name])) for i, name in enumerate(leaves)], "leaf string, label int, weight double")
    rows = counts.join(F.broadcast(numbers), "kmer").groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("at", "cnt"))).alias("f"))
    kept = sites.join(F.broadcast(classes), "leaf").join(rows, "site_id", "left")
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("site_id"), F.lit(blocks)).cast("int"))

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("site_id")
        own = [x if x is not None else [] for x in group["f"]]
        heads = np.cumsum([0, *map(len, own)])[:-1]
        index = np.array([p["at"] for x in own for p in x], np.int32)
        value = np.array([p["cnt"] for x in own for p in x], np.float64)
        packed = [heads.astype(np.int64), index, value, group["label"].to_numpy(np.int32), group["weight"].to_numpy(np.float64)]
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], **{n: [a.tobytes()] for n, a in zip(("heads", "at", "value", "label", "weight"), packed, strict=True)}})

    return cut(dealt.select("block", "site_id", "label", "weight", "f").groupBy("block").applyInPandas(gather, "block int, heads binary, at binary, value binary, label binary, weight binary"))


def count_matrix(seqs: pa.Array, column_of: dict[int, np.ndarray], width: int) -> np.ndarray:
    """Counts of features in each sequence. column_of: for each length the column of the k-mer of each number;
    width, one more than the last, for those that aren't features."""
    text, offsets = arrays.flat(seqs)
    out = np.zeros((len(seqs), width), np.uint8)
    for a, b in arrays.pieces(offsets):
        part, at = text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        owner = np.repeat(np.arange(b - a), np.diff(at))
        found = sum(np.bincount(owner * (width + 1) + column[arrays.numbers(part, at, k)], minlength=(b - a) * (width + 1)) for k, column in column_of.items())
        found = found.reshape(b - a, width + 1)[:, :width]
        if found.max(initial=0) > np.iinfo(out.dtype).max:
            out = out.astype(np.int64)
        out[a:b] = found
    return out


def columns_of(features: list[str], kmin: int, kmax: int) -> dict[int, np.ndarray]:
    place = {f: i for i, f in enumerate(features)}
    return {k: np.array([place.get(min(w, w.translate(arrays.OTHER)[::-1]), len(features)) for w in arrays.spellings(k)] + [len(features)]) for k in range(kmin, kmax + 1)}


def dense_stats(marked: DataFrame, total: float, kmin: int, kmax: int) -> DataFrame:
    """kmers.feature_stats() from (seq, weight) of sites of the letters A, C, G, T: a task gives two numbers for
    each k-mer."""
    names = canonical_kmers(kmin, kmax)
    columns = columns_of(names, kmin, kmax)

    def run(batches):
        s, q = np.zeros(len(names)), np.zeros(len(names))
        for batch in batches:
            for first in range(0, len(batch), DENSE_ROWS):
                own = batch.slice(first, DENSE_ROWS)
                counts, weight = count_matrix(own.column(0), columns, len(names)).astype(float), own.column(1).to_numpy(zero_copy_only=False)
                s += weight @ counts
                q += weight @ (counts * counts)
        at = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.string()), pa.array(s[at]), pa.array(q[at])], names=["kmer", "s", "q"])

    sums = marked.select("seq", "weight").mapInArrow(run, "kmer string, s double, q double").groupBy("kmer").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / total
    return sums.select("kmer", mean.alias("mean"), F.sqrt(F.abs(F.col("q") - total * mean * mean) / (total - 1)).alias("sd"))


def dense_blocks(marked: DataFrame, features: list[str], leaves: list[str], weights: dict[str, float], kmin: int, kmax: int, blocks: int) -> DataFrame:
    """make_blocks() from (site_id, leaf, seq), so that no k-mer is a row: `value` is a block's matrix of counts,
    of the type that `heads` names, and `at` is empty."""
    number, columns = {name: i for i, name in enumerate(leaves)}, columns_of(features, kmin, kmax)
    dealt = marked.withColumn("block", F.pmod(F.xxhash64("site_id"), F.lit(blocks)).cast("int"))

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by("site_id").combine_chunks()
        leaf = group.column("leaf").to_pylist()
        seqs = group.column("seq").combine_chunks()
        counts = count_matrix(seqs.chunk(0) if isinstance(seqs, pa.ChunkedArray) else seqs, columns, len(features))
        packed = [np.array([number[x] for x in leaf], np.int32), np.array([weights[x] for x in leaf], float)]
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "heads": pa.array([counts.dtype.str.encode()], pa.binary()), "at": pa.array([b""], pa.binary()), "value": pa.array([counts.tobytes()], pa.binary()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("label", "weight"), packed, strict=True)}})

    return cut(dealt.select("block", "site_id", "leaf", "seq").groupBy("block").applyInArrow(gather, "block int, heads binary, at binary, value binary, label binary, weight binary"))


def _rows(r) -> Rows | DenseRows:
    label = np.frombuffer(r["label"], np.int32)
    if len(label) and len(r["heads"]) < 8:
        return DenseRows(np.frombuffer(r["value"], np.dtype(r["heads"].decode())).reshape(len(label), -1), label, np.frombuffer(r["weight"]))
    return Rows(np.frombuffer(r["heads"], np.int64), np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"]), np.frombuffer(r["label"], np.int32), np.frombuffer(r["weight"]))


@dataclass
class Carry:
    """What all blocks get for a round: the common target, and by what multipliers are to be divided."""

    z: np.ndarray  # pairs x d
    s: np.ndarray  # pairs x d: the labels' weights
    common: np.ndarray  # intercepts
    scale: float
    rho: float


@dataclass
class Held:
    """What a block keeps: its coefficients, and its multipliers before the round's mean is taken off."""

    x: np.ndarray  # (d + 1) x leaves
    v: np.ndarray  # pairs x d
    w0: np.ndarray  # leaves


@dataclass
class Sums:
    """Over blocks: of v and of the pairs' coefficients, of their squares for each pair, and of w0."""

    n: int
    v: np.ndarray
    copies: np.ndarray
    v2: np.ndarray
    copies2: np.ndarray
    w0: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(*(getattr(self, f) + getattr(other, f) for f in self.__dataclass_fields__))


def pairs_of(leaves: list[str], parents: dict[str, list[str]]) -> tuple[list[str], list[tuple[int, int]]]:
    """The labels, and the numbers of (leaf, label), or of (leaf, -1) for a leaf without labels."""
    labels = sorted({p for own in parents.values() for p in own})
    pairs = [(i, labels.index(p)) for i, name in enumerate(leaves) for p in parents.get(name, [])]
    return labels, pairs + [(i, -1) for i, name in enumerate(leaves) if not parents.get(name)]


def squares(total: np.ndarray, mean_of: np.ndarray, about: np.ndarray, n: int) -> np.ndarray:
    """For each pair the sum over blocks of |value - about|^2, from the sums of squares and of values."""
    return np.maximum(total - 2 * (about * mean_of).sum(axis=1) + n * (about**2).sum(axis=1), 0)


def converged(number: int, moved: list[float], norms: list[float], budget: int, tolerance: float) -> bool:
    """Whether the outer rounds end: every node moved by less than its tolerance, or, beyond half the
    budget, by less than twice its norm. number counts from 0."""
    if all(a <= tolerance * b for a, b in zip(moved, norms, strict=True)):
        return True
    return number > budget // 2 and all(a < 2 * b for a, b in zip(moved, norms, strict=True))


def solve(rows: Rows, held: Held, carry: Carry, leaf: np.ndarray, mean: np.ndarray, sd: np.ndarray, over_relaxation: float) -> Held:
    """A block's round: its multipliers follow the last means, then its own smooth problem is solved."""
    u, u0 = (held.v - carry.z) / carry.scale, (held.w0 - carry.common) / carry.scale
    target, intercept, shape = carry.z + carry.s - u, carry.common - u0, held.x.shape

    def objective(flat):
        own = flat.reshape(shape)
        value, gradient = rows.loss(own, mean, sd)
        gap, shift = own[1:].T[leaf] - target, own[0] - intercept
        value += carry.rho / 2 * float((gap**2).sum() + (shift**2).sum())
        pull = np.zeros((shape[1], shape[0] - 1))
        np.add.at(pull, leaf, carry.rho * gap)
        gradient[1:] += pull.T
        gradient[0] += carry.rho * shift
        return value, gradient.ravel()

    x = lbfgs(objective, held.x.ravel()).reshape(shape)
    relaxed = over_relaxation * x[1:].T[leaf] + (1 - over_relaxation) * (carry.z + carry.s)
    return Held(x, relaxed - carry.s + u, x[0] + u0)


def sums_of(held: Held, leaf: np.ndarray) -> Sums:
    copies = held.x[1:].T[leaf]
    return Sums(1, held.v, copies, (held.v**2).sum(axis=1), (copies**2).sum(axis=1), held.w0)


def one_by_one(rdd: RDD) -> RDD:
    """rdd with each element packed alone. zip() sends RDDs of other packing through Python once more each, and
    a block's rows are large."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


class Blocks:
    """The rows of all blocks, one for each partition, and their states, if any, which stay beside them."""

    def __init__(self, blocks: DataFrame, n: int, first: Callable[[], Held] | None = None):
        names = ("heads", "at", "value", "label", "weight")
        pairs = blocks.rdd.map(lambda r: (r["block"], {c: bytes(r[c]) for c in names}))
        self.context, self.n = blocks.sparkSession.sparkContext, n
        # A partition without rows has a block all the same: an empty one.
        empty = {c: b"" for c in names}
        dealt = pairs.partitionBy(n, lambda block: block).mapPartitions(lambda own: iter([next((r for _, r in own), empty)]), preservesPartitioning=True)
        self.rows: RDD = one_by_one(dealt).persist(StorageLevel.MEMORY_AND_DISK)
        self.rows.checkpoint()
        self.states: RDD | None = one_by_one(self.rows.map(lambda _: first())) if first else None
        self.rounds = 0

    def advance(self, step: Callable[[dict, Held], Held], sums: Callable[[Held], Sums]) -> Sums:
        """Every block's next state; the sums over all of them."""
        old = self.states
        self.states = one_by_one(self.rows.zip(old).map(lambda pair: step(*pair))).persist(StorageLevel.MEMORY_AND_DISK)
        self.rounds += 1
        if self.rounds % CHECKPOINT_ROUNDS == 0:
            self.states.checkpoint()
        found = self._sum(self.states.map(sums))
        old.unpersist()
        return found

    def _sum(self, parts: RDD):
        return parts.reduce(lambda a, b: a + b) if self.n <= DRIVER_SUMS else parts.treeReduce(lambda a, b: a + b, max(2, int(np.ceil(np.log(self.n) / np.log(16)))))

    def sum_of(self, of: Callable[[dict], Smooth | np.ndarray]) -> Smooth | np.ndarray:
        """The sum over all blocks of what is made of one's rows."""
        return self._sum(self.rows.map(of))

    def total(self, of: Callable[[dict], float]) -> float:
        return self.rows.map(of).sum()

    def close(self) -> None:
        if self.states is not None:
            self.states.unpersist()
        self.rows.unpersist()


def fit(blocks: DataFrame, n_blocks: int, features: list[str], leaves: list[str], parents: dict[str, list[str]], mean: np.ndarray, sd: np.ndarray, support: np.ndarray, config: AnalysisConfig) -> Model:
    """Alternates consensus optimisation of the leaves and medians for the labels.

    A pair is (leaf, label), or (leaf, none) for a leaf without labels. Each block has its own copy of
    the leaves' coefficients, drawn together by z and the block's multipliers; intercepts are drawn
    to their mean and not penalised, and residuals leave them out.
    """
    labels, pairs = pairs_of(leaves, parents)
    d, n_leaves = len(features), len(leaves)
    leaf = np.array([p[0] for p in pairs])
    common = np.log(support + 1) - np.log(support[-1] + 1)
    labels_at, agreed = np.zeros((d, len(labels))), np.zeros((d, n_leaves))
    z = np.zeros((len(pairs), d))
    rho, scale, history, relaxation = config.rho, 1.0, [], config.over_relaxation

    def first(common=common, n_pairs=len(pairs)) -> Held:
        return Held(np.vstack([common, np.zeros((d, n_leaves))]), np.zeros((n_pairs, d)), common)

    held = Blocks(blocks, n_blocks, first)
    context = held.context
    scaling = context.broadcast((mean, sd))
    outer = config.outer_rounds if labels else 1
    for number in range(outer):
        before = np.vstack([common, agreed]), labels_at.copy()
        s = np.stack([labels_at[:, p] if p >= 0 else np.zeros(d) for _, p in pairs])
        for _ in range(config.admm_rounds):
            carry = context.broadcast(Carry(z, s, common, scale, rho))
            found = held.advance(lambda r, own, carry=carry: solve(_rows(r), own, carry.value, leaf, *scaling.value, relaxation), lambda own: sums_of(own, leaf))
            old, middle = z, found.v / n_blocks
            t = 2 * config.regularization / (rho * n_blocks)
            z = np.sign(middle) * np.maximum(np.abs(middle) - t, 0)
            common = found.w0 / n_blocks
            primal = np.sqrt(squares(found.copies2, found.copies, s + z, n_blocks))
            dual = rho * np.sqrt(n_blocks) * np.sqrt(((z - old) ** 2).sum(axis=1))
            norm = np.maximum(np.sqrt(found.copies2), np.sqrt(n_blocks * ((z + s) ** 2).sum(axis=1)))
            close = np.sqrt(d) * config.tolerance + config.tolerance * norm
            close_dual = np.sqrt(d) * config.tolerance + config.tolerance * rho * np.sqrt(squares(found.v2, found.v, z, n_blocks))
            scale = 1.0
            if (primal <= close).all() and (dual <= close_dual).all():
                break
            if number == 0:
                wanted = 2.0 if primal.sum() > 10 * dual.sum() else 0.5 if dual.sum() > 10 * primal.sum() else 1.0
                if rho * wanted <= config.rho_max:
                    rho, scale = rho * wanted, wanted
        # Coefficients in common: the mean over a leaf's pairs, which agree where z is exact.
        agreed = np.stack([(z + s)[leaf == i].mean(axis=0) for i in range(n_leaves)], axis=1)
        for k in range(len(labels)):
            labels_at[:, k] = lower_median(np.stack([agreed[:, i] for i, p in pairs if p == k]))
        penalty = 2 * config.regularization * float(sum(np.abs(agreed[:, i] - (labels_at[:, p] if p >= 0 else 0)).sum() for i, p in pairs))
        current = np.vstack([common, agreed])
        history.append(penalty + held.total(lambda r, current=current: _rows(r).loss(current, *scaling.value)[0]))
        nodes, earlier = np.hstack([current, np.vstack([np.zeros(len(labels)), labels_at])]), np.hstack([before[0], np.vstack([np.zeros(len(labels)), before[1]])])
        if converged(number, np.linalg.norm(nodes - earlier, axis=0).tolist(), np.linalg.norm(nodes, axis=0).tolist(), outer, config.tolerance):
            break
    held.close()
    slope = agreed / sd[:, None]
    coefficients = np.vstack([common - mean @ slope, slope])
    return Model(features, leaves, labels, coefficients, labels_at / sd[:, None], history)


@dataclass
class Penalty:
    """strength * sum |x_leaf - knot| over the knots of each leaf: its labels' weights, or zero."""

    strength: float
    knots: np.ndarray  # most knots of a leaf x d x leaves, ascending; inf where a leaf has fewer
    n: np.ndarray  # knots of each leaf

    @classmethod
    def of(cls, strength: float, labels_at: np.ndarray, pairs: list[tuple[int, int]], n_leaves: int) -> Penalty:
        own = [[labels_at[:, p] if p >= 0 else np.zeros(len(labels_at)) for i, p in pairs if i == k] for k in range(n_leaves)]
        knots = np.full((max(map(len, own)), len(labels_at), n_leaves), np.inf)
        for k, values in enumerate(own):
            knots[: len(values), :, k] = np.sort(np.stack(values), axis=0)
        return cls(strength, knots, np.array([len(values) for values in own]))

    def value(self, slopes: np.ndarray) -> float:
        gaps = np.abs(slopes - self.knots)
        return self.strength * float(gaps[np.isfinite(gaps)].sum())

    def nearest(self, at: np.ndarray, rho: float) -> np.ndarray:
        """Where the penalty and rho / 2 * |x - at|^2 are least together: beside or at a knot."""
        t = self.strength / rho
        out = np.minimum(at + t * self.n, self.knots[0])
        for j, knot in enumerate(self.knots):
            beyond = at + t * (self.n - 2 * (j + 1))
            out = np.where(beyond > knot, np.minimum(beyond, self.knots[j + 1]) if j + 1 < len(self.knots) else beyond, out)
        return out


class Curvature:
    """The Hessian of the loss, nearly: the spread of the classes times the Gram matrix of the columns, in the
    basis in which both are diagonal, and corrected by the remembered steps as BFGS does. memory: steps and
    changes of the gradient, in the columns' basis already."""

    def __init__(self, values: np.ndarray, basis: np.ndarray, spread: np.ndarray, memory: list[tuple[np.ndarray, np.ndarray]]):
        own, self.right = np.linalg.eigh(spread)
        own = np.maximum(own, 0)
        self.left = basis
        self.diagonal = (values[:, None] * own + 1e-6 * values.mean() * own.mean() + 1e-12).ravel()
        self.wide = np.zeros((len(self.diagonal), 0))
        self.middle = np.zeros((0, 0))
        if memory:
            steps, changes = (np.stack([(pair[i] @ self.right).ravel() for pair in memory], axis=1) for i in range(2))
            scaled, products = self.diagonal[:, None] * steps, steps.T @ changes
            below = np.tril(products, -1)
            self.wide = np.hstack([scaled, changes])
            self.middle = np.block([[steps.T @ scaled, below], [below.T, -np.diag(np.diag(products))]])

    def into(self, x: np.ndarray) -> np.ndarray:
        return (self.left.T @ x @ self.right).ravel()

    def back(self, flat: np.ndarray) -> np.ndarray:
        return self.left @ flat.reshape(len(self.left), -1) @ self.right.T

    def times(self, flat: np.ndarray) -> np.ndarray:
        return self.diagonal * flat - self.wide @ np.linalg.solve(self.middle, self.wide.T @ flat)

    def inverse(self, rho: float) -> Callable[[np.ndarray], np.ndarray]:
        """Of this and rho on the diagonal."""
        plain = 1 / (self.diagonal + rho)
        narrow = plain[:, None] * self.wide
        middle = np.linalg.inv(self.middle - self.wide.T @ narrow)
        return lambda flat: plain * flat + narrow @ (middle @ (narrow.T @ flat))


@dataclass
class Search:
    """What goes on from step to step: the model's own target, multipliers and their weight."""

    rho: float
    z: np.ndarray
    u: np.ndarray


def least_of_model(x: np.ndarray, gradient: np.ndarray, curvature: Curvature, penalty: Penalty, search: Search, rounds: int) -> np.ndarray:
    """Where the quadratic model of the loss about x and the penalty are least together, by alternating
    directions; all on the driver, without rows."""
    slope = curvature.into(gradient) - curvature.times(curvature.into(x))
    inverse, free = curvature.inverse(search.rho), x[:1]
    for number in range(1, rounds + 1):
        found = curvature.back(inverse(search.rho * curvature.into(np.vstack([free, search.z - search.u])) - slope))
        free = found[:1]
        relaxed = 1.6 * found[1:] - 0.6 * search.z
        old, search.z = search.z, penalty.nearest(relaxed + search.u, search.rho)
        search.u = search.u + relaxed - search.z
        if number % 10 == 0:
            apart, moved = np.linalg.norm(found[1:] - search.z), np.linalg.norm(search.z - old)
            if max(apart, moved) <= 1e-3 * np.linalg.norm(search.z - x[1:]):
                break
            wanted = 2.0 if apart > 5 * moved else 0.5 if moved > 5 * apart else 1.0
            if wanted != 1:
                search.rho *= wanted
                search.u = search.u / wanted
                inverse = curvature.inverse(search.rho)
    return np.vstack([free, search.z])


def fit_dense(blocks: DataFrame, n_blocks: int, features: list[str], leaves: list[str], parents: dict[str, list[str]], mean: np.ndarray, sd: np.ndarray, support: np.ndarray, config: AnalysisConfig) -> Model:
    """As fit(), for dense_blocks(): the same alternation of leaves and labels' medians, but the leaves' problem
    goes over all rows at once, by proximal quasi-Newton steps.

    A step leads to where a quadratic model of the loss and the exact penalty are least; each costs one pass over
    all rows, or more where the aim wouldn't sink enough. A round ends where a step is within the tolerance for
    every leaf and lowers the aim by less than a hundredth of it, in proportion.
    """
    labels, pairs = pairs_of(leaves, parents)
    d, n_leaves = len(features), len(leaves)
    held = Blocks(blocks, n_blocks)
    scaling = held.context.broadcast((mean, sd))

    def smooth(x: np.ndarray) -> Smooth:
        def of(r: dict) -> Smooth:
            rows = _rows(r)
            return rows.sums(x, *scaling.value) if len(rows.label) else Smooth(0.0, np.zeros_like(x), np.zeros((x.shape[1], x.shape[1])))

        return held.sum_of(of)

    def gram(r: dict) -> np.ndarray:
        rows = _rows(r)
        return rows.gram() if len(rows.label) else np.zeros((d + 1, d + 1))

    standard = np.diag(np.append(1.0, 1 / sd))
    standard[1:, 0] = -mean / sd
    products = held.sum_of(gram)
    values, basis = np.linalg.eigh(standard @ products @ standard.T)
    values = np.maximum(values, 1e-7 * values[-1]) / max(products[0, 0], 1e-300)
    # The loss is the same for intercepts that all are greater by one number: their sum is as in fit().
    start = np.log(support + 1) - np.log(support[-1] + 1)
    x = np.vstack([np.full(n_leaves, start.mean()), np.zeros((d, n_leaves))])
    labels_at = np.zeros((d, len(labels)))
    here, memory, stiffness, history = smooth(x), [], 1.0, []
    strength = 2 * config.regularization
    outer = config.outer_rounds if labels else 1
    for number in range(outer):
        before, labels_before = x, labels_at
        penalty = Penalty.of(strength, labels_at, pairs, n_leaves)
        search = Search(10 * strength or 1.0, x[1:], np.zeros((d, n_leaves)))
        aim, passes = here.value + penalty.value(x[1:]), 0
        while passes < config.admm_rounds:
            curvature = Curvature(values, basis, stiffness * here.spread, memory)
            wanted = least_of_model(x, here.gradient, curvature, penalty, search, MODEL_ROUNDS)
            step, gain = wanted - x, float((here.gradient * (wanted - x)).sum()) + penalty.value(wanted[1:]) - penalty.value(x[1:])
            if gain >= 0:  # the model's least was not found near enough
                wanted = least_of_model(x, here.gradient, curvature, penalty, search, 10 * MODEL_ROUNDS)
                step, gain = wanted - x, float((here.gradient * (wanted - x)).sum()) + penalty.value(wanted[1:]) - penalty.value(x[1:])
                if gain >= 0:
                    break
            share = 1.0
            while True:
                there = smooth(x + share * step)
                passes += 1
                found = there.value + penalty.value((x + share * step)[1:])
                if found <= aim + 1e-3 * share * gain or share < 1e-3 or passes >= config.admm_rounds:
                    break
                low = share * gain
                share *= min(0.6, max(0.2, -low / (2 * (found - aim - low))))
            if found > aim:
                if not memory:
                    break
                memory = []
                continue
            moved, change = share * step, there.gradient - here.gradient
            if (moved * change).sum() > 1e-10 * np.linalg.norm(moved) * np.linalg.norm(change):
                memory = [*memory, (basis.T @ moved, basis.T @ change)][-MEMORY:]
            stiffness = min(10.0, max(1.0, stiffness * (0.9 if share == 1 else share**-0.5)))
            x, here, aim = x + moved, there, found
            near = np.linalg.norm(step, axis=0) <= config.tolerance * (np.sqrt(d) + np.linalg.norm(x, axis=0))
            if near.all() and -gain <= config.tolerance / 100 * aim:
                break
        for k in range(len(labels)):
            labels_at = labels_at.copy()
            labels_at[:, k] = lower_median(np.stack([x[1:, i] for i, p in pairs if p == k]))
        history.append(here.value + Penalty.of(strength, labels_at, pairs, n_leaves).value(x[1:]))
        nodes, earlier = (np.hstack([leaf, np.vstack([np.zeros(len(labels)), label])]) for leaf, label in ((x, labels_at), (before, labels_before)))
        if converged(number, np.linalg.norm(nodes - earlier, axis=0).tolist(), np.linalg.norm(nodes, axis=0).tolist(), outer, config.tolerance):
            break
    held.close()
    slope = x[1:] / sd[:, None]
    return Model(features, leaves, labels, np.vstack([x[0] - mean @ slope, slope]), labels_at / sd[:, None], history)


def train(sites: DataFrame, config: AnalysisConfig) -> Model:
    """sites (site_id, annotation, seq) to a model of all classes and shared labels."""
    from . import kmers, labels

    usable = cut(kmers.clean(sites).select("site_id", "annotation", "seq"))
    nodes = labels.hierarchy(usable).where("is_leaf").orderBy("node_idx").collect()
    if not nodes:
        raise ValueError("no sites to learn from")
    leaves = [r.name for r in nodes]
    parents = {r.name: list(r.parents) for r in nodes}
    of_class = {name.split("Only#")[-1]: name for name in leaves}
    per_class = {of_class[r.subgroup]: (r.n, r.weight) for r in labels.weights(usable).withColumn("subgroup", labels.subgroup(F.col("annotation"))).collect()}
    leaf_of = F.create_map(*[F.lit(v) for pair in of_class.items() for v in pair])
    marked = usable.select("site_id", F.element_at(leaf_of, labels.subgroup(F.col("annotation"))).alias("leaf"), "seq")
    weight_of = {name: float(w) for name, (_, w) in per_class.items()}
    weighed = F.element_at(F.create_map(*[F.lit(v) for pair in weight_of.items() for v in pair]), F.col("leaf")).alias("weight")
    n = sum(v[0] for v in per_class.values())
    blocks = max(config.blocks, -(-n // BLOCK_SITES))
    if config.kmax <= DENSE_KMAX and usable.where(F.col("seq").rlike("[^ACGT]")).isEmpty():
        total = sum(size * w for size, w in per_class.values())
        blocks = max(blocks, min(usable.sparkSession.sparkContext.defaultParallelism, n // LEAST_SITES))
        stats = dense_stats(marked.select("seq", weighed), float(total), config.kmin, config.kmax).where("sd > 0").orderBy("kmer").collect()
        data, fitting = dense_blocks(marked, [r.kmer for r in stats], leaves, weight_of, config.kmin, config.kmax, blocks), fit_dense
    else:
        counts = cut(kmers.site_counts(usable, config.kmin, config.kmax).select("site_id", "kmer", "cnt"))
        stats = kmers.feature_stats(counts, marked.select("site_id", weighed)).where("sd > 0").orderBy("kmer").collect()
        data, fitting = make_blocks(counts, marked.drop("seq"), [r.kmer for r in stats], leaves, weight_of, blocks), fit
    support = np.array([per_class[name][0] for name in leaves], float)
    return fitting(data, blocks, [r.kmer for r in stats], leaves, parents, np.array([r["mean"] for r in stats]), np.array([r.sd for r in stats]), support, config)


def cross_validate(sites: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(site_id, annotation, model, prob): posteriors of each site by the model of the other folds."""
    from . import infer, labels

    folds = cut(labels.stratified_folds(sites, config.folds).select("site_id", "fold"))
    out = None
    for fold in range(config.folds):
        inner = sites.join(folds.where(F.col("fold") != fold), "site_id", "left_semi")
        model = train(inner, config)
        spark = sites.sparkSession
        leaves = model.table(spark).where(F.col("model").isin(model.leaves))
        weights = leaves.where("feature <> '(Intercept)'").select("model", F.col("feature").alias("kmer"), F.col("value").alias("weight"))
        intercepts = leaves.where("feature = '(Intercept)'").select("model", F.col("value").alias("intercept"))
        held = sites.join(folds.where(F.col("fold") == fold), "site_id", "left_semi")
        found = infer.posteriors(held, weights, config.kmin, config.kmax, intercepts).join(held.select("site_id", "annotation"), "site_id")
        out = found if out is None else out.unionByName(found)
    return out.select("site_id", "annotation", "model", "prob")
