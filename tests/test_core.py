"""Operators on rows that are computed by hand, and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqprism.config import AnalysisConfig
from seqprism.functions import scores, sequence
from seqprism.operators import cluster, hills, infer, intervals, kmers, labels, motifs, simulate, stats, train
from seqprism.operators.ranking import ranked
from seqprism.sources import readers, writers
from seqprism.streaming.scoring import score_rows


@pytest.fixture(scope="module")
def sites(spark):
    rows = [(1, "en;hi", "ACGTACGTAC"), (2, "en;lo", "AATTCCGG"), (3, "de;hi", "TTTTTTT"), (4, "en;hi", "ACG"), (5, "de;hi", "GATNACA")]
    return spark.createDataFrame(rows, "site_id long, annotation string, seq string")


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGT",), ("AATT",), ("TTTA",), ("CCCC",)], "s string")
    rows = df.select("s", sequence.reverse_complement(F.col("s")).alias("r"), sequence.canonical(F.col("s")).alias("c"), sequence.kmer_code(F.col("s")).alias("n"), sequence.feature_index(F.col("s"), 3).alias("f")).collect()
    assert [(r.r, r.c, r.n) for r in rows] == [("ACGT", "ACGT", 27), ("AATT", "AATT", 15), ("TAAA", "TAAA", 252), ("GGGG", "CCCC", 85)]
    assert rows[0].f == 64 + 27


def test_counts_sum_to_places_and_ignore_strand(spark, sites):
    clean = kmers.clean(sites)
    assert {r.site_id for r in clean.collect()} == {1, 2, 3, 4}
    total = {r.site_id: r.n for r in kmers.site_counts(clean, 4, 5).groupBy("site_id").agg(F.sum("cnt").alias("n")).collect()}
    assert total == {1: 7 + 6, 2: 5 + 4, 3: 4 + 3}
    flipped = clean.withColumn("seq", sequence.reverse_complement(F.col("seq")))
    assert sorted(map(tuple, kmers.site_counts(flipped, 4, 5).collect())) == sorted(map(tuple, kmers.site_counts(clean, 4, 5).collect()))


def test_labels_and_limits(spark, sites):
    assert {(r.annotation, r.n) for r in labels.counts(sites).collect()} == {("en;hi", 2), ("en;lo", 1), ("de;hi", 2)}
    assert {r.annotation for r in labels.keep_frequent(sites, 2).select("annotation").collect()} == {"en;hi", "de;hi"}
    assert {(r.label, r.n_subgroups) for r in labels.fan_out(sites).collect()} == {("en", 2), ("hi", 2)}
    nodes = {r.name: r for r in labels.hierarchy(sites).collect()}
    assert nodes["en#hi"].node_idx == 0 and nodes["en#hi"].parents == ["en", "hi"] and nodes["hi"].children == ["de#hi", "en#hi"]
    assert {(r.name, r.n) for r in labels.node_support(sites).collect()} >= {("en", 3), ("hi", 4)}
    merged = {r.site_id: r.merged for r in labels.merge_low(sites, 2, 1).collect()}
    assert merged[2] == "en;lo"  # the only class with a shared label is at the limit, not above it
    renamed = spark.createDataFrame([(1, "x"), (2, "x;y"), (3, "y;z")], "site_id long, annotation string")
    assert "xOnly#x" in {r.name for r in labels.hierarchy(renamed).collect()}


def test_ranked_matches_a_window(spark):
    rows = [(i % 2, random.Random(i).randrange(5), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v int, i long")
    got = {r.i: r["rank"] for r in ranked(df, "g", [F.desc("v"), F.col("i").asc()]).collect()}
    for g in (0, 1):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_online_suppression_differs_from_ordinary():
    # The third window drops the first and is then rejected by the second: its place stays empty.
    rows = [(0, 4, 1.0), (5, 4, 3.0), (2, 5, 2.0)]
    assert hills.suppress_online(rows) == [(5, 4, 3.0)]
    assert hills.suppress_online([(0, 4, 1.0), (1, 4, 1.0)]) == [(1, 4, 1.0)]
    assert hills.suppress_online([(0, 4, 1.0), (1, 4, 1.0)], equal_coexists=True) == [(0, 4, 1.0), (1, 4, 1.0)]


def test_window_scores_against_plain_sums(spark):
    seq = "ACGTTGCAACGGTA"
    other = str.maketrans("ACGT", "TGCA")
    words = sorted({min(w, w.translate(other)[::-1]) for k in (4, 5) for w in (seq[i : i + k] for i in range(len(seq) - k + 1))})
    of = {w: round((i * 37 % 11 - 5) / 7, 6) for i, w in enumerate(words)}
    weights = spark.createDataFrame([("m", w, v) for w, v in of.items()], "model string, kmer string, weight double")
    scans = spark.createDataFrame([(1, "m", seq), (2, "m", "AC")], "site_id long, model string, seq string")
    got = {r.site_id: r.windows for r in hills.window_scores(scans, weights, 4, 5, 6, 8).collect()}
    assert got[2] == [] and len(got[1]) == 9 + 8 + 7
    for w in got[1]:
        part = seq[w.start : w.start + w.len]
        want = sum(of[min(x, x.translate(other)[::-1])] for k in (4, 5) for x in (part[i : i + k] for i in range(len(part) - k + 1)))
        assert w.score == pytest.approx(want, abs=2e-6)
    found = hills.hills(scans, {"m": of}, 4, 5, 6, 8, 0.1).collect()
    best = max(got[1], key=lambda w: w.score)
    assert max(r.score for r in found) == pytest.approx(best.score, abs=2e-6)
    spots = sorted((r.start, r.start + r["len"]) for r in found)
    assert all(a[1] <= b[0] for a, b in zip(spots, spots[1:], strict=False))


def test_streamed_rows_agree_with_batch(spark):
    seqs = spark.createDataFrame([(1, "ACGTACGT"), (2, "AAAAACCC")], "site_id long, seq string")
    of = {"a": {"ACGT": 1.0, "AAAA": -0.5}, "b": {"CCCC": 2.0, "AAAA": 0.25}}
    weights = spark.createDataFrame([(m, k, w) for m, d in of.items() for k, w in d.items()], "model string, kmer string, weight double")
    batch = {(r.site_id, r.model): r.prob for r in infer.posteriors(seqs, weights, 4, 4).collect()}
    row = {r.site_id: r.posterior for r in score_rows(seqs, of, 4, 4).collect()}
    assert row[2]["a"] == pytest.approx(batch[2, "a"]) and sum(row[1].values()) == pytest.approx(1)


def test_measures(spark):
    rows = [("m", 0.9, True), ("m", 0.8, False), ("m", 0.8, True), ("m", 0.1, False)]
    df = spark.createDataFrame(rows, "model string, score double, positive boolean")
    assert infer.roc_area(df).first().roc_area == pytest.approx(3.5 / 4)
    assert infer.prc_area(df).first().prc_area == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "actual string, predicted string")
    got = {r["class"]: r for r in infer.confusion_metrics(pairs).collect()}
    assert got["a"].tp_rate == 0.5 and got["a"].precision == 1 and got["b"].fp_rate == 0.5


def test_intervals_against_all_pairs(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice("xy"), s, s + draw.randrange(200)) for i in range(80) for s in [draw.randrange(1000)]]
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long")
    got = sorted((r.id, r.r_id, r.overlap) for r in intervals.overlaps(df, df, 50).collect())
    want = sorted((a[0], b[0], min(a[3], b[3]) - max(a[2], b[2]) + 1) for a in rows for b in rows if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert got == want
    genome = spark.createDataFrame([("x", 5000), ("y", 3000)], "chrom string, length long")
    found = [(r.chrom, r.start, r.end) for r in intervals.random_regions(genome, df, 10, 100, 7).collect()]
    assert len(found) == 10 and all(c != o[1] or e < o[2] or s > o[3] for c, s, e in found for o in rows)
    assert all(a[0] != b[0] or a[2] < b[1] or b[2] < a[1] for a in found for b in found if a != b)


def test_statistics(spark):
    weights = spark.createDataFrame([("m", "ACGT", 1.0), ("m", "AAAA", -2.0)], "model string, kmer string, weight double")
    sums = {r.dimer: r.total for r in stats.dimer_sums(weights).collect()}
    assert sums["CG"] == 1.0 and sums["AA"] == -2.0 and sums["AC"] == 1.0 and sums["GC"] == 0.0
    seqs = spark.createDataFrame([(1, "CGCGA"), (2, "A"), (3, "AAAA")], "site_id long, seq string")
    totals = {r.site_id: (r.n_cg, r.frac_cg) for r in stats.cg_totals(seqs).collect()}
    assert totals == {1: (2, 1.0), 2: (0, None), 3: (0, 0.0)}


def test_clusters(spark):
    random_ = np.random.default_rng(0)
    points = np.concatenate([random_.normal(c, 0.05, (40, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    quality, k, means = cluster.select_k(points, np.arange(120) // 40, spark, (2, 3, 4), 4)
    assert k == 3 and len(means) == 3 and quality.count() == 12
    df = spark.createDataFrame([(i, 0, [float(x), float(y)]) for i, (x, y) in enumerate(points)], "id long, c int, v array<double>")
    want = min(range(120), key=lambda i: (round(float(np.sqrt(((points - points[i]) ** 2).sum(1)).mean()), 6), i))
    assert cluster.medoids(df, "c", "id", "v", block=32).first().medoid == want


def test_motifs(spark):
    rows = spark.createDataFrame([("m", "ACG"), ("m", "ACT"), ("m", "CCG")], "motif string, hill string")
    found = motifs.from_windows(rows)
    assert motifs.consensus(found).first().consensus == "ACG"
    assert motifs.consensus(motifs.reverse_complement(found)).first().consensus == "CGT"
    random_ = np.random.default_rng(1)
    seqs = ["".join(random_.choice(list("ACGT"), 8)) + "TGACTCA" + "".join(random_.choice(list("ACGT"), 8)) for _ in range(60)]
    number, matrix, area = motifs.discover_all(seqs, 1, 7, 7, 1)[0]
    word = "".join("ACGT"[i] for i in matrix.argmax(axis=1))
    assert word in ("TGACTCA", "TGAGTCA") and area > 0.9 and motifs.roc(np.array([1.0, 2]), np.array([0.0, 2])) == 0.625


def test_training_finds_planted_words(spark):
    strong = lambda word: np.array([[0.97 if b == x else 0.01 for b in "ACGT"] for x in word])
    data = simulate.simulate(spark, {"X;A": 60, "Y;A": 60, "Y;B": 60, "X;B": 60}, {"X": strong("TGACTCA"), "Y": strong("CACGTGC")}, {"": [0.25] * 4}, 80, 0.95, 3)
    assert simulate.class_balance(data).count() == 4
    assert sorted(map(tuple, data.collect())) == sorted(map(tuple, data.repartition(3).collect()))
    config = AnalysisConfig(kmin=4, kmax=4, blocks=2, outer_rounds=2, admm_rounds=8, regularization=0.5)
    model = train.train(data, config)
    assert model.labels == ["A", "B", "X", "Y"] and len(model.leaves) == 4
    at = {f: i for i, f in enumerate(model.features)}
    x, y = (model.label_weights[:, model.labels.index(k)] for k in "XY")
    assert x[at["GTCA"]] - y[at["GTCA"]] > 0 and y[at["CACG"]] - x[at["CACG"]] > 0
    assert all(math.isfinite(v) for v in model.objective)


def test_lbfgs_and_lower_median():
    a = np.diag([1.0, 10.0, 100.0])
    b = np.array([1.0, 2.0, 3.0])
    assert train.lbfgs(lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b), np.zeros(3), eps=1e-8) == pytest.approx(np.linalg.solve(a, b), rel=1e-5)
    assert train.lower_median(np.array([[4.0], [1.0], [3.0], [2.0]])).tolist() == [2.0]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# note\nacgt\ten;hi\nTTTT\tde\n")
    assert [(r.seq, r.annotation) for r in readers.labelled_sequences(spark, str(tmp_path / "s.txt")).collect()] == [("ACGT", "en;hi"), ("TTTT", "de")]
    (tmp_path / "l.txt").write_text("chr1:1000\ta;b\nchr2:50-60\tc\n")
    loci = readers.labelled_loci(spark, str(tmp_path / "l.txt"), 10).collect()
    assert [(r.chrom, r.start, r.end) for r in loci] == [("chr1", 995, 1004), ("chr2", 50, 59)]
    (tmp_path / "f.fa").write_text(">one x\nACG\nT\n>two\nGG\n")
    assert [(r.name, r.seq) for r in readers.fasta(spark, str(tmp_path / "f.fa")).collect()] == [("one x", "ACGT"), ("two", "GG")]
    genome = spark.createDataFrame([("c", "ACGTACGTAC")], "chrom string, seq string")
    places = spark.createDataFrame([("c", 2, 7)], "chrom string, start long, end long")
    assert readers.region_sequences(places, readers.cut_genome(genome, 4), 4).first().seq == "GTACGT"
    rows = spark.createDataFrame([("m1", 0, 0.5, 0.5, 0.0, 0.0), ("m1", 1, 0.0, 0.0, 0.25, 0.75)], "motif string, pos int, a double, c double, g double, t double")
    writers.motifs(rows, str(tmp_path / "m"))
    assert sorted(map(tuple, readers.motifs(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, rows.collect()))
    weights = spark.createDataFrame([("a", "ACGT", 1.5), ("b", "AAAA", -1.0), ("a", "(Intercept)", 0.5)], "model string, kmer string, weight double")
    writers.weight_matrix(weights, kmers.all_kmers(spark, 4, 4).select("kmer"), str(tmp_path / "w"))
    back, intercepts = readers.coefficients(spark, str(tmp_path / "w"))
    assert back.where("model = 'a' AND kmer = 'ACGT'").first().weight == 1.5 and intercepts.where("model = 'a'").first().intercept == 0.5
    assert "<svg" in writers.heat_map(spark.createDataFrame([("m", "a", 0.2)], "motif string, model string, score double"))


def test_colors_and_threshold(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.4,)], "v double")
    rows = df.select(scores.heat_color(F.col("v")).alias("c"), scores.soft_threshold(F.col("v"), 0.25).alias("s")).collect()
    assert [r.c for r in rows] == ["#0000ff", "#000000", "#ffff00"] and [round(r.s, 6) for r in rows] == [-0.75, 0.0, 0.15]
