"""Wide tables are read back as they were written."""

from pathlib import Path

from seqprism.operators import kmers
from seqprism.sources import readers, writers

WORDS = ["AAAA", "AAAC", "ACGT", "CCCC"]


def _parts(folder) -> list[list[str]]:
    return [p.read_text().splitlines() for p in sorted(Path(folder).glob("part-*")) if p.stat().st_size]


def _rows(spark):
    rows = [(i, ("x;y", "it's", None, "other")[i % 4], ("ACGTACGTACGT", "AAAAC", "GGGG", "ACG")[i % 4]) for i in range(40)]
    return spark.createDataFrame(rows, "site_id long, annotation string, seq string").repartition(4)


def test_count_matrix(spark, tmp_path):
    sites = _rows(spark)
    counts = kmers.site_counts(sites, 4, 4)
    writers.count_matrix(counts, sites, WORDS, str(tmp_path / "m"))
    got = {(r.site_id, r.kmer): (r["class"], r.cnt) for r in readers.count_matrix(spark, str(tmp_path / "m")).collect()}
    want = {(r.site_id, w): (r.annotation, 0.0) for r in sites.collect() for w in WORDS}
    for r in counts.collect():
        if r.kmer in WORDS:
            want[r.site_id, r.kmer] = (want[r.site_id, r.kmer][0], float(r.cnt))
    assert got == want and got[0, "ACGT"] == ("x;y", 3.0) and got[3, "AAAA"] == ("other", 0.0)
    lines = _parts(tmp_path / "m")
    assert all(part[0] == "\t".join(["site_id", *WORDS, "class"]) for part in lines)
    assert [int(x.split("\t")[0]) for part in lines for x in part[1:]] == list(range(40))


def test_arff(spark, tmp_path):
    sites = _rows(spark)
    writers.arff(kmers.site_counts(sites, 4, 4), sites, WORDS, ["x;y", "it's"], str(tmp_path / "a"))
    lines = [x for part in _parts(tmp_path / "a") for x in part]
    assert lines[:7] == ["@relation 'sites'", *[f"@attribute {w} numeric" for w in WORDS], "@attribute class {'x;y','it\\'s'}", "@data"]
    assert lines[7:11] == ["{2 3, 4 'x;y'}", "{0 1, 1 1, 4 'it\\'s'}", "{3 1, 4 ?}", "{4 ?}"] and len(lines) == 47
    writers.arff(kmers.site_counts(sites.limit(0), 4, 4), sites.limit(0), WORDS, [], str(tmp_path / "e"))
    assert [x for part in _parts(tmp_path / "e") for x in part][-2:] == ["@attribute class {}", "@data"]


def test_score_tables(spark, tmp_path):
    scores = spark.createDataFrame([("m2", "a", 1.0), ("m1", "a#b", 2.0), ("m1", "a", 0.5), ("m#", "a", 3.0)], "motif string, model string, score double")
    writers.motif_scores(scores, ["b", "a", "a#b"], str(tmp_path / "s"))
    assert {x for part in _parts(tmp_path / "s") for x in part} == {"motif\tb\ta\ta#b", 'm#\t\t3.0\t', 'm1\t\t0.5\t2.0', 'm2\t\t1.0\t'}
    writers.simple_scores(scores, ["b", "a", "a#b"], str(tmp_path / "t"))
    assert {x for part in _parts(tmp_path / "t") for x in part} == {"motif\tb\ta", 'm1\t\t0.5', 'm2\t\t1.0'}
    back = {(r.motif, r.model): r.score for r in readers.score_matrix(spark, str(tmp_path / "s")).collect()}
    assert back["m1", "a#b"] == 2.0 and back["m1", "b"] is None and len(back) == 9
