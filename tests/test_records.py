"""Text records at every way of splitting their files."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from seqprism.plans.files import score_fasta
from seqprism.sources import readers
from seqprism.sources.records import RecordReader


def test_every_split_has_the_same_records(tmp_path):
    (tmp_path / "a.txt").write_bytes(b"; note\n>a >\nAC\n\n>b\r\nG>T\n>" + b"x" * 70_000 + b">\n>c")

    def read(size: int) -> list[tuple]:
        reader = RecordReader({"path": str(tmp_path), "start": ">", "splitbytes": str(size)}, None)
        return [tuple(r.values()) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]

    whole = read(1 << 20)
    assert [r[2] for r in whole] == [7, 16, 24, 70_027] and len(whole[2][3]) == 70_003
    assert all(read(size) == whole for size in (*range(3, 40), 70_000))


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_marks_inside_a_line_do_not_split_a_record(spark, tmp_path, size):
    (tmp_path / "a.fa").write_text("; note\n>one x>y\nACG\nT\n\n>two >\nGG\n>empty\n>last\nTT", newline="")
    (tmp_path / "b.fa").write_text(">one x>y\r\nAC\r\nGT\r\n", newline="")
    got = sorted(map(tuple, readers.fasta(spark, str(tmp_path), splitbytes=str(size)).select("name", "seq").collect()))
    assert got == [("empty", ""), ("last", "TT"), ("one x>y", "ACGT"), ("one x>y", "ACGT"), ("two >", "GG")]


@pytest.mark.parametrize("size", [9, 1 << 20])
def test_transfac_records(spark, tmp_path, size):
    (tmp_path / "m.txt").write_text("VV 1\nXX\nDE\tfoXXA\n0\t1\t0\t0\t0\nXX\n5\t9\t9\t9\t9\nDE\tDEX\n0\t0\t0\t0.5\t0.5\n1\t0\t1\t0\t0\n")
    got = sorted(map(tuple, readers.motifs(spark, str(tmp_path / "m.txt"), splitbytes=str(size)).collect()))
    assert got == [("DEX", 0, 0.0, 0.0, 0.5, 0.5), ("DEX", 1, 0.0, 1.0, 0.0, 0.0), ("foXXA", 0, 1.0, 0.0, 0.0, 0.0)]


def test_ids_survive_another_read(spark, tmp_path):
    draw = random.Random(3)
    lines = ["".join(draw.choice("acgt") for _ in range(draw.randrange(1, 200))) + "\ta;b" for _ in range(300)]
    (tmp_path / "s1.txt").write_text("# note\n" + "\n".join(lines[:200]) + "\n\n")
    (tmp_path / "s2.txt").write_text("\n".join(lines[200:]))
    reads = [{r.site_id: r.seq for r in readers.labelled_sequences(spark, str(tmp_path), splitbytes=str(n)).collect()} for n in (5000, 9000, 1 << 20)]
    assert reads[0] == reads[1] == reads[2] and sorted(reads[0].values()) == sorted(line.split("\t")[0].upper() for line in lines)
    assert min(reads[0]) == len("# note\n")


def test_no_records(spark, tmp_path):
    (tmp_path / "e.fa").write_text("")
    assert readers.fasta(spark, str(tmp_path)).count() == 0
    (tmp_path / "e.fa").write_text("ACGT\nno mark\n")
    assert readers.fasta(spark, str(tmp_path), splitbytes="4").count() == 0
    with pytest.raises(Exception, match="absent"):
        readers.fasta(spark, str(tmp_path / "absent")).count()


@pytest.mark.parametrize("chunk", [4, 7, 1 << 16])
def test_regions_over_the_borders_of_chunks(spark, tmp_path, chunk):
    draw = random.Random(chunk)
    genome = {name: "".join(draw.choice("ACGTN") for _ in range(n)) for name, n in (("c1", 101), ("c2", 28), ("c3", 1))}
    (tmp_path / "g.fa").write_text("".join(f">{name} of {len(s)}\n" + "".join(s[i : i + 10] + "\n" for i in range(0, len(s), 10)) for name, s in genome.items()))
    rows = [(c, a, a + draw.randrange(40)) for c in ("c1", "c2", "c3", "c4") for a in (draw.randrange(120) for _ in range(12))]
    rows.append(rows[0])
    want = sorted((c, a, b, genome[c][a : b + 1]) for c, a, b in rows if genome.get(c, "")[a : b + 1])
    places = spark.createDataFrame(rows, "chrom string, start long, end long")
    cut = readers.cut_genome(spark.createDataFrame(list(genome.items()), "chrom string, seq string"), chunk)
    read = readers.genome_chunks(spark, str(tmp_path / "g.fa"), chunk, splitbytes="33")
    for chunks in (cut, read):
        assert sorted(map(tuple, readers.region_sequences(places, chunks, chunk).collect())) == want


def test_cutting_takes_linear_time(spark):
    def seconds(letters: int) -> float:
        genome = spark.range(1).select(F.lit("c").alias("chrom"), F.repeat(F.lit("ACGT"), letters // 4).alias("seq"))
        begun = time.monotonic()
        assert readers.cut_genome(genome, 1000).count() == letters // 1000
        return time.monotonic() - begun

    seconds(1_000_000)
    # 16 times the letters: 256 times the time if each chunk counted from the beginning.
    assert seconds(64_000_000) < 60 * max(seconds(4_000_000), 0.1)


def test_fasta_to_posteriors(spark, tmp_path):
    (tmp_path / "f.fa").write_text(">s1 >x\nacg\ntN\n>s2\nTTTT\n>s3\nAC\n")
    (tmp_path / "w.tsv").write_text("#Variable\ta\tb\nACGT\t1\t0\nAAAA\t0\t2\n(Intercept)\t0.5\t0\n")
    got = {(r.name, r.model): (r.logit, r.prob) for r in score_fasta(spark, str(tmp_path / "f.fa"), str(tmp_path / "w.tsv"), 4, 4, splitbytes="5").collect()}
    assert {k: v[0] for k, v in got.items()} == {("s1 >x", "a"): 1.5, ("s1 >x", "b"): 0.0, ("s2", "a"): 0.5, ("s2", "b"): 2.0}
    assert got["s1 >x", "a"][1] == pytest.approx(1 / (1 + math.exp(-1.5)))
