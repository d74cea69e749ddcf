from seqprism.operators import intervals

TAKEN = "id long, chrom string, start long, end long"


def test_tight_space_is_filled_until_nothing_more_is_found(spark):
    # 2,000 places hold at most 20 windows of 100, so 500 cannot be found; the first ones found stay.
    genome = spark.createDataFrame([("x", 2000), ("z", 50)], "chrom string, length long")
    taken = spark.createDataFrame([(1, "x", 0, 499), (2, "y", 0, 10)], TAKEN)
    few = [tuple(r) for r in intervals.random_regions(genome, taken, 2, 100, 5).collect()]
    many = [tuple(r) for r in intervals.random_regions(genome, taken, 500, 100, 5).collect()]
    assert len(few) == 2 and many[:2] == few and 2 < len(many) <= 15
    assert all(c == "x" and s >= 500 and e == s + 99 and e < 2000 for _, c, s, e in many)


def test_no_genome_has_no_regions(spark):
    empty = spark.createDataFrame([], "chrom string, length long")
    assert intervals.random_regions(empty, spark.createDataFrame([], TAKEN), 5, 100, 5).count() == 0
