from pyspark.sql import functions as F

from seqprism.operators import hills, kmers


def test_counts_keep_columns_of_a_site(spark):
    df = spark.createDataFrame([(1, "ACGTA", 2.0), (2, "TACGT", 1.0), (3, "ACG", 1.0), (4, "", None)], "site_id long, seq string, weight double")
    found = kmers.site_counts(df, 4, 5, ("weight",))
    assert found.columns == ["site_id", "weight", "k", "kmer", "cnt"]
    by_site = lambda n: sorted((r.kmer, r.cnt) for r in found.where(F.col("site_id") == n).collect())
    # The two are reverse complements; a sequence that is too short has none.
    assert by_site(1) == by_site(2) == [("ACGT", 1), ("ACGTA", 1), ("CGTA", 1)]
    assert by_site(3) == by_site(4) == []
    sums = {r.kmer: r.cnt for r in kmers.class_counts(df.withColumn("lang", F.lit("x")), "lang", 4, 5).collect()}
    assert sums == {"ACGT": 2, "ACGTA": 2, "CGTA": 2}


def test_useless_features_are_those_of_all_or_of_none(spark):
    df = spark.createDataFrame([(1, "AAAAC"), (2, "AAAAG")], "site_id long, seq string")
    useless = {r.kmer for r in kmers.constant_features(kmers.site_counts(df, 4, 4), 2, 4, 4).collect()}
    assert len(useless) == 256 - 2 and "AAAA" in useless and "TTTT" in useless and not useless & {"AAAC", "AAAG"}


def test_scores_of_windows_shorter_than_the_longest_kmer(spark):
    scans = spark.createDataFrame([(1, "m", "ACGTAC"), (2, "m", "ACG"), (3, "m", "")], "site_id long, model string, seq string")
    weights = spark.createDataFrame([("m", "ACGT", 1.0), ("m", "ACGTA", 10.0), ("m", "CGTA", 0.5)], "model string, kmer string, weight double")
    got = {r.site_id: {(w.len, w.start): w.score for w in r.windows} for r in hills.window_scores(scans, weights, 4, 5, 4, 6).collect()}
    # GTAC is its own reverse complement and has no weight, as has CGTAC (GTACG).
    assert got[1] == {(4, 0): 1.0, (4, 1): 0.5, (4, 2): 0.0, (5, 0): 11.5, (5, 1): 0.5, (6, 0): 11.5}
    assert got[2] == got[3] == {}
