"""Quality rules with risk-controlled thresholds (operator 5).

A document fails on a few fixed base rules, or on one of five statistics above its stratum's cutoff.
The cutoffs come from labelled documents. A third of them, chosen by a hash, proposes for each budget
of false rejections the strictest cutoff of each rule that keeps to it and rejects more bad documents
than good ones: a sequence of sets of cutoffs, each stricter than the one before. The other two thirds
test the sets in that order: the exact binomial tail tells how likely so few good documents would be
rejected if the true rate of false rejection, of all rules together, were the permitted one. A set is
admissible where that probability is at most the level divided by the number of strata, and only if
all sets before it are (a fixed sequence needs no division by its length), so with probability
1 - level no stratum's rules reject more than the permitted share of its good documents. The strictest
admissible set is taken, and none where there is none. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_remainder, let

#: The characters that count as symbols, and white space between words.
SYMBOLS = r"[#*$%&|<>]"
SPACE = r"\x20\x09-\x0D"
WINDOW = 8

#: Candidate cutoffs of each statistic (per mille; tenths of a character for word_length).
CUTOFFS = {
    "symbols": [5, 10, 20, 30, 50, 80, 120, 180, 250, 350, 500, 700],
    "dup_lines": [5, 10, 20, 30, 50, 80, 120, 180, 250, 350, 500, 700],
    "repeats": [5, 10, 20, 30, 50, 80, 120, 180, 250, 350, 500, 700],
    "uppercase": [50, 80, 120, 180, 250, 350, 500, 700],
    "word_length": [60, 70, 80, 90, 100, 120, 150, 200],
}
#: Permitted share of good documents that a stratum's rules reject together, and the level.
RISK, LEVEL = 0.05, 0.05
#: Shares of good documents, per mille, that a proposed cutoff may reject.
BUDGETS = [0, 2, 5, 10, 20, 30]
#: One row of cutoffs is broadcast for each stratum up to this many (a few numbers each); beyond it
#: they are joined, with the rows of a stratum cut into parts.
BROADCAST_STRATA, SALTS = 10_000, 64


def _repeated(hashes: Column) -> Column:
    """Words inside WINDOW-word windows that are found twice or more; hashes: one long per word."""

    def covered(grams: Column) -> Column:
        def flagged(ordered: Column) -> Column:
            same = lambda x, i, by: F.coalesce(F.get(ordered, i + by)["g"] == x["g"], F.lit(False))
            places = F.filter(ordered, lambda x, i: same(x, i, -1) | same(x, i, 1))
            return F.array_sort(F.transform(places, lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        add = lambda held, i: F.struct((held["n"] + i + WINDOW - F.greatest(held["end"], i)).alias("n"), (i + WINDOW).alias("end"))
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i"))))
        total = F.aggregate(let(ordered, flagged), start, add)["n"]
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(total)

    grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(grams, covered))


def statistics(text: Column) -> Column:
    """Struct of the base counts and of the tested statistics, over the whole text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    blanks = F.lit(" \t\n\v\f\r")

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n"), F.length(F.array_join(words, "")).cast("long").alias("chars"),
            let(F.transform(words, lambda w: F.xxhash64(w)), _repeated).alias("repeated"),
        )

    def of_text(t: Column) -> Column:
        trimmed = F.btrim(t, blanks)
        words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
        lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, blanks) != "")
        return F.struct(
            let(words, of_words).alias("w"), let(lines, of_lines).alias("l"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("symbols"), F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("upper"),
        )

    def rates(c: Column) -> Column:
        words, chars = c["w"]["n"], c["w"]["chars"]
        share = lambda part, of, scale=1000: F.floor(part * scale / F.greatest(of, F.lit(1))).cast("long")
        return F.struct(
            words.alias("n_words"), chars.alias("word_chars"), c["symbols"].alias("n_symbols"), c["l"]["dup"].alias("n_dup_lines"), c["w"]["repeated"].alias("n_repeat_words"),
            ((words < 20) | (100 * c["w"]["repeated"] > 30 * words)).alias("base_failed"),
            share(c["symbols"], chars).alias("symbols"), share(c["l"]["dup"], c["l"]["n"]).alias("dup_lines"), share(c["w"]["repeated"], words).alias("repeats"),
            share(c["upper"], chars).alias("uppercase"), share(chars, words, 10).alias("word_length"),
        )

    return let(let(text, of_text), rates)


def binomial_log_tail(rejected: Column, n: Column, risk: float) -> Column:
    """log P(X <= rejected) for X ~ Binomial(n, risk)."""
    odds = F.lit(risk / (1 - risk))

    def add(held: Column, i: Column) -> Column:
        term = held["term"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(held["sum"], term), F.least(held["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    none = n * F.log1p(F.lit(-risk))
    steps = F.when(rejected > 0, F.sequence(F.lit(1).cast("long"), rejected)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, F.struct(none.alias("term"), none.alias("sum")), add)["sum"]


def proposes(key: str) -> Column:
    """Whether a labelled document proposes cutoffs (one in three) rather than tests them."""
    return id_remainder(key, 3) == 0


def proposals(labelled: DataFrame) -> DataFrame:
    """(stratum, budget, limits): the set of cutoffs for each budget, from the proposing documents.

    One aggregation with a partial sum on each task; its grid has a few columns for each of CUTOFFS,
    whatever the rows.
    """
    sums = []
    for rule, cutoffs in CUTOFFS.items():
        for c in cutoffs:
            over = F.col("s")[rule] > c
            sums.append(F.struct(
                F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"),
                F.count_if(over & F.col("good")).alias("good_rejected"), F.count_if(over & ~F.col("good")).alias("bad_rejected"),
            ))
    grid = labelled.where("proposes").groupBy("stratum").agg(F.count_if("good").alias("n"), F.array(*sums).alias("grid"))
    cells = grid.select("stratum", "n", F.explode("grid").alias("g")).select("stratum", "n", "g.*").where("bad_rejected > good_rejected")
    budgets = F.explode(F.array(*map(F.lit, BUDGETS))).alias("budget")
    within = cells.select("*", budgets).where(F.col("good_rejected") * 1000 <= F.col("budget") * F.col("n"))
    return within.groupBy("stratum", "budget").agg(F.struct(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in CUTOFFS]).alias("limits"))


def rejected(limits: Column) -> Column:
    """Whether a statistic lies above its cutoff; null cutoffs reject nothing."""
    over = F.lit(False)
    for rule in CUTOFFS:
        over |= F.coalesce(F.col("s")[rule] > limits[rule], F.lit(False))
    return over


def calibrate(labelled: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, limits): the cutoffs of each stratum with an admissible set of them.

    labelled: stratum, good, proposes (booleans), s (struct with the statistics), without documents
    that the base rules reject.
    """
    labelled = labelled.select("stratum", "good", "proposes", F.struct(*[F.col("s")[r].alias(r) for r in CUTOFFS]).alias("s"))
    sets = proposals(labelled).groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("budget", "limits"))).alias("sets"))
    judges = labelled.where("good AND NOT proposes")
    # A handful of sets for each stratum; texts aren't among these columns.
    counts = judges.groupBy("stratum").agg(F.count("*").alias("judges"))
    strata = F.count("*").over(Window.partitionBy())
    bounds = counts.withColumn("bound", F.log(F.lit(level) / strata))
    wide = with_limits(judges, sets, "sets", "judge").select("stratum", F.explode("sets").alias("set"), "s")
    tests = wide.groupBy("stratum", F.col("set.budget").alias("budget")).agg(F.any_value("set.limits").alias("limits"), F.count_if(rejected(F.col("set.limits"))).alias("rejected"))
    tails = tests.join(bounds, "stratum").withColumn("passed", binomial_log_tail(F.col("rejected"), F.col("judges"), risk) <= F.col("bound"))
    # Sets are nested, so the rejected only grow; the first that fails ends the sequence.
    first = tails.groupBy("stratum").agg(F.min(F.when(~F.col("passed"), F.col("budget"))).alias("failed"), F.collect_list(F.struct("budget", "limits")).alias("sets"))
    open_sets = F.filter("sets", lambda x: F.col("failed").isNull() | (x["budget"] < F.col("failed")))
    return first.select("stratum", F.array_max(F.transform(open_sets, lambda x: F.struct(x["budget"], x["limits"])))["limits"].alias("limits")).where("limits IS NOT NULL")


def with_limits(df: DataFrame, sets: DataFrame, name: str, spread: str) -> DataFrame:
    """df with the column `name` of its stratum's row of sets (null without one). spread: a column
    that differs within a stratum, or "judge" for a random one."""
    limits = sets.select(F.col("stratum").alias("_stratum"), name)
    if sets.count() <= BROADCAST_STRATA:
        return df.join(F.broadcast(limits), F.col("stratum") == F.col("_stratum"), "left").drop("_stratum")
    salt = F.pmod(F.xxhash64("s" if spread == "judge" else spread), F.lit(SALTS)).cast("int")
    copies = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_own", salt).join(copies, (F.col("stratum") == F.col("_stratum")) & (F.col("_own") == F.col("_salt")), "left").drop("_stratum", "_own", "_salt")


def labelled_statistics(stats: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """stats (key, stratum, s) with good and proposes: a document is bad if any of its label rows says 0."""
    marks = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("label_key")).agg((F.min("quality") == 1).alias("good"))
    return stats.join(marks, F.col(key) == F.col("label_key")).where(~F.col("s.base_failed")).select("stratum", "good", proposes(key).alias("proposes"), "s")


def _verdict(df: DataFrame, cutoffs: DataFrame, key: str) -> DataFrame:
    """df with kept: neither base_failed nor above a cutoff of its stratum; without cutoffs the base
    rules alone decide."""
    return with_limits(df, cutoffs, "limits", key).withColumn("kept", ~F.col("s.base_failed") & ~rejected(F.col("limits"))).drop("limits")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """Per document: key, the base counts, base_failed and kept.

    Null text: empty, so it fails. Null stratum: that of the empty name. Strata without labels, or
    with too few for the level, apply the base rules alone. Repeated rows are judged alike; a null key
    has no label. An empty table gives no rows.
    """
    stats = cut(docs.select(F.col(key).alias(key), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), statistics(F.col(text)).alias("s")))
    cutoffs = cut(calibrate(labelled_statistics(stats, labels, key)))
    return _verdict(stats, cutoffs, key).select(key, *[f"s.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """The rows of docs that pass, with their columns as they are; see judge() for nulls and repeats.

    The statistics are computed once, in the pass that writes the rows with them to the shared folder;
    calibration and verdict read them there. It is a checkpoint, so Spark removes it with the result
    where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    stats = cut(row.select("row", F.col("row")[key].alias(key), F.coalesce(F.col("row")[stratum], F.lit("")).alias("stratum"), statistics(F.col("row")[text]).alias("s")))
    cutoffs = cut(calibrate(labelled_statistics(stats.drop("row"), labels, key)))
    return _verdict(stats, cutoffs, key).where("kept").select("row.*")


def oracle_sql() -> str:
    """judge() over `documents` and `labels` as DuckDB SQL."""
    grid = ", ".join(f"('{rule}', {c})" for rule, cutoffs in CUTOFFS.items() for c in cutoffs)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN s_{r}" for r in CUTOFFS) + " END"
    cutoffs = ", ".join(f"min(cutoff) FILTER (rule = '{r}') AS c_{r}" for r in CUTOFFS)
    over = " OR ".join(f"coalesce(s_{r} > c_{r}, false)" for r in CUTOFFS)
    crc_table = "(SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295)"
    return rf"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines FROM numbered),
grams AS (SELECT r, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i+7], ' '))) AS g FROM split WHERE len(words) > 8),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) t(k) GROUP BY r),
counted AS (SELECT r, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper FROM split LEFT JOIN covered USING (r)),
rated AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols * 1000 // greatest(word_chars, 1) AS s_symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS s_dup_lines,
  n_repeat_words * 1000 // greatest(n_words, 1) AS s_repeats, n_upper * 1000 // greatest(word_chars, 1) AS s_uppercase, word_chars * 10 // greatest(n_words, 1) AS s_word_length FROM counted),
marks AS (SELECT doc_id, min(quality) = 1 AS good, {crc} % 3 = 0 AS proposes FROM labels, {crc_table} WHERE quality IS NOT NULL GROUP BY doc_id, t),
labelled AS (SELECT * FROM rated JOIN marks USING (doc_id) WHERE NOT base_failed),
cells AS (SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND {value} > cutoff) AS good_rejected, count(*) FILTER (NOT good AND {value} > cutoff) AS bad_rejected
  FROM labelled, (VALUES {grid}) c(rule, cutoff) WHERE proposes GROUP BY ALL),
sets AS (SELECT stratum, budget, {cutoffs} FROM cells, (VALUES {", ".join(f"({b})" for b in BUDGETS)}) b(budget) WHERE bad_rejected > good_rejected AND good_rejected * 1000 <= budget * n GROUP BY ALL),
judges AS (SELECT * FROM labelled WHERE good AND NOT proposes),
sizes AS (SELECT stratum, count(*) AS n, {LEVEL} / count(*) OVER () AS bound FROM judges GROUP BY stratum),
tests AS (SELECT stratum, budget, count(*) FILTER ({over}) AS gone FROM judges JOIN sets USING (stratum) GROUP BY ALL),
tails AS (SELECT stratum, budget, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) FROM range(0, gone + 1) t(i)) <= bound AS passed FROM tests JOIN sizes USING (stratum)),
chosen AS (SELECT stratum, max(budget) AS budget FROM tails t WHERE NOT EXISTS (SELECT 1 FROM tails f WHERE f.stratum = t.stratum AND f.budget <= t.budget AND NOT f.passed) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM rated LEFT JOIN (SELECT * FROM sets JOIN chosen USING (stratum, budget)) USING (stratum)"""
