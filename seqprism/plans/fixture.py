"""Labelled sequence sites from the text tables.

The letters A, C, G, T of a text, in order and upper-case, are cut into sites of 150 letters (the
method's window) until the text ends; a site's labels are the language and the known quality.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from seqprism.config import AnalysisConfig
from seqprism.functions import arrays
from seqprism.session import prepare

CONFIG = AnalysisConfig()
#: Ids of sites are document * SITES + tile: a text of 2 GB, the most there can be, has fewer tiles.
SITES = 100_000_000
#: Letters of a tile that is a repeat where it stands twice.
REPEAT = 50


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _tiles(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, tiles) of the documents that have a letter. Whole batches of texts are cut by their bytes,
    so that only the letters, about a sixth of prose, go on to joins."""
    rows = docs.select("doc_id", "lang", "text")

    def run(batches):
        for batch in batches:
            text, offsets = arrays.flat(batch.column(2))
            for first, end in arrays.pieces(offsets):
                parts = arrays.tiles(text[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], CONFIG.window)
                own = pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in range(2)), parts], names=["doc_id", "lang", "tiles"])
                yield own.filter(pc.greater(pc.list_value_length(parts), 0))

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], rows.schema["lang"], StructField("tiles", ArrayType(StringType()))]))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, lang, annotation, seq)."""
    quality = F.when(F.col("quality") == 1, "hi").when(F.col("quality") == 0, "lo").otherwise("un")
    docs = _tiles(read(spark, sf_dir, "documents")).join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.select("doc_id", "lang", F.concat("lang", F.lit(";"), quality).alias("annotation"), F.posexplode("tiles").alias("tile", "seq"))
    return rows.select((F.col("doc_id") * SITES + F.col("tile")).alias("site_id"), "lang", "annotation", "seq")


def dealt_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sites() dealt evenly by site_id, for work that is far dearer than moving 150 letters: a long text
    would otherwise keep all its sites in one task. Groupings on site_id and more need no other shuffle."""
    return sites(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "site_id")


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, chrom, start, end): each event as an interval of minutes, as long as its value, per user."""
    minutes = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("chrom"), minutes.alias("start"), (minutes + F.floor(F.coalesce("value", F.lit(0.0)))).alias("end"))


def text_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, annotation, seq): each document as a chromosome of its letters A, C, G, T, other letters than
    ASCII being N; annotation is null where the quality is unknown."""
    letters = F.regexp_replace(F.regexp_replace("text", r"[^ACGTacgt\x{80}-\x{10FFFF}]+", ""), "[^ACGTacgt]", "N")
    quality = F.when(F.col("quality") == 1, "hi").when(F.col("quality") == 0, "lo")
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(F.col("doc_id").alias("chrom"), F.concat("lang", F.lit(";"), quality).alias("annotation"), F.upper(letters).alias("seq")).where("seq <> ''")


def placed_sites(genome: DataFrame) -> DataFrame:
    """(site_id, chrom, start, end, annotation, seq): all windows of the chromosomes that have an annotation."""
    tiles = F.transform(F.regexp_extract_all("seq", F.lit(f".{{1,{CONFIG.window}}}"), F.lit(0)), lambda x, i: F.struct(i.cast("long").alias("tile"), x.alias("part")))
    rows = genome.where("annotation IS NOT NULL").select("chrom", "annotation", F.inline(tiles))
    start = F.col("tile") * CONFIG.window
    return rows.select((F.col("chrom") * SITES + F.col("tile")).alias("site_id"), "chrom", start.alias("start"), (start + F.length("part") - 1).alias("end"), "annotation", F.col("part").alias("seq"))


def repeat_places(genome: DataFrame) -> DataFrame:
    """(chrom, start, end): whole tiles of REPEAT letters that stand as a tile at two places or more."""
    tiles = F.transform(F.regexp_extract_all("seq", F.lit(f".{{{REPEAT}}}"), F.lit(0)), lambda x, i: F.struct((i.cast("long") * REPEAT).alias("start"), x.alias("tile")))
    placed = genome.select("chrom", F.inline(tiles))
    often = placed.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1").select("tile")
    return placed.join(often, "tile", "left_semi").select("chrom", "start", (F.col("start") + REPEAT - 1).alias("end"))


def _folded(drops: str) -> str:
    """Suppression in the order of hill_windows: a kept window that overlaps the new one and is `drops`
    it goes, up to the first that is higher, which rejects the new one."""
    meets = "k.start < new[1].start + new[1].len AND new[1].start < k.start + k.len"
    higher = f"coalesce(list_position(list_transform(kept, lambda k: {meets} AND k.score > new[1].score), true), 0)"
    step = f"list_transform([{higher}], lambda p: list_concat(list_filter(kept, lambda k, i: (p > 0 AND i >= p) OR NOT ({meets} AND k.score {drops} new[1].score)), CASE WHEN p > 0 THEN [] ELSE new END))[1]"
    return f"SELECT site_id, model, h.start AS start, h.len AS len, h.score AS score, h.hill AS hill FROM (SELECT site_id, model, unnest(list_reduce(list_transform(found, lambda w: [w]), lambda kept, new: {step})) AS h FROM hill_windows)"


#: DuckDB views of the same tables, each over those before it. Of random places (drawn) there are more
#: than the operator tries; that does not change the first ones that stay.
VIEWS = {
    "letters": "SELECT doc_id, lang, lang || ';' || CASE quality WHEN 1 THEN 'hi' WHEN 0 THEN 'lo' ELSE 'un' END AS annotation, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS s FROM documents LEFT JOIN labels USING (doc_id)",
    "sites": f"SELECT doc_id * {SITES} + t AS site_id, lang, annotation, substring(s, t * 150 + 1, 150) AS seq FROM (SELECT *, unnest(range(0, (length(s) + 149) // 150)) AS t FROM letters WHERE s <> '')",
    "occ": "SELECT site_id, lang, annotation, k, CAST(p - 1 AS INT) AS pos, least(substring(seq, p, k), reverse(translate(substring(seq, p, k), 'ACGT', 'TGCA'))) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - k + 2)) AS p FROM sites, (VALUES (4), (5)) ks(k) WHERE length(seq) >= k)",
    "counts": "SELECT site_id, k, kmer, count(*) AS cnt FROM occ GROUP BY ALL",
    "subclasses": "SELECT annotation, count(*) AS n FROM sites GROUP BY 1",
    "pieces": "SELECT annotation, unnest(list_distinct(string_split(annotation, ';'))) AS label FROM subclasses",
    "fan_out": "SELECT label, count(*) AS n_subgroups FROM pieces GROUP BY 1 HAVING count(*) > 1",
    "all_kmers": "SELECT array_to_string(list_transform(range(k), lambda i: substring('ACGT', CAST((c // CAST(pow(4, k - 1 - i) AS BIGINT)) % 4 + 1 AS BIGINT), 1)), '') AS kmer FROM (VALUES (4), (5)) ks(k), range(1024) r(c) WHERE c < pow(4, k)",
    "class_kmers": "SELECT lang, kmer, count(*) AS cnt FROM occ GROUP BY ALL",
    "grid": "SELECT t.lang AS model, o.kmer, coalesce(c.cnt, 0) AS cnt, t.n_class, o.n_kmer, (SELECT sum(cnt) FROM class_kmers) AS n_all FROM (SELECT lang, sum(cnt) AS n_class FROM class_kmers GROUP BY 1) t CROSS JOIN (SELECT kmer, sum(cnt) AS n_kmer FROM class_kmers GROUP BY 1) o LEFT JOIN class_kmers c ON c.lang = t.lang AND c.kmer = o.kmer",
    "weights": "SELECT model, kmer, round(ln((cnt + 1) / (n_class + 648.0)) - ln((n_kmer - cnt + 1) / (n_all - n_class + 648.0)), 6) AS weight FROM grid",
    "site_logits": "SELECT site_id, model, sum(weight) AS logit FROM occ JOIN weights USING (kmer) GROUP BY ALL",
    "site_posteriors": "SELECT site_id, model, logit, exp(logit - max(logit) OVER w) / sum(exp(logit - m)) OVER w AS prob FROM (SELECT *, max(logit) OVER (PARTITION BY site_id) AS m FROM site_logits) WINDOW w AS (PARTITION BY site_id)",
    "predictions": "SELECT site_id, arg_min(model, (-prob, model)) AS predicted FROM site_posteriors GROUP BY 1",
    "site_weights": "SELECT site_id, (SELECT max(n) FROM subclasses) / n AS weight FROM sites JOIN subclasses USING (annotation)",
    "feature_stats": "SELECT kmer, s / w AS mean, sqrt(abs(q - w * (s / w) * (s / w)) / (w - 1)) AS sd FROM (SELECT kmer, sum(weight * cnt) AS s, sum(weight * cnt * cnt) AS q, (SELECT sum(weight) FROM site_weights) AS w FROM counts JOIN site_weights USING (site_id) GROUP BY 1)",
    "member_kmers": "SELECT o.site_id, o.lang AS model, k, pos, weight FROM occ o JOIN weights w ON w.model = o.lang AND w.kmer = o.kmer",
    "run4": "SELECT site_id, list_prepend(0.0, list(total ORDER BY pos)) AS r4 FROM (SELECT site_id, pos, sum(weight) OVER (PARTITION BY site_id ORDER BY pos) AS total FROM member_kmers WHERE k = 4) GROUP BY 1",
    "run5": "SELECT site_id, list_prepend(0.0, list(total ORDER BY pos)) AS r5 FROM (SELECT site_id, pos, sum(weight) OVER (PARTITION BY site_id ORDER BY pos) AS total FROM member_kmers WHERE k = 5) GROUP BY 1",
    "spans": "SELECT site_id, lang AS model, seq, CAST(l AS INT) AS len, CAST(unnest(range(0, length(seq) - l + 1)) AS INT) AS start FROM sites, range(6, 15) r(l) WHERE length(seq) >= l",
    "windows": "SELECT site_id, model, len, start, round((r4[start + len - 2] - r4[start + 1]) + (r5[start + len - 3] - r5[start + 1]), 6) AS score, substring(seq, start + 1, len) AS hill FROM spans JOIN run4 USING (site_id) JOIN run5 USING (site_id)",
    "hill_windows": f"SELECT site_id, model, list({{'start': start, 'len': len, 'score': score, 'hill': hill}} ORDER BY len, start) AS found FROM windows WHERE score > {CONFIG.hill_threshold} GROUP BY ALL",
    "hills": _folded("<="),
    "seqlets": _folded("<"),
    "hill_kmers": "SELECT site_id, model, start, len, kmer, weight FROM (SELECT site_id, model, start, len, least(substring(hill, p, k), reverse(translate(substring(hill, p, k), 'ACGT', 'TGCA'))) AS kmer FROM (SELECT *, unnest(range(1, len - k + 2)) AS p FROM hills, (VALUES (4), (5)) ks(k))) JOIN weights USING (model, kmer)",
    "aligned": "SELECT model AS motif, hill FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, start) AS r FROM windows WHERE len = 8) WHERE r = 1",
    "motifs": "SELECT motif, CAST(p AS INT) AS pos, avg(CAST(b = 'A' AS INT)) AS a, avg(CAST(b = 'C' AS INT)) AS c, avg(CAST(b = 'G' AS INT)) AS g, avg(CAST(b = 'T' AS INT)) AS t FROM (SELECT motif, p, substring(hill, p + 1, 1) AS b FROM aligned, range(0, 8) r(p)) GROUP BY ALL",
    "consensus": "SELECT motif, string_agg(CASE WHEN a >= c AND a >= g AND a >= t THEN 'A' WHEN c >= g AND c >= t THEN 'C' WHEN g >= t THEN 'G' ELSE 'T' END, '' ORDER BY pos) AS consensus FROM motifs GROUP BY 1",
    "motif_kmers": "SELECT motif, least(substring(consensus, p, k), reverse(translate(substring(consensus, p, k), 'ACGT', 'TGCA'))) AS kmer FROM (SELECT *, unnest(range(1, length(consensus) - k + 2)) AS p FROM consensus, (VALUES (4), (5)) ks(k))",
    "motif_only": "SELECT site_id, model, start, len, sum(CASE WHEN kmer IN (SELECT kmer FROM motif_kmers) THEN weight ELSE 0 END) AS score FROM hill_kmers GROUP BY ALL",
    "dimers": "SELECT * FROM (VALUES ('AA', 'TT'), ('AC', 'GT'), ('AG', 'CT'), ('AT', 'AT'), ('CA', 'TG'), ('CC', 'GG'), ('CG', 'CG'), ('GA', 'TC'), ('GC', 'GC'), ('TA', 'TA')) d(dimer, other)",
    "dimer_cells": "SELECT model, dimer, sum(CASE WHEN contains(kmer, dimer) OR contains(kmer, other) THEN weight ELSE 0 END) AS total FROM weights, dimers GROUP BY ALL",
    "cg_pos": "SELECT site_id, p - 1 AS pos FROM (SELECT *, unnest(range(1, length(seq))) AS p FROM sites WHERE length(seq) > 1) WHERE substring(seq, p, 2) = 'CG'",
    "cg_bins": "SELECT site_id, CAST(pos // 10 AS INT) AS bin, count(*) AS n_cg, count(*) / 5.0 AS frac_cg FROM cg_pos GROUP BY ALL",
    "centers": "SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL",
    "center_list": "SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS cluster, list(x ORDER BY i) AS center FROM centers GROUP BY label",
    "assigned": "SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT vec_id, cluster, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i] - center[i]) * (embedding[i] - center[i])))), 6) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings), center_list) GROUP BY 1",
    "intervals": "SELECT event_id AS id, user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) // 60 AS start, CAST(floor(epoch(ts)) AS BIGINT) // 60 + CAST(floor(coalesce(value, 0)) AS BIGINT) AS stop FROM events",
    "genome": "SELECT *, CAST(sum(length) OVER (ORDER BY chrom) AS BIGINT) - length AS first FROM (SELECT chrom, max(stop) - min(start) + 1 AS length, min(start) AS origin FROM intervals GROUP BY 1)",
    "drawn": "SELECT i AS id, chrom, place - first AS start, place - first + 149 AS stop FROM (SELECT i, CAST('0x' || substring(md5('42:' || i), 1, 15) AS BIGINT) % (SELECT CAST(sum(length) AS BIGINT) FROM genome) AS place FROM range(8000) r(i)) JOIN genome ON place >= first AND place < first + length WHERE place - first + 150 <= length",
    "untaken": "SELECT * FROM drawn d WHERE NOT EXISTS (SELECT 1 FROM intervals t JOIN genome g ON t.chrom = g.chrom WHERE t.chrom = d.chrom AND t.start - g.origin <= d.stop AND d.start <= t.stop - g.origin)",
    "bare_sites": "SELECT site_id, replace(annotation, ';un', '') AS annotation FROM sites",
    "bare_shared": "SELECT label FROM (SELECT annotation, unnest(string_split(annotation, ';')) AS label FROM (SELECT DISTINCT annotation FROM bare_sites)) GROUP BY 1 HAVING count(*) > 1",
    "bare_named": "SELECT site_id, CASE WHEN annotation IN (SELECT label FROM bare_shared) THEN annotation || 'Only;' || annotation ELSE annotation END AS annotation FROM bare_sites",
    "text_genome": r"SELECT * FROM (SELECT doc_id AS chrom, lang || ';' || CASE quality WHEN 1 THEN 'hi' WHEN 0 THEN 'lo' END AS annotation, upper(regexp_replace(regexp_replace(text, '[^ACGTacgt\x{80}-\x{10FFFF}]+', '', 'g'), '[^ACGTacgt]', 'N', 'g')) AS s FROM documents LEFT JOIN labels USING (doc_id)) WHERE s <> ''",
    "text_tiles": f"SELECT chrom, t * {REPEAT} AS start, substring(s, t * {REPEAT} + 1, {REPEAT}) AS tile FROM (SELECT *, unnest(range(0, length(s) // {REPEAT})) AS t FROM text_genome)",
    "text_repeats": f"SELECT chrom, start, start + {REPEAT - 1} AS stop FROM text_tiles WHERE tile IN (SELECT tile FROM text_tiles GROUP BY 1 HAVING count(*) > 1)",
    "text_sites": f"SELECT chrom * {SITES} + t AS site_id, chrom, t * 150 AS start, least(t * 150 + 149, length(s) - 1) AS stop, annotation, substring(s, t * 150 + 1, 150) AS seq FROM (SELECT *, unnest(range(0, (length(s) + 149) // 150)) AS t FROM text_genome WHERE annotation IS NOT NULL)",
    "text_cover": "SELECT site_id, sum(least(t.stop, r.stop) - greatest(t.start, r.start) + 1) AS covered FROM text_sites t JOIN text_repeats r ON t.chrom = r.chrom AND r.start <= t.stop AND t.start <= r.stop GROUP BY 1",
    "text_screened": f"SELECT t.* FROM text_sites t LEFT JOIN text_cover USING (site_id) WHERE coalesce(covered, 0) / (stop - start + 1) <= {CONFIG.max_repeat_share}",
    "text_kept": f"SELECT *, count(*) OVER (PARTITION BY annotation) AS size FROM text_screened QUALIFY size >= {CONFIG.min_subclass}",
    "text_lengths": "SELECT chrom, s, length(s) AS length, CAST(sum(length(s)) OVER (ORDER BY chrom) AS BIGINT) - length(s) AS first FROM text_genome",
    "text_drawn": "SELECT i AS id, chrom, place - first AS start, place - first + 149 AS stop, substring(s, CAST(place - first + 1 AS BIGINT), 150) AS seq FROM (SELECT i, CAST('0x' || substring(md5('42:' || i), 1, 15) AS BIGINT) % (SELECT CAST(sum(length) AS BIGINT) FROM text_lengths) AS place FROM range(400000) r(i)) JOIN text_lengths ON place >= first AND place < first + length WHERE place - first + 150 <= length",
    "text_free": "SELECT * FROM text_drawn d WHERE NOT contains(seq, 'N') AND NOT EXISTS (SELECT 1 FROM text_kept k WHERE k.chrom = d.chrom AND k.start <= d.stop AND d.start <= k.stop)",
    "text_low": f"SELECT f.* FROM text_free f LEFT JOIN (SELECT id, sum(least(f.stop, r.stop) - greatest(f.start, r.start) + 1) AS covered FROM text_free f JOIN text_repeats r ON f.chrom = r.chrom AND r.start <= f.stop AND f.start <= r.stop GROUP BY 1) USING (id) WHERE coalesce(covered, 0) / 150 <= {CONFIG.max_repeat_share}",
    "overlap_pairs": "SELECT a.id, b.id AS r_id, least(a.stop, b.stop) - greatest(a.start, b.start) + 1 AS overlap FROM intervals a JOIN intervals b ON a.chrom = b.chrom AND a.id < b.id AND a.start <= b.stop AND b.start <= a.stop",
}


def with_views(body: str) -> str:
    """body after a WITH clause of the views it needs."""
    import re

    needed: set[str] = set()

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                add(VIEWS[name])

    add(body)
    # What several views read is made once.
    clause = ", ".join(f"{name} AS {'MATERIALIZED ' if name in ('sites', 'counts', 'feature_stats', 'weights', 'hills', 'seqlets', 'hill_kmers', 'motif_kmers', 'text_genome', 'text_repeats', 'text_kept', 'text_free', 'text_low') else ''}({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH {clause} {body}" if clause else body
