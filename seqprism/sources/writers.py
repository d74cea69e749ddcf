"""Writers of the text formats of the method."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprism.functions.scores import heat_color


def _tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def weight_matrix(weights: DataFrame, kmers: DataFrame, path: str) -> None:
    """One row for each k-mer (absent ones zero), one column for each model; the intercept stays."""
    models = [r.model for r in weights.select("model").distinct().orderBy("model").collect()]
    wide = weights.groupBy("kmer").pivot("model", models).agg(F.first("weight"))
    extra = weights.select("kmer").where(F.col("kmer").startswith("(")).distinct()
    _tsv(kmers.select("kmer").unionByName(extra).join(wide, "kmer", "left").fillna(0.0).orderBy("kmer"), path)


def motif_scores(scores: DataFrame, models: list[str], path: str) -> None:
    """Motif by model, one column for each of the models in that order; absent scores are empty. Rows are
    sorted by motif over part files, each of which begins with the header."""
    _tsv(scores.groupBy("motif").pivot("model", models).agg(F.first("score")).orderBy("motif"), path)


def simple_scores(scores: DataFrame, models: list[str], path: str) -> None:
    """motif_scores() of only the names without `#`."""
    motif_scores(scores.where(~F.col("motif").contains("#")), [m for m in models if "#" not in m], path)


def count_matrix(counts: DataFrame, sites: DataFrame, kmers: list[str], path: str) -> None:
    """One row for each site, by site_id, with a column for each of the k-mers (absent ones zero) and the
    class last, `?` where it is null. Sites without a k-mer have zeros. Each part file has the header."""
    wide = counts.where(F.col("kmer").isin(kmers)).groupBy("site_id").pivot("kmer", kmers).agg(F.sum("cnt"))
    rows = sites.select("site_id", F.col("annotation").alias("class")).join(wide, "site_id", "left").fillna(0, kmers)
    _tsv(rows.select("site_id", *kmers, F.coalesce("class", F.lit("?")).alias("class")).orderBy("site_id"), path)


def arff(counts: DataFrame, sites: DataFrame, kmers: list[str], classes: list[str], path: str, relation: str = "sites") -> None:
    """Sparse ARFF: numeric attributes for the k-mers, then the class out of `classes`; the header is the
    beginning of the first part file, rows are sorted by site_id over the files. k-mers and classes are
    given, so nothing is looked for in the rows; a class that isn't among them, or is null, is `?`."""
    spark = sites.sparkSession
    quoted = lambda name: "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"
    head = [f"@relation {quoted(relation)}", *[f"@attribute {k} numeric" for k in kmers], f"@attribute class {{{','.join(map(quoted, classes))}}}", "@data"]
    place = spark.createDataFrame(list(zip(kmers, range(len(kmers)), strict=True)), "kmer string, i int")
    # As many rows as there are k-mers.
    found = counts.join(F.broadcast(place), "kmer").groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("i", "cnt"))).alias("cells"))
    names = F.create_map(*[F.lit(x) for c in classes for x in (c, quoted(c))]) if classes else F.create_map().cast("map<string,string>")
    cells = F.transform(F.coalesce("cells", F.array().cast("array<struct<i:int,cnt:bigint>>")), lambda c: F.concat_ws(" ", c["i"].cast("string"), c["cnt"].cast("string")))
    label = F.concat(F.lit(f"{len(kmers)} "), F.coalesce(F.when(F.col("annotation").isNotNull(), F.try_element_at(names, "annotation")), F.lit("?")))
    line = F.concat(F.lit("{"), F.array_join(F.concat(cells, F.array(label)), ", "), F.lit("}"))
    rows = sites.select("site_id", "annotation").join(found, "site_id", "left").select(F.lit(len(head)).alias("at"), "site_id", line.alias("value"))
    header = spark.createDataFrame([(i, None, value) for i, value in enumerate(head)], "at int, site_id long, value string")
    header.unionByName(rows).orderBy("at", "site_id").select("value").write.mode("overwrite").text(path)


def design(nodes: DataFrame, path: str) -> None:
    """Six columns; lists of node numbers, `-` for none."""
    numbers = nodes.select(F.col("name").alias("other"), F.col("node_idx").alias("number"))

    def listed(column: str) -> DataFrame:
        found = nodes.select("node_idx", F.explode(column).alias("other")).join(numbers, "other").groupBy("node_idx").agg(F.array_join(F.sort_array(F.collect_list("number")).cast("array<string>"), ",").alias(f"{column}_list"))
        return found

    joined = nodes.join(listed("parents"), "node_idx", "left").join(listed("children"), "node_idx", "left")
    _tsv(joined.select(F.col("node_idx").alias("Index"), F.col("name").alias("Name"), F.col("is_leaf").cast("int").alias("isSubGroup"), F.coalesce("parents_list", F.lit("-")).alias("AssignedLabs"), F.coalesce("children_list", F.lit("-")).alias("AssignedSGs"), F.col("layer").alias("Layer")).orderBy("Index"), path)


def motifs(rows: DataFrame, path: str) -> None:
    """TRANSFAC records, one line each in the order of places."""
    line = F.format_string("%d\t%.4f\t%.4f\t%.4f\t%.4f", "pos", "a", "c", "g", "t")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n")
    rows.groupBy("motif").agg(body.alias("body")).select(F.concat(F.lit("DE\t"), "motif", F.lit("\n"), "body", F.lit("\nXX")).alias("value")).write.mode("overwrite").text(path)


def sites(rows: DataFrame, path: str) -> None:
    rows.select("seq", "annotation").write.mode("overwrite").option("sep", "\t").csv(path)


def table(rows: DataFrame, path: str) -> None:
    """Cluster quality, assignments, metrics, ROC areas: any long table."""
    _tsv(rows, path)


def odds_ratios(coefficients: DataFrame) -> DataFrame:
    return coefficients.select("model", "feature", "value", F.exp("value").alias("odds_ratio"))


def heat_map(scores: DataFrame, low: float = -0.4, high: float = 0.4) -> str:
    """SVG of a motif by model table. Cells are matched by name. Reports are as small as their tables."""
    cells = scores.select("motif", "model", heat_color(F.col("score"), low, high).alias("color")).collect()
    rows, columns = sorted({c.motif for c in cells}), sorted({c.model for c in cells})
    boxes = [f'<rect x="{160 + 24 * columns.index(c.model)}" y="{20 + 24 * rows.index(c.motif)}" width="24" height="24" fill="{c.color}"/>' for c in cells]
    names = [f'<text x="4" y="{36 + 24 * i}">{html.escape(r)}</text>' for i, r in enumerate(rows)]
    heads = [f'<text x="{164 + 24 * i}" y="14" font-size="9">{html.escape(c)}</text>' for i, c in enumerate(columns)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{180 + 24 * len(columns)}" height="{40 + 24 * len(rows)}">' + "".join(boxes + names + heads) + "</svg>"


def logo(matrix: list[tuple[float, float, float, float]]) -> str:
    """SVG of one motif: letters as tall as their share of the place's information."""
    import math

    out = []
    for i, row in enumerate(matrix):
        bits = 2 + sum(p * math.log2(p) for p in row if p > 0)
        y = 100.0
        for p, base, color in sorted(zip(row, "ACGT", ("green", "blue", "orange", "red"), strict=True)):
            height = p * bits * 50
            if height > 0.5:
                out.append(f'<g transform="translate({20 * i},{y}) scale(1,{height / 14:.3f})"><text font-size="20" fill="{color}">{base}</text></g>')
                y -= height
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{20 * len(matrix)}" height="104">' + "".join(out) + "</svg>"


def report(metrics: DataFrame, motif_scores: DataFrame, options: dict) -> str:
    """HTML: options, accuracy per class, and the heat map."""
    rows = metrics.orderBy("class").collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in metrics.columns)
    shown = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else html.escape(str(v))
    body = "".join("<tr>" + "".join(f"<td>{shown(r[c])}</td>" for c in metrics.columns) + "</tr>" for r in rows)
    listed = "".join(f"<li>{html.escape(k)}: {html.escape(str(v))}</li>" for k, v in options.items())
    return f"<html><body><h1>Results</h1><ul>{listed}</ul><table><tr>{head}</tr>{body}</table>{heat_map(motif_scores)}</body></html>"
