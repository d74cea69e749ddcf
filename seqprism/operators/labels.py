"""Label combinations, their hierarchy, class weights, and rules for small classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subgroup(annotation: Column) -> Column:
    """The class of an annotation: its labels joined by `#`."""
    return F.translate(annotation, ";", "#")


#: The class of random regions.
BACKGROUND = "Random"


def without_background(rows: DataFrame, model: str = "model") -> DataFrame:
    """Rows of all models but that of random regions; those without a model stay."""
    return rows.where(~F.col(model).eqNullSafe(F.lit(BACKGROUND)))


def smallest(sites: DataFrame) -> int:
    """Sites of the smallest class, 0 without sites: as many as there are random regions."""
    return counts(sites).agg(F.min("n")).first()[0] or 0


def counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("annotation").agg(F.count("*").alias("n"))


def weights(sites: DataFrame) -> DataFrame:
    """Weight of each class: the largest class's count over its own."""
    n = counts(sites)
    return n.withColumn("weight", F.max("n").over(Window.partitionBy()) / F.col("n"))


def keep_frequent(sites: DataFrame, least: int) -> DataFrame:
    """Sites of classes with `least` sites or more; a class exactly at the limit stays."""
    return sites.join(counts(sites).where(F.col("n") >= least).select("annotation"), "annotation", "left_semi")


def fan_out(sites: DataFrame) -> DataFrame:
    """(label, n_subgroups) of the labels that two classes or more have."""
    pieces = sites.select("annotation").distinct().select(F.explode(F.array_distinct(F.split("annotation", ";"))).alias("label"), "annotation")
    return pieces.groupBy("label").agg(F.count("*").alias("n_subgroups")).where("n_subgroups > 1")


def class_names(sites: DataFrame) -> DataFrame:
    """(annotation, name, parents, first): each class with the name of its node, its shared labels (sorted)
    and its first site. A class named like a shared label X becomes `XOnly#X`, or, where another class has
    that name, the first of `XOnlyOnly#X` and so on that none has, so that no two classes share a name."""
    shared = fan_out(sites).select("label")
    classes = sites.groupBy("annotation").agg(F.min("site_id").alias("first"))
    pieces = classes.select("annotation", F.explode(F.array_distinct(F.split("annotation", ";"))).alias("label"))
    known = pieces.join(shared, "label").groupBy("annotation").agg(F.sort_array(F.collect_set("label")).alias("parents"))
    named = classes.withColumn("_name", subgroup(F.col("annotation"))).join(known, "annotation", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    # Names of the form XOnly...#X that classes have already, by X.
    forms = named.select(F.regexp_extract("_name", r"^(.*?)((?:Only)+)#\1$", 1).alias("_of"), (F.length(F.regexp_extract("_name", r"^(.*?)((?:Only)+)#\1$", 2)) / 4).cast("int").alias("_times"))
    used = forms.where("_times > 0").groupBy("_of").agg(F.collect_set("_times").alias("_used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("_used") + 1), "_used"))
    times = F.when(F.col("_used").isNull(), 1).otherwise(free)
    name = F.when(F.array_contains("parents", F.col("_name")), F.concat("_name", F.repeat(F.lit("Only"), times), F.lit("#"), "_name")).otherwise(F.col("_name"))
    return named.join(used, F.col("_name") == F.col("_of"), "left").select("annotation", name.alias("name"), "parents", "first")


def renamed(sites: DataFrame) -> DataFrame:
    """sites with the annotation of their node's name, so that counts, weights, membership and training see
    the classes that hierarchy() has. Sites without an annotation stay as they are."""
    names = class_names(sites).select("annotation", F.translate("name", "#", ";").alias("_named"))
    return sites.join(names, "annotation", "left").withColumn("annotation", F.col("_named")).select(*sites.columns)


def hierarchy(sites: DataFrame) -> DataFrame:
    """Nodes: classes (leaves) in the order of their first site, then labels by name.

    A class named like a label becomes `XOnly#X`. Columns: node_idx, name, is_leaf, layer, parents and
    children (sorted names). Without shared labels all leaves are roots and there is one layer.
    """
    leaves = class_names(sites)
    children = leaves.select("name", F.explode("parents").alias("label")).groupBy("label").agg(F.sort_array(F.collect_set("name")).alias("children"))
    none = F.array().cast("array<string>")
    nodes = leaves.select("name", F.lit(True).alias("is_leaf"), F.lit(0).alias("layer"), "parents", none.alias("children"), "first").unionByName(
        children.select(F.col("label").alias("name"), F.lit(False).alias("is_leaf"), F.lit(1).alias("layer"), none.alias("parents"), "children", F.lit(None).cast("long").alias("first"))
    )
    # As many rows as there are classes and labels.
    place = F.row_number().over(Window.orderBy("layer", F.col("first").asc_nulls_last(), "name")) - 1
    return nodes.select(place.alias("node_idx"), "name", "is_leaf", "layer", "parents", "children")


def node_support(sites: DataFrame) -> DataFrame:
    """(name, n): sites under each node; a label has those of all its classes."""
    leaf = class_names(sites).join(counts(sites), "annotation").select("name", "parents", "n")
    return leaf.select("name", "n").unionByName(leaf.select(F.explode("parents").alias("name"), "n").groupBy("name").agg(F.sum("n").alias("n")))


def membership(sites: DataFrame, models: DataFrame) -> DataFrame:
    """(model, site_id): a site belongs to a model if it has every label of the model's name."""
    pieces = models.select("model", F.explode(F.array_distinct(F.split("model", "#"))).alias("label"))
    needed = pieces.groupBy("model").agg(F.count("*").alias("needed"))
    per_class = sites.select("annotation").distinct().select("annotation", F.explode(F.array_distinct(F.split("annotation", ";"))).alias("label"))
    met = per_class.join(pieces, "label").groupBy("model", "annotation").agg(F.count("*").alias("met"))
    # Decided once per class, whatever its number of sites.
    fitting = met.join(needed, "model").where("met = needed").select("model", "annotation")
    return sites.select("site_id", "annotation").join(fitting, "annotation").select("model", "site_id")


def merge_candidates(sites: DataFrame, least: int) -> DataFrame:
    """(annotation, targets): classes below the limit and the classes above it that share a label,
    by name; a target that shares two labels is listed twice. A class at the limit is neither."""
    n = counts(sites)
    low = n.where(F.col("n") < least).select("annotation", F.explode(F.split("annotation", ";")).alias("label"))
    high = n.where(F.col("n") > least).select(F.col("annotation").alias("target"), F.explode(F.split("annotation", ";")).alias("label"))
    return low.join(high, "label").groupBy("annotation").agg(F.sort_array(F.collect_list("target")).alias("targets"))


def merge_low(sites: DataFrame, least: int, seed: int) -> DataFrame:
    """sites with `merged`: the class a site of a small class moves to, drawn by a hash of its id; its
    own where there is no candidate."""
    targets = merge_candidates(sites, least)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("site_id").cast("string"))), 1, 8), 16, 10).cast("long")
    chosen = F.element_at("targets", (draw % F.size("targets") + 1).cast("int"))
    return sites.join(targets, "annotation", "left").withColumn("merged", F.when(F.col("targets").isNull(), F.col("annotation")).otherwise(chosen)).drop("targets")


def stratified_folds(sites: DataFrame, folds: int) -> DataFrame:
    """(site_id, annotation, fold): places by hash within each class, dealt in turn."""
    from .ranking import ranked

    keyed = sites.select("site_id", "annotation", F.md5(F.col("site_id").cast("string")).alias("key"))
    return ranked(keyed, "annotation", [F.col("key").asc(), F.col("site_id").asc()]).select("site_id", "annotation", ((F.col("rank") - 1) % folds).cast("int").alias("fold"))
