"""Annotation of genes: closure of gene-set hierarchies, keyword scores, patterns, overrides, multi-maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.sources.readers import work_folder


def closure(sets: DataFrame, genes: DataFrame) -> DataFrame:
    """(set_id, gene) of all genes below a set. ``sets`` holds (set_id, component), ``genes`` (set_id, gene).

    Breadth first: each step follows the components of what the last one reached and keeps what is new, so a part that many
    sets share, or a cycle, is met once per set. Steps are written to the shared folder; there are as many as the hierarchy is deep.
    """
    spark, folder = sets.sparkSession, work_folder(sets.sparkSession, "closure")
    edges = sets.select(F.col("set_id").alias("node"), "component").where("node IS NOT NULL AND component IS NOT NULL").distinct()
    roots = sets.select("set_id").union(genes.select("set_id")).where("set_id IS NOT NULL").distinct()
    kind, paths = sets.schema["set_id"].dataType.simpleString(), [f"{folder}/step-0"]
    roots.select("set_id", F.col("set_id").alias("node")).write.parquet(paths[0])
    load = lambda p: spark.read.schema(f"set_id {kind}, node {kind}").parquet(*p)
    while not load(paths[-1:]).isEmpty():
        new = load(paths[-1:]).join(edges, "node").select("set_id", F.col("component").alias("node")).distinct().join(load(paths), ["set_id", "node"], "left_anti")
        paths.append(f"{folder}/step-{len(paths)}")
        new.write.parquet(paths[-1])
    return load(paths).join(genes.withColumnRenamed("set_id", "node"), "node").select("set_id", "gene").distinct()


def first_by_order(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """The value with the smallest ordinal of each key."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(ordinal, value)).alias(value))


def last_by_order(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(ordinal, value)).alias(value))


def keyword_category(texts: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """Category with the most keywords contained in the text, at least one; ties go to the earlier category.

    ``keywords`` (category, ordinal, keyword) is a configuration table: it is gathered into one array and
    scored by higher-order functions, so each text is read once and no pairs are shuffled.
    """
    table = keywords.groupBy("category", "ordinal").agg(F.collect_list(F.lower("keyword")).alias("words")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "category", "words"))).alias("_table"))
    scored = texts.crossJoin(F.broadcast(table)).withColumn("_s", F.transform("_table", lambda c: F.struct(F.size(F.filter(c["words"], lambda w: F.lower(F.col(text)).contains(w))).alias("score"), (-c["ordinal"]).alias("o"), c["category"].alias("category"))))
    best = F.array_max("_s")
    return scored.select(key, F.when(best["score"] > 0, best["category"]).alias("category"), F.greatest(best["score"], F.lit(0)).alias("score"))


def pattern_category(names: DataFrame, key: str, patterns: DataFrame) -> DataFrame:
    """Category of the first pattern (by ordinal) that the name matches; names without a match are left out.

    ``patterns`` (category, ordinal, pattern) is a configuration table: it is gathered into one row, so each name is read once; repeated names give one row.
    """
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("ordinal", "category", "pattern"))).alias("_table"))
    hits = F.filter("_table", lambda p: F.rlike(F.col(key), p["pattern"]))
    found = names.select(key).distinct().crossJoin(F.broadcast(table)).select(key, F.get(hits, F.lit(0))["category"].alias("category"))
    return found.where("category IS NOT NULL")


def cascade(genes: DataFrame, key: str, steps: list[DataFrame], boosted: bool = True, default: str | None = "Other") -> DataFrame:
    """First category of the steps in their order (all but the first only if boosted), or the default. Each step is (key, category) with one row per key."""
    out = genes
    used = steps if boosted else steps[:1]
    for i, step in enumerate(used):
        out = out.join(step.select(key, F.col("category").alias(f"_c{i}")), key, "left")
    picked = F.coalesce(*[F.col(f"_c{i}") for i in range(len(used))], F.lit(default))
    return out.select(*genes.columns, picked.alias("category"))


def multi_map(genes: DataFrame, categories: Column, allowed: list[str] | None = None) -> DataFrame:
    """One row per gene and category, optionally the allowed ones only; genes without any are dropped."""
    kept = F.array_distinct(categories if allowed is None else F.filter(categories, lambda c: c.isin(*allowed)))
    return genes.select("*", F.explode(kept).alias("category"))


def coverage(categories: DataFrame, column: str = "category") -> DataFrame:
    """Rows per category and their share of all; one row per category is windowed."""
    n = categories.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def distinct_sets(members: DataFrame, set_id: str, member: str, ordinal: str) -> DataFrame:
    """Sets with equal members become one, named by the earliest member; (label, members, n_sets)."""
    each = members.groupBy(set_id).agg(F.sort_array(F.collect_set(member)).alias("members"), F.min_by(member, ordinal).alias("label"), F.min(ordinal).alias("o"))
    return each.groupBy("members").agg(F.min_by("label", F.struct("o", "label")).alias("label"), F.count("*").alias("n_sets"))


def overlapping_members(members: DataFrame, set_id: str, member: str) -> DataFrame:
    """Members of more than one set, with their sets."""
    return members.groupBy(member).agg(F.sort_array(F.collect_set(set_id)).alias("sets")).where(F.size("sets") > 1)


def eligible_clusters(members: DataFrame, active: DataFrame, set_id: str, member: str, least: int = 2, skip: tuple[str, ...] = ("NTCs",)) -> DataFrame:
    """Sets with at least ``least`` active members, without the skipped names."""
    kept = members.where(~F.col(set_id).cast("string").isin(*skip)).select(set_id, member).distinct().join(active.select(member).distinct(), member, "left_semi")
    return kept.groupBy(set_id).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Value of the key or the default; the table has one row per key."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))


def override(rows: DataFrame, overrides: DataFrame, key: str, columns: list[str], defaults: dict[str, str]) -> DataFrame:
    """Configured columns: override, then default."""
    renamed = overrides.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    return rows.join(renamed, key, "left").select(*rows.columns, *[F.coalesce(F.col(f"_o_{c}"), F.lit(defaults.get(c))).alias(c) for c in columns])
