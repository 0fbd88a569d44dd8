"""Checks of a profile table, each as rows (level, severity, check_name, subject, n, pct); a level fails if it has an issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from heddle.functions.names import control_reason
from heddle.operators.profiles import feature_quality

ISSUE = "level string, severity string, check_name string, subject string, n bigint, pct double"


def _rows(df: DataFrame, level: str, severity: Column | str, name: str, subject: Column, n: Column, pct: Column | None = None) -> DataFrame:
    lit = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(level).alias("level"), lit.alias("severity"), F.lit(name).alias("check_name"), subject.cast("string").alias("subject"), n.cast("bigint").alias("n"), (F.lit(None) if pct is None else pct).cast("double").alias("pct"))


def schema_issues(df: DataFrame, level: str, expected: dict[str, str]) -> DataFrame:
    """Missing columns and wrong kinds (``number`` or ``string``); needs the schema only, no job."""
    kinds = {"number": NumericType, "string": StringType}
    out = []
    for name, kind in expected.items():
        if name not in df.columns:
            out.append((level, "issue", "missing_column", name, 1, None))
        elif not isinstance(df.schema[name].dataType, kinds[kind]):
            out.append((level, "issue", "wrong_type", name, 1, None))
    return df.sparkSession.createDataFrame(out, ISSUE)


def null_issues(df: DataFrame, level: str, critical: list[str]) -> DataFrame:
    """Critical columns with nulls; all of them are counted in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in critical])
    flat = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("k")) for c in critical])).alias("x"))
    return _rows(flat.where("x.k > 0"), level, "issue", "nulls", F.col("x.c"), F.col("x.k"), 100 * F.col("x.k") / F.col("_n"))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key, and keys that repeat."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"), F.count_if(F.col("n") > 1).alias("n_keys"))


def duplicate_examples(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key).limit(n)


def quality_issues(df: DataFrame, level: str, features: str) -> DataFrame:
    q = feature_quality(df, features)
    flat = q.select("n_features", F.explode(F.array(F.struct(F.lit("zero_features").alias("c"), F.col("n_zero").alias("k"), F.col("zero_issue").alias("bad")), F.struct(F.lit("constant_features").alias("c"), F.col("n_constant").alias("k"), F.col("constant_issue").alias("bad")), F.struct(F.lit("missing_features").alias("c"), F.col("n_all_missing").alias("k"), F.lit(False).alias("bad")), F.struct(F.lit("infinite_features").alias("c"), F.col("n_with_inf").alias("k"), F.lit(False).alias("bad")))).alias("x")).where("x.k > 0")
    return _rows(flat, level, F.when(F.col("x.bad"), "issue").otherwise("warning"), "quality", F.col("x.c"), F.col("x.k"), 100 * F.col("x.k") / F.col("n_features"))


def misplaced_columns(df: DataFrame, level: str, prefix: str = "network_") -> DataFrame:
    """Numeric columns with the prefix in the metadata; schema only."""
    found = [f.name for f in df.schema if f.name.startswith(prefix) and isinstance(f.dataType, NumericType)]
    return df.sparkSession.createDataFrame([(level, "issue", "misplaced_columns", ",".join(found), len(found), None)] if found else [], ISSUE)


def pair_coverage(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows with both, either or neither of two feature groups present, with the shares that the rule tests."""
    return df.agg(F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def coverage_issues(df: DataFrame, level: str, a: Column, b: Column, least: float = 0.90) -> DataFrame:
    c = pair_coverage(df, a, b)
    return _rows(c.where((F.col("both") < least * F.col("n")) | (F.col("neither") > 0)), level, "issue", "dual_coverage", F.lit("both"), F.col("both"), 100 * F.col("both") / F.col("n"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with all columns present, and the columns that are always null."""
    every = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in columns])
    empty = F.array_compact(F.array(*[F.when(F.count(c) == 0, F.lit(c)) for c in columns]))
    return df.agg(F.count("*").alias("n"), F.avg(every.cast("double")).alias("complete_share"), F.array_join(empty, ",").alias("all_null"))


def completeness_warnings(df: DataFrame, level: str, columns: list[str], least: float = 0.5) -> DataFrame:
    c = completeness(df, columns)
    return _rows(c.where(F.coalesce(F.col("complete_share"), F.lit(0.0)) < least), level, "warning", "drift_readiness", F.lit(",".join(columns)), F.col("n"), 100 * F.col("complete_share"))


def control_counts(df: DataFrame, gene_id: Column, ncbi_id: Column, name: Column) -> DataFrame:
    """Rows per rule of the control cascade; rows that no rule takes are ``none``."""
    return df.groupBy(F.coalesce(control_reason(gene_id, ncbi_id, name), F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def control_warnings(df: DataFrame, level: str, gene_id: Column, ncbi_id: Column, name: Column, low: float = 0.01, high: float = 0.20) -> DataFrame:
    c = df.agg(F.count("*").alias("n"), F.count_if(control_reason(gene_id, ncbi_id, name).isNotNull()).alias("k"))
    share = F.col("k") / F.col("n")
    return _rows(c.where((F.col("k") == 0) | (share < low) | (share > high)), level, "warning", "controls", F.when(F.col("k") == 0, "none").when(share < low, "few").otherwise("many"), F.col("k"), 100 * share)


def library_size(df: DataFrame, guide: str, gene: str, guides: int, genes: int) -> DataFrame:
    """Distinct guides and genes against the expected numbers; one gene more is allowed if it is the control."""
    n = df.agg(F.count_distinct(guide).alias("n_guides"), F.count_distinct(gene).alias("n_genes"), F.coalesce(F.max((F.upper(F.col(gene)) == "NTC").cast("int")), F.lit(0)).alias("_c"), F.count_if(F.col(guide).isNull()).alias("n_missing"))
    return n.select("n_guides", "n_genes", "n_missing", (F.col("n_guides") == guides).alias("guides_ok"), ((F.col("n_genes") == genes) | ((F.col("n_genes") == genes + 1) & (F.col("_c") == 1))).alias("genes_ok"))


def library_issues(df: DataFrame, level: str, guide: str, gene: str, guides: int, genes: int) -> DataFrame:
    n = library_size(df, guide, gene, guides, genes)
    flat = n.select(F.explode(F.array(F.struct(F.lit("guides").alias("c"), F.col("n_guides").alias("k"), F.col("guides_ok").alias("ok")), F.struct(F.lit("genes").alias("c"), F.col("n_genes").alias("k"), F.col("genes_ok").alias("ok")), F.struct(F.lit("missing_guides").alias("c"), F.col("n_missing").alias("k"), (F.col("n_missing") == 0).alias("ok")))).alias("x")).where("NOT x.ok")
    return _rows(flat, level, "issue", "library_size", F.col("x.c"), F.col("x.k"))


def category_table(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts per row value and column value with an ``_unassigned`` row, row totals and a TOTAL row, by one rollup."""
    name = F.coalesce(F.col(row), F.lit("_unassigned"))
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    out = df.withColumn("_r", name).rollup("_r").agg(*counts, F.count("*").alias("total"))
    return out.select(F.coalesce("_r", F.lit("TOTAL")).alias(row), *values, "total")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def verdicts(levels: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per level: number of issues and warnings, and whether it passes."""
    n = issues.groupBy("level").agg(F.count_if(F.col("severity") == "issue").alias("n_issues"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    out = levels.join(n, "level", "left").select("level", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"))
    return out.withColumn("passed", F.col("n_issues") == 0)
