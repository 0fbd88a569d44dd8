"""All checks of a profile table in one pass: each column is read once, by one aggregate, and the issue rows are unfolded from one row of counts.

Features are summed up as vectors beside the other columns (exact numbers of distinct values and vector summaries do not go into one aggregate); that scan reads nothing but them.

Rows are (level, severity, check_name, subject, n, pct). An issue fails its level, a warning does not; an experiment passes if each of its levels is there and has no issue.

Defined cases: checks whose columns are not there give a ``missing_column`` row (for optional ones a warning); a table without rows has no shares, so rules on shares do not apply to it, and no controls;
NaN in a feature counts as missing; a feature that holds an infinity has no variance and counts as constant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from heddle.functions.names import control_reason
from heddle.operators.validate import ISSUE, verdicts

#: Fixed limits: shares of all-zero and of constant features, of rows with both boxes, of complete rows, and of controls.
MOST_ZERO, MOST_CONSTANT, LEAST_BOTH, LEAST_COMPLETE, FEW_CONTROLS, MANY_CONTROLS = 0.10, 0.05, 0.90, 0.50, 0.01, 0.20
LEVELS = ("cell", "guide", "gene")


@dataclass(frozen=True)
class Checks:
    """What a level is checked for; parts that are left empty are not checked."""

    level: str
    expected: dict[str, str] = field(default_factory=dict)  #: column -> number or string
    critical: Sequence[str] = ()  #: columns without nulls
    key: str | None = None  #: column without repeats
    features: str | None = None  #: array column of ``n_features`` numbers
    n_features: int = 0
    misplaced: str | None = None  #: prefix of numeric columns that belong to the features
    pair: tuple[Column, Column] | None = None  #: presence of two kinds of boxes
    complete: dict[str, Sequence[str]] = field(default_factory=dict)  #: analysis -> columns that it needs (optional)
    control: tuple[str | None, str | None, str] | None = None  #: gene id, second id and name columns
    guide: str | None = None
    gene: str | None = None
    guides: int = 0  #: size of the library
    genes: int = 0


def _issue(severity: str, check: str, subject: Column | str, n: Column, pct: Column | None = None) -> Column:
    subject = F.lit(subject) if isinstance(subject, str) else subject
    return F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check_name"), subject.cast("string").alias("subject"), n.cast("bigint").alias("n"), (F.lit(None) if pct is None else pct).cast("double").alias("pct"))


def _feature_row(df: DataFrame, features: str) -> DataFrame:
    """One row (_rows, _features) of the rows that have features: greatest and least known value, numbers of missing and of infinite ones per feature; no row if none has."""
    missing, inf = (lambda v: v.isNull() | F.isnan(v)), float("inf")
    vector = lambda f: array_to_vector(F.transform(F.col(features).cast("array<double>"), f))
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    sums = {
        "most": Summarizer.max(vector(lambda v: F.when(missing(v), -inf).otherwise(v))),
        "least": Summarizer.min(vector(lambda v: F.when(missing(v), inf).otherwise(v))),
        "missing": Summarizer.sum(vector(lambda v: one(missing(v)))),
        "inf": Summarizer.sum(vector(lambda v: one(~missing(v) & (F.abs(v) == inf)))),
    }
    row = df.where(F.col(features).isNotNull()).withColumn("_one", F.lit(True)).groupBy("_one").agg(F.count("*").alias("_rows"), *(v.alias(k) for k, v in sums.items()))
    return row.select("_rows", F.arrays_zip(*(vector_to_array(k).alias(k) for k in sums)).alias("_features"))


def validate_table(df: DataFrame, c: Checks) -> DataFrame:
    """The issue rows of a table, each column read once; rows that concern the schema only need no job of their own."""
    known, n = set(df.columns), F.col("_n")
    found: list[tuple] = []
    kinds = {"number": NumericType, "string": StringType}
    for name, kind in c.expected.items():
        if name not in known:
            found.append((c.level, "issue", "missing_column", name, 1, None))
        elif not isinstance(df.schema[name].dataType, kinds[kind]):
            found.append((c.level, "issue", "wrong_type", name, 1, None))
    if c.misplaced and (odd := [f.name for f in df.schema if f.name.startswith(c.misplaced) and isinstance(f.dataType, NumericType)]):
        found.append((c.level, "issue", "misplaced_columns", ",".join(odd), len(odd), None))
    if c.guide and c.guide not in known:
        found.append((c.level, "issue", "missing_column", c.guide, 1, None))
    for analysis, columns in c.complete.items():
        if gone := [x for x in columns if x not in known]:
            found.append((c.level, "warning", "missing_column", f"{analysis}: {','.join(gone)}", len(gone), None))

    sums: dict[str, Column] = {"_n": F.count("*")}
    issues: list[Column] = []
    rule = lambda when, issue: issues.append(F.when(when, issue))
    share = lambda k: F.try_divide(100 * k, n)
    for i, name in enumerate(x for x in c.critical if x in known):
        k = F.col(f"_null{i}")
        sums[f"_null{i}"] = F.count_if(F.col(name).isNull())
        rule(k > 0, _issue("issue", "nulls", name, k, share(k)))
    if c.key in known:
        sums |= {"_keys": F.count_distinct(c.key), "_blank": F.count_if(F.col(c.key).isNull())}
        repeated = n - F.col("_keys") - F.least(F.col("_blank"), F.lit(1))
        rule(repeated > 0, _issue("issue", "duplicates", c.key, repeated, share(repeated)))
    if c.features in known:
        count = lambda test: F.coalesce(F.size(F.filter("_features", test)), F.lit(0))
        absent = lambda f: f["missing"] == F.col("_rows")
        flat = lambda f: ~absent(f) & ((f["most"] == f["least"]) | (f["inf"] > 0))
        zero = lambda f: ~absent(f) & (f["most"] == 0) & (f["least"] == 0)
        part = lambda k: 100 * k / F.lit(c.n_features)
        a, z, s = count(absent), count(zero), count(lambda f: flat(f) & ~zero(f))
        values = F.aggregate("_features", F.lit(0.0), lambda t, f: t + f["inf"])
        rule(a > 0, _issue("issue", "quality", "missing_features", a, part(a)))
        rule(values > 0, _issue("issue", "quality", "infinite_values", values))
        for k, name, most in ((z, "zero_features", MOST_ZERO), (s, "constant_features", MOST_CONSTANT)):
            rule(k > most * c.n_features, _issue("issue", "quality", name, k, part(k)))
            rule((k > 0) & (k <= most * c.n_features), _issue("warning", "quality", name, k, part(k)))
    if c.pair:
        one, other = (F.coalesce(p, F.lit(False)) for p in c.pair)
        sums |= {"_both": F.count_if(one & other), "_neither": F.count_if(~one & ~other)}
        rule(F.col("_both") < LEAST_BOTH * n, _issue("issue", "dual_coverage", "both", F.col("_both"), share(F.col("_both"))))
        rule(F.col("_neither") > 0, _issue("issue", "dual_coverage", "neither", F.col("_neither"), share(F.col("_neither"))))
    for i, (analysis, columns) in enumerate(c.complete.items()):
        if all(x in known for x in columns):
            every = F.lit(True)
            for j, x in enumerate(columns):
                every = every & F.col(x).isNotNull()
                sums[f"_some{i}_{j}"] = F.count(x)
            sums[f"_whole{i}"] = F.count_if(every)
            gone = F.array_compact(F.array(*(F.when((F.col(f"_some{i}_{j}") == 0) & (n > 0), F.lit(x)) for j, x in enumerate(columns))))
            rule(F.size(gone) > 0, _issue("warning", "all_null", F.concat(F.lit(f"{analysis}: "), F.array_join(gone, ",")), F.size(gone)))
            whole = F.col(f"_whole{i}")
            rule((F.size(gone) == 0) & (whole < LEAST_COMPLETE * n), _issue("warning", "incomplete", analysis, whole, share(whole)))
    if c.control:
        ids = [F.col(x) if x in known else F.lit(None).cast("int") for x in c.control[:2]]
        if c.control[2] not in known:
            found.append((c.level, "warning", "missing_column", c.control[2], 1, None))
        else:
            k = F.col("_controls")
            sums["_controls"] = F.count_if(control_reason(*ids, F.col(c.control[2])).isNotNull())
            rule(k == 0, _issue("warning", "controls", "none", k, share(k)))
            rule((k > 0) & (k < FEW_CONTROLS * n), _issue("warning", "controls", "few", k, share(k)))
            rule(k > MANY_CONTROLS * n, _issue("warning", "controls", "many", k, share(k)))
    if c.guide in known:
        text = F.col(c.guide).cast("string")
        sums["_guides"] = F.count_distinct(F.when(~text.isin("", "None"), text))
        rule(F.col("_guides") > c.guides, _issue("issue", "library_size", "guides", F.col("_guides"), 100 * F.col("_guides") / F.lit(c.guides)))
    if c.gene in known:
        sums |= {"_genes": F.count_distinct(c.gene), "_ntc": F.count_if(F.col(c.gene) == "NTC")}
        allowed = F.lit(c.genes) + (F.col("_ntc") > 0).cast("int")  # the control is in no library
        rule(F.col("_genes") > allowed, _issue("issue", "library_size", "genes", F.col("_genes"), 100 * F.col("_genes") / F.lit(c.genes)))

    schema = df.sparkSession.createDataFrame(found, ISSUE)
    if not issues:
        return schema
    row = df.agg(*(v.alias(k) for k, v in sums.items()))
    row = row.join(F.broadcast(_feature_row(df, c.features)), F.lit(True), "left") if c.features in known else row
    unfolded = row.select(F.explode(F.array_compact(F.array(*issues))).alias("i"))
    return schema.unionByName(unfolded.select(F.lit(c.level).alias("level"), "i.*"))


def unassigned_issues(features: DataFrame, level: str, column: str) -> DataFrame:
    """Features (rows of the feature table) without a value in ``column``."""
    n = features.agg(F.count("*").alias("_n"), F.count_if(F.col(column).isNull()).alias("_k")).where("_k > 0")
    return n.select(F.lit(level).alias("level"), F.lit("issue").alias("severity"), F.lit("unassigned_features").alias("check_name"), F.lit(column).alias("subject"), F.col("_k").alias("n"), (100 * F.col("_k") / F.col("_n")).alias("pct"))


def experiment_verdicts(issues: DataFrame, present: DataFrame) -> DataFrame:
    """One row per experiment and level, and one (level ``all``) per experiment, with numbers of issues and warnings and whether it passes.

    ``issues`` has an ``experiment`` column, ``present`` (experiment, level) names the files that are there. A level without a file has one issue.
    """
    key = F.concat_ws("\u0001", "experiment", "level")
    wanted = present.select("experiment").distinct().withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    gone = wanted.join(present, ["experiment", "level"], "left_anti").select("experiment", "level", F.lit("issue").alias("severity"))
    each = verdicts(wanted.select(key.alias("level")), issues.select("experiment", "level", "severity").union(gone).select(key.alias("level"), "severity"))
    parts = F.split("level", "\u0001")
    each = each.select(parts[0].alias("experiment"), parts[1].alias("level"), "n_issues", "n_warnings", "passed")
    whole = each.groupBy("experiment").agg(F.sum("n_issues").alias("n_issues"), F.sum("n_warnings").alias("n_warnings"), F.bool_and("passed").alias("passed"))
    return each.unionByName(whole.withColumn("level", F.lit("all")))
