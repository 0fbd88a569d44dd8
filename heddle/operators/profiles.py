"""Preparation of profiles: standardisation, constant features, per-feature quality, principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.units import nan_to_null
from heddle.functions.vectors import clean


def zscore(df: DataFrame, columns: list[str], control: Column | None = None, least: int = 2) -> DataFrame:
    """Standardise by all rows, or by the control rows where there are at least ``least`` of them.

    NaN counts as missing; the deviation has n - 1 below it; a deviation of exactly zero becomes one; a single row has
    no deviation and gives NULL. One aggregate of one row is joined to all rows.
    """
    flag = F.lit(True) if control is None else F.coalesce(control, F.lit(False))
    value = {c: nan_to_null(F.col(c)) for c in columns}
    aggs = [F.count_if(flag).alias("_n")]
    for i, c in enumerate(columns):
        aggs += [F.avg(value[c]).alias(f"_a{i}"), F.stddev_samp(value[c]).alias(f"_s{i}"), F.avg(F.when(flag, value[c])).alias(f"_ca{i}"), F.stddev_samp(F.when(flag, value[c])).alias(f"_cs{i}")]
    stats = df.agg(*aggs)
    use = F.col("_n") >= least
    out = {c: (value[c] - F.when(use, F.col(f"_ca{i}")).otherwise(F.col(f"_a{i}"))) / F.when(F.when(use, F.col(f"_cs{i}")).otherwise(F.col(f"_s{i}")) == 0, F.lit(1.0)).otherwise(F.when(use, F.col(f"_cs{i}")).otherwise(F.col(f"_s{i}"))) for i, c in enumerate(columns)}
    return df.crossJoin(F.broadcast(stats)).select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def feature_stats(df: DataFrame, features: str) -> DataFrame:
    """One row per feature: n, n_missing, n_inf, variance (of the population; NaN and infinities as zero), max_abs. One pass of vector summaries, combined before the shuffle; only their one row is spread out."""
    x = F.col(features).cast("array<double>")
    flags = lambda test: array_to_vector(F.transform(x, lambda v: F.when(test(v), 1.0).otherwise(0.0)))
    own = Summarizer.metrics("count", "variance", "max", "min")
    sums = df.where(F.col(features).isNotNull()).agg(
        own.summary(array_to_vector(clean(features))).alias("c"),
        Summarizer.metrics("sum").summary(flags(lambda v: v.isNull() | F.isnan(v))).alias("m"),
        Summarizer.metrics("sum").summary(flags(lambda v: F.coalesce(F.abs(v) == float("inf"), F.lit(False)))).alias("i"),
    )
    n = F.col("c.count")
    columns = F.arrays_zip(vector_to_array("c.variance").alias("variance"), vector_to_array("c.max").alias("max"), vector_to_array("c.min").alias("min"), vector_to_array("m.sum").alias("missing"), vector_to_array("i.sum").alias("inf"))
    long = sums.select(n.alias("n"), F.posexplode(columns).alias("feature", "s"))
    return long.select("feature", "n", F.col("s.missing").cast("long").alias("n_missing"), F.col("s.inf").cast("long").alias("n_inf"), (F.col("s.variance") * (F.col("n") - 1) / F.col("n")).alias("variance"), F.greatest(F.abs("s.max"), F.abs("s.min")).alias("max_abs"))


def feature_quality(df: DataFrame, features: str, zero_share: float = 0.10, constant_share: float = 0.05) -> DataFrame:
    """One row: counts of all-missing, infinite, all-zero and constant features and whether their shares are too large."""
    s = feature_stats(df, features)
    zero, constant = (F.col("variance") == 0) & (F.col("max_abs") == 0), (F.col("variance") == 0) & (F.col("max_abs") > 0)
    out = s.agg(F.count("*").alias("n_features"), F.count_if(F.col("n") == F.col("n_missing")).alias("n_all_missing"), F.count_if(F.col("n_inf") > 0).alias("n_with_inf"), F.count_if(zero).alias("n_zero"), F.count_if(constant).alias("n_constant"))
    return out.withColumn("zero_issue", F.col("n_zero") > zero_share * F.col("n_features")).withColumn("constant_issue", F.col("n_constant") > constant_share * F.col("n_features"))


def drop_constant(df: DataFrame, features: str) -> DataFrame:
    """Arrays without the features whose population variance is zero. The kept positions are one row of booleans."""
    keep = feature_stats(df, features).agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", (F.col("variance") > 0).alias("keep")))), lambda x: x["keep"]).alias("_keep"))
    return df.crossJoin(F.broadcast(keep)).withColumn(features, F.filter(clean(features), lambda x, i: F.get(F.col("_keep"), i))).drop("_keep")


def fit_pca(df: DataFrame, features: str, components: int):
    """Principal components of the cleaned vectors, at most rows - 1 and columns - 1. The covariance is d x d, whatever the rows."""
    vectors = df.select(array_to_vector(clean(features)).alias("v"))
    n, d = vectors.count(), df.select(F.max(F.size(features))).first()[0] or 0
    return PCA(k=max(1, min(n - 1, d - 1, components)), inputCol="v", outputCol="pc").fit(vectors)


def explained(spark, model) -> DataFrame:
    """component (from 1), ratio, cumulative."""
    rows, total = [], 0.0
    for i, r in enumerate(model.explainedVariance.toArray().tolist()):
        total += r
        rows.append((i + 1, float(r), float(total)))
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


def apply_pca(df: DataFrame, features: str, model, out: str = "pcs") -> DataFrame:
    return model.transform(df.withColumn("v", array_to_vector(clean(features)))).withColumn(out, vector_to_array("pc")).drop("v", "pc")


def components_for(variance: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Components needed for each threshold of cumulative variance, at most all."""
    return thresholds.join(F.broadcast(variance)).groupBy("threshold").agg(F.least(F.count_if(F.col("cumulative") < F.col("threshold")) + 1, F.count("*")).alias("n_pcs"))
