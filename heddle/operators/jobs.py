"""Accounting of jobs: step records, ranges, sub-task metrics, rates of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.units import duration_seconds, size_bytes


def base_job(job_id: Column) -> Column:
    return F.substring_index(job_id, ".", 1)


def best_records(records: DataFrame, fields: list[str]) -> DataFrame:
    """One row per job: the fields of its best step (``.0`` before ``.batch``) laid over the main record where they are not blank."""
    kind = F.when(F.col("job_id").endswith(".0"), 1).when(F.col("job_id").endswith(".batch"), 2).when(~F.col("job_id").contains("."), 0)
    rows = records.withColumn("_job", base_job(F.col("job_id"))).withColumn("_k", kind).where("_k IS NOT NULL")
    whole = F.struct(*fields)
    one = rows.groupBy("_job").agg(F.max(F.when(F.col("_k") == 0, whole)).alias("_m"), F.min_by(whole, F.when(F.col("_k") > 0, F.col("_k"))).alias("_s"))
    return one.select(F.col("_job").alias("job_id"), *[F.coalesce(F.nullif(F.trim(F.col(f"_s.{f}")), F.lit("")), F.col(f"_m.{f}")).alias(f) for f in fields])


def resource_summary(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Ranges of time, memory and use of processors; values of zero are no measurement."""
    elapsed, memory, cpu, alloc = duration_seconds("elapsed"), size_bytes("max_rss"), duration_seconds("total_cpu"), F.col("alloc_cpus").cast("double")
    some = lambda v: F.when(v > 0, v)
    use = F.when((elapsed > 0) & (alloc > 0), 100 * cpu / (elapsed * alloc))
    return jobs.groupBy(*by).agg(F.count("*").alias("n_jobs"), F.min(some(elapsed)).alias("min_s"), F.max(some(elapsed)).alias("max_s"), (F.min(some(memory)) / F.lit(1024.0**3)).alias("min_gb"), (F.max(some(memory)) / F.lit(1024.0**3)).alias("max_gb"), F.avg(use).alias("cpu_pct"))


#: Measures of a sub-task's entry and what a parent reports of them: column -> ((result, function, digits), ...).
_MEASURES = {
    "gpu_sm_util_avg_pct": (("gpu_sm_util_mean", "avg", 2), ("gpu_sm_util_min", "min", 2), ("gpu_sm_util_max", "max", 2)),
    "gpu_sm_util_max_pct": (("gpu_sm_util_peak", "max", 2),),
    "gpu_mem_used_mib": (("gpu_mem_mib_max", "max", 1),),
    "gpu_mem_used_percent": (("gpu_mem_pct_max", "max", 2),),
    "gpu_power_avg_w": (("gpu_power_mean", "avg", 1),),
    "gpu_power_max_w": (("gpu_power_max", "max", 1),),
    "cpu_util_pct": (("cpu_util_mean", "avg", 2),),
}


def parent_keys(key: Column) -> Column:
    """What stands before each underscore of a key: the keys of all entries above it."""
    cut = lambda i: F.when(F.substr(key, i, F.lit(1)) == "_", F.substr(key, F.lit(1), i - 1))
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), cut), lambda k: k.isNotNull())


def subtask_rollup(log: DataFrame, parents: DataFrame) -> DataFrame:
    """One row per parent with sub-tasks, the entries at any depth whose key starts with the parent's and an underscore: number, seconds, hosts, and the measures of ``_MEASURES`` and GPU models that the log has.

    Entries are added up for all keys above them, combined before the shuffle, and parents meet one row per key. Seconds are read from numbers and texts like
    ``12.5 seconds``; other texts are unknown. Results of measures that no sub-task has are NULL; parents given twice count once; NULL keys are no entries.
    """
    text = F.trim(F.col("duration").cast("string"))
    seconds = F.when(text.endswith("seconds"), F.split(text, r"\s+")[0].try_cast("double")).otherwise(text.try_cast("double"))
    above = log.where("log_key IS NOT NULL").withColumns({"_s": seconds, "parent": F.explode(parent_keys(F.col("log_key")))})
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",")
    results = [F.count("*").alias("n"), *(F.round(f(F.col("_s")), 2).alias(n) for n, f in (("total_s", F.sum), ("mean_s", F.avg), ("min_s", F.min), ("max_s", F.max))), listed("hostname").alias("hosts")]
    for c in [c for c in _MEASURES if c in log.columns]:
        results += [F.round(getattr(F, f)(F.col(c).cast("double")), d).alias(n) for n, f, d in _MEASURES[c]]
    results += [listed("gpu_models").alias("gpu_models")] if "gpu_models" in log.columns else []
    return above.groupBy("parent").agg(*results).join(parents.select(F.col("log_key").alias("parent")).distinct(), "parent")


def latest_per_key(log: DataFrame, key: str, order: str) -> DataFrame:
    """The log as last written: one row per key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("_r")).select("_r.*")


def counter_rate(samples: DataFrame, process: str, time: str, counter: str, interval: float) -> DataFrame:
    """Growth of a counter per second between samples; the first sample of a process is zero."""
    w = Window.partitionBy(process).orderBy(time)
    return samples.withColumn("rate", F.coalesce((F.col(counter) - F.lag(counter).over(w)) / interval, F.lit(0.0)))


def tick_means(samples: DataFrame, tick: str, value: str) -> DataFrame:
    """Mean and maximum over the ticks of the largest value of each tick."""
    return samples.groupBy(tick).agg(F.max(value).alias("_v")).agg(F.avg("_v").alias("mean_of_max"), F.max("_v").alias("max_of_max"), F.count("*").alias("n_ticks"))
