"""Summaries of scores: weighted areas, threshold sweeps, curves on a common grid, distributions, rankings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.units import nan_to_null, octave
from heddle.operators.spatial import numbered, sorted_parts


def weighted_score(groups: DataFrame, score: str, p: str, floor: float = 1e-6, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of score times -log10(p clipped to [floor, 1]) over its largest value, of the rows that know both (NULL and NaN are unknown); NaN below three groups, or if no row knows both."""
    known, scored = nan_to_null(p), nan_to_null(score)
    weight = F.when(known.isNotNull(), -F.log10(F.greatest(F.least(known, F.lit(1.0)), F.lit(floor))) / F.lit(-math.log10(floor)))
    mean = F.coalesce(F.avg(scored * weight), F.lit(float("nan")))
    return groups.groupBy(*by).agg(F.when(F.count("*") < 3, F.lit(float("nan"))).otherwise(mean).alias("auc_score"))


def log_grid(spark, low: float = 1e-6, n: int = 100) -> DataFrame:
    """(k, t, x): thresholds from one down to ``low`` in equal steps of x = -log10(t)."""
    x = F.col("id") * F.lit(-math.log10(low) / (n - 1))
    return spark.range(n).select(F.col("id").cast("int").alias("k"), F.pow(F.lit(10.0), -x).alias("t"), x.alias("x"))


def threshold_sweep(groups: DataFrame, score: str, p: str, grid: DataFrame) -> DataFrame:
    """(k, t, x, y): share of groups with p < t times their mean score; zero where none is below.

    Each group counts once, for the number of thresholds above its p; as thresholds fall with k, what a threshold covers is the sum over all larger numbers. The thresholds
    are one row of the (small) grid, so rows are not multiplied; the window is over the grid.
    """
    steps = grid.agg(F.array_sort(F.collect_list("t")).alias("_t"))
    below = groups.join(F.broadcast(steps)).select(F.size(F.filter("_t", lambda t: F.col(p) < t)).alias("_m"), F.col(score).cast("double").alias("_s"))
    counted = below.groupBy("_m").agg(F.count("*").alias("_n"), F.count("_s").alias("_c"), F.sum("_s").alias("_s"))
    ranked = grid.select("k", "t", "x", (F.col("k") + 1).alias("_m"), F.lit(0).alias("_n"), F.lit(0).alias("_c"), F.lit(0.0).alias("_s"))
    every = counted.select(F.lit(None).alias("k"), F.lit(None).alias("t"), F.lit(None).alias("x"), "_m", "_n", "_c", F.coalesce("_s", F.lit(0.0)).alias("_s")).union(ranked)
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("_m")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    n, c, total = F.sum("_n").over(up), F.sum("_c").over(up), F.sum("_s").over(up)
    y = n / F.sum("_n").over(whole) * F.coalesce(total / F.nullif(c, F.lit(0)), F.lit(0.0))
    return every.withColumn("y", y).where("k IS NOT NULL").select("k", "t", "x", "y")


def trapezoid(curve: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under y over x / max(x)."""
    w = Window.partitionBy(*by).orderBy(x) if by else Window.partitionBy(F.lit(0)).orderBy(x)
    step = curve.withColumn("_a", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    return step.groupBy(*by).agg((F.sum("_a") / F.max(x)).alias("area"))


#: Places of x in one block of ``mean_curve``.
CURVE_BLOCK = 256


def mean_curve(points: DataFrame, series: str, x: str, y: str, block: int = CURVE_BLOCK) -> DataFrame:
    """Mean over the series of their linear interpolation on the union of all x; flat beyond a series' ends.

    The union of x is numbered by ranges and cut into blocks. Between two of its points a series is a line, so a block without a point of it needs its values at
    both ends only: these lines are added up by block and read off at each x in between. In blocks where a series has points its line is taken at each x. Lines are
    never continued from sums of slopes, so steep ones leave no error behind; rows are (series x blocks) and (points x block), not series x all x.

    Defined cases: values of one series at one x are averaged; NULL, NaN and infinite y are unknown, their x stays in the union;
    rows of such an x are left out, and a NULL series only adds its x; without any known y the mean is NULL and ``n`` zero.
    """
    finite = lambda c: F.when(F.abs(F.nullif(F.col(c).cast("double"), F.lit(float("nan")))) < float("inf"), F.col(c).cast("double"))
    rows = points.select(F.col(series).alias("_s"), finite(x).alias("_x"), finite(y).alias("_y")).where("_x IS NOT NULL").groupBy("_s", "_x").agg(F.avg("_y").alias("_y"))
    union = numbered(rows.select("_x").distinct(), ["_x"], "_place").select("_x", (F.col("_place") - 1).alias("_i")).withColumn("_b", F.expr(f"_i div {block}"))
    blocks = union.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_at")).withColumns({"_low": F.col("_at")[0]["_x"], "_high": F.element_at("_at", -1)["_x"]})

    # each known point with the next one of its series; one row of each range crosses to one task
    placed = sorted_parts(rows.where("_s IS NOT NULL AND _y IS NOT NULL").join(union, "_x"), ["_s", "_x"])
    v, w, here = Window.partitionBy(F.lit(0)).orderBy("_p"), Window.partitionBy("_p").orderBy("_s", "_x"), F.struct("_s", "_x", "_y", "_i")
    edges = placed.groupBy("_p").agg(F.min(here).alias("_head"), F.max(here).alias("_tail")).select("_p", F.lag("_tail").over(v).alias("_before"), F.lead("_head").over(v).alias("_after"))
    near = placed.join(F.broadcast(edges), "_p").withColumn("_before", F.coalesce(F.lag(here).over(w), "_before")).withColumn("_after", F.coalesce(F.lead(here).over(w), "_after"))
    whole = union.agg(F.coalesce(F.max("_i") + 1, F.lit(0)).alias("_all"))
    known = near.agg(F.count_distinct("_s").alias("n"))
    near = near.join(F.broadcast(whole))
    first, last = F.coalesce(F.col("_before")["_s"] != F.col("_s"), F.lit(True)), F.coalesce(F.col("_after")["_s"] != F.col("_s"), F.lit(True))
    part = lambda low, high, to_x, to_y: F.struct(low.alias("lo"), high.alias("hi"), F.col("_x").alias("x0"), F.col("_y").alias("y0"), to_x.cast("double").alias("x1"), to_y.cast("double").alias("y1"))
    nothing = F.lit(None)
    after = part(F.col("_i"), F.when(last, F.col("_all")).otherwise(F.col("_after")["_i"]), F.when(~last, F.col("_after")["_x"]), F.when(~last, F.col("_after")["_y"]))
    before = F.when(first & (F.col("_i") > 0), part(F.lit(0).cast("long"), F.col("_i"), nothing, nothing))
    lines = near.select(F.explode(F.array_compact(F.array(after, before))).alias("l")).select("l.*")
    lines = lines.withColumns({"b0": F.expr(f"lo div {block}"), "b1": F.expr(f"(hi - 1) div {block}")})
    value = lambda c: F.when(F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * ((c - F.col("x0")) / (F.col("x1") - F.col("x0"))))

    inner = lines.where("b1 > b0 + 1").withColumn("_b", F.explode(F.sequence(F.col("b0") + 1, F.col("b1") - 1))).join(blocks.drop("_at"), "_b")
    inner = inner.groupBy("_b").agg(F.sum(value(F.col("_low"))).alias("_from"), F.sum(value(F.col("_high"))).alias("_to"))
    ends = lines.withColumn("_b", F.explode(F.array_distinct(F.array("b0", "b1")))).join(blocks, "_b")
    ends = ends.withColumn("_at", F.explode(F.filter("_at", lambda p: (p["_i"] >= F.col("lo")) & (p["_i"] < F.col("hi"))))).select(F.col("_at._i").alias("_i"), value(F.col("_at._x")).alias("_v"))
    direct = ends.groupBy("_i").agg(F.sum("_v").alias("_v"))
    out = union.join(blocks.drop("_at").join(inner, "_b", "left"), "_b").join(direct, "_i", "left")
    rise = F.coalesce(F.try_divide(F.col("_x") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    line = F.col("_from") + (F.col("_to") - F.col("_from")) * rise
    total = F.coalesce("_v", F.lit(0.0)) + F.coalesce(line, F.lit(0.0))
    return out.join(F.broadcast(known)).select(F.col("_x").alias(x), (total / F.nullif("n", F.lit(0))).alias(y), "n")


def distribution(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric: n, mean, exact quartiles (interpolated); NULL and NaN left out. Without rows there is no row.

    Values are counted first, then their buckets: the ranks of the quartiles point to at most six buckets of a metric, and
    only the distinct values of those are put in order.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.nullif(F.col(m).cast("double"), F.lit(float("nan"))).alias("v")) for m in metrics])).alias("s")).select("s.*")
    counts = long.groupBy("metric", "v").agg(F.count("v").alias("c")).withColumn("b", octave(F.col("v")))
    sizes = counts.groupBy("metric", "b").agg(F.sum("c").alias("c"), F.sum(F.col("v") * F.col("c")).alias("s"))
    total = sizes.groupBy("metric").agg(F.sum("c").alias("n"), F.sum("s").alias("s"))
    before = F.sum("c").over(Window.partitionBy("metric").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    place = F.col("q") * (F.col("n") - 1)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil(place).alias("rank"))))
    ranks = total.where("n > 0").withColumn("q", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).select("metric", "q", (place - F.floor(place)).alias("part"), ends.alias("e")).select("metric", "q", "part", "e.*")
    within = lambda start: (F.col("rank") >= start) & (F.col("rank") < start + F.col("c"))
    # six ranks of each named metric, so they may be broadcast
    found = sizes.where("b IS NOT NULL").withColumn("before", before).join(F.broadcast(ranks), "metric").where(within(F.col("before")))
    start = F.sum("c").over(Window.partitionBy("metric", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    inside = counts.join(F.broadcast(found.select("metric", "b").distinct()), ["metric", "b"], "left_semi").withColumn("start", start)
    at = inside.join(F.broadcast(found.select("metric", "b", "before", "q", "part", "end", "rank")), ["metric", "b"]).where(within(F.col("before") + F.col("start")))
    ends = at.groupBy("metric", "q", "part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (1 - F.col("part")) + F.col("hi") * F.col("part"))
    quartile = lambda q: F.max(F.when(F.col("q") == q, value))
    cuts = ends.groupBy("metric").agg(quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"))
    return total.join(cuts, "metric", "left").select("metric", "n", (F.col("s") / F.nullif("n", F.lit(0))).alias("mean"), "q1", "median", "q3")


def top_rows(df: DataFrame, value: str, n: int, tie: str, drop: Column | None = None) -> DataFrame:
    """The n largest, ties by ``tie``; rows matching ``drop`` are left out first."""
    rows = df if drop is None else df.where(~F.coalesce(drop, F.lit(False)))
    return rows.orderBy(F.col(value).desc_nulls_last(), tie).limit(n)


def channel_label(experiments: Column, signal: Column) -> Column:
    """Signal with its experiments: up to two by name, more by number."""
    names = F.transform(F.split(experiments, ","), lambda x: F.trim(x))
    return F.concat_ws("_", F.when(F.size(names) > 2, F.concat(F.size(names).cast("string"), F.lit("ops_exps"))).otherwise(F.array_join(names, "_")), signal)


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Counts per value, NULL included, most frequent first."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out if n is None else out.orderBy(F.col("n").desc(), F.col(column).asc_nulls_first()).limit(n)
