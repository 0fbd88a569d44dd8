"""Kernel density in two dimensions at every point, with the bandwidth from the covariance (Scott's factor n ** (-1/6)).

Points are whitened, so that the kernel is the round unit one. Cells of ``CELL`` bandwidths keep a count and a mean; a point adds up the kernel over the cells of its own
square of ``SQUARE`` bandwidths and the eight around it. Counts and means are combined before the shuffle, a square holds at most (SQUARE / CELL) ** 2 cells however many
points it has, and points of a crowded square are dealt in parts, so neither a task nor a row grows with a crowd. The cells around a square travel once for each of its parts, not with its points.

Error, as a share of the kernel's peak (``ERROR_SHARE``): what lies beyond a square is below exp(-SQUARE ** 2 / 2), and moving a cell's points to their mean changes a
kernel by at most half its largest second derivative times their spread, CELL ** 2 / 4 along each of two axes.

Defined cases: points with a NULL, NaN or infinite coordinate, and all points where the covariance is singular or fewer than three points are known, have the density NULL; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a cell and of a square, in bandwidths.
CELL, SQUARE = 0.125, 4.0
ERROR_SHARE = math.exp(-(SQUARE**2) / 2) + 0.5 * (CELL**2 / 4 + CELL**2 / 4)
#: Points of one square that one part gets.
PART_POINTS = 100_000
#: Points beside the cells of nine squares in one matrix.
POINTS_AT_ONCE = 512


def density(points: DataFrame, x: str = "x", y: str = "y", name: str = "density") -> DataFrame:
    """``points`` with the estimated density at each of them."""
    def known(c):
        v = F.col(c).cast("double")
        return F.abs(F.nullif(v, F.lit(float("nan")))) < float("inf")

    ok = F.coalesce(known(x) & known(y), F.lit(False))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    s = points.where(ok).agg(F.count("*").alias("n"), F.avg(px).alias("mx"), F.avg(py).alias("my"), F.var_samp(px).alias("vx"), F.var_samp(py).alias("vy"), F.covar_samp(px, py).alias("c")).first()
    lost = F.lit(None).cast("double").alias(name)
    if s.n < 3 or not s.vx * s.vy - s.c * s.c > 1e-12 * s.vx * s.vy:
        return points.select("*", lost)
    h = s.n ** (-1 / 6)
    # z = L^-1 (p - mean) / h with the lower Cholesky factor L of the covariance
    a = math.sqrt(s.vx)
    b = s.c / a
    d = math.sqrt(s.vy - b * b)
    u = (px - s.mx) / (a * h)
    w = (py - s.my - u * (b * h)) / (d * h)
    peak = 1 / (2 * math.pi * s.n * a * d * h * h)
    square = lambda c: F.floor(F.col(c) / SQUARE).cast("long")
    white = points.withColumns({"_u": F.when(ok, u), "_w": F.when(ok, w)}).withColumns({"_su": square("_u"), "_sw": square("_w")})

    known_rows = white.where("_su IS NOT NULL")
    cells = known_rows.groupBy("_su", "_sw", F.floor(F.col("_u") / CELL).alias("cu"), F.floor(F.col("_w") / CELL).alias("cw")).agg(F.count("*").cast("double").alias("n"), F.avg("_u").alias("u"), F.avg("_w").alias("w"))
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    near = cells.withColumn("_du", step).withColumn("_dw", step).select((F.col("_su") + F.col("_du")).alias("_su"), (F.col("_sw") + F.col("_dw")).alias("_sw"), F.struct("n", "u", "w").alias("cell"))
    near = near.groupBy("_su", "_sw").agg(F.collect_list("cell").alias("_cells"))
    parts = known_rows.groupBy("_su", "_sw").agg(F.ceil(F.count("*") / F.lit(PART_POINTS)).cast("int").alias("_parts"))
    dealt = near.join(parts, ["_su", "_sw"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    crowded = F.broadcast(parts.where("_parts > 1"))  # at most one for every PART_POINTS points
    rows = known_rows.join(crowded, ["_su", "_sw"], "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_u", "_w", F.monotonically_increasing_id()), F.col("_parts")), F.lit(0)).cast("int"))
    # the cells of a part come once, as a row of their own before its points
    key, columns = ["_su", "_sw", "_part", "_at"], F.struct(*[f"`{c}`" for c in points.columns]).alias("_row")
    beside = dealt.select("_su", "_sw", "_part", F.lit(0).alias("_at"), "_cells")
    together = beside.unionByName(rows.select("_su", "_sw", "_part", F.lit(1).alias("_at"), columns, "_u", "_w"), allowMissingColumns=True)
    read = together.repartition(max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key[:3]).sortWithinPartitions(*key)
    kind = read.schema["_row"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = u = w = np.zeros(0)
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            place = np.column_stack([column[c].to_numpy(zero_copy_only=False) for c in key])
            p = np.column_stack([column[c].to_numpy(zero_copy_only=False).astype(float) for c in ("_u", "_w")])
            out = np.full(batch.num_rows, np.nan)
            for lo, hi in _runs(place):
                if hi > lo and not place[lo, 3]:
                    n, u, w = (column["_cells"][lo].values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    continue
                for at in range(lo, hi, POINTS_AT_ONCE):
                    some = p[at : min(at + POINTS_AT_ONCE, hi)]
                    far = (some[:, 0, None] - u) ** 2 + (some[:, 1, None] - w) ** 2
                    out[at : at + len(some)] = np.exp(-far / 2) @ n * peak
            held = np.flatnonzero(place[:, 3])
            yield pa.record_batch([column["_row"].take(pa.array(held)), pa.array(out[held], from_pandas=True)], names=["_row", name])

    return read.mapInArrow(add, f"_row {kind}, `{name}` double").select("_row.*", name).union(points.where(~ok).select("*", lost))


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True))
