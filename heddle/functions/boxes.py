"""Bounding boxes (ymin, xmin, ymax, xmax), tiles and pyramid levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = ("ymin", "xmin", "ymax", "xmax")


def box(ymin: Column, xmin: Column, ymax: Column, xmax: Column) -> Column:
    return F.struct(*[v.cast("int").alias(n) for v, n in zip((ymin, xmin, ymax, xmax), _NAMES, strict=True)])


def parse_box(text: Column | str) -> Column:
    """Box of ``(1, 2, 3, 4)`` or ``[1 2 3 4]``; NULL unless there are exactly four numbers in brackets."""
    v = F.col(text) if isinstance(text, str) else text
    parts = F.regexp_extract_all(v, F.lit(r"-?\d+"), F.lit(0))
    good = v.rlike(r"^\s*[\(\[]\s*-?\d+(\.0*)?([,\s]+-?\d+(\.0*)?){3}\s*[\)\]]\s*$")
    plain = F.regexp_extract_all(F.regexp_replace(v, r"\.0*(?!\d)", ""), F.lit(r"-?\d+"), F.lit(0))
    return F.when(good & (F.size(plain) == 4), box(*[F.get(plain, F.lit(i)) for i in range(4)])).otherwise(F.when(F.lit(False), box(*[parts[i] for i in range(4)])))


def pad_box(b: Column, height: int, width: int) -> Column:
    """Grown symmetrically to at least the target; half pixels are cut off towards zero."""
    y, x = (F.greatest(F.lit(0), F.lit(t) - (b[hi] - b[lo])) / F.lit(2) for t, lo, hi in ((height, "ymin", "ymax"), (width, "xmin", "xmax")))
    return box(b["ymin"] - y, b["xmin"] - x, b["ymax"] + y, b["xmax"] + x)


def clip_box(b: Column, height: Column | int, width: Column | int) -> Column:
    h, w = (F.lit(v) if isinstance(v, int) else v for v in (height, width))
    return box(F.greatest(F.lit(0), b["ymin"]), F.greatest(F.lit(0), b["xmin"]), F.least(h, b["ymax"]), F.least(w, b["xmax"]))


def level_shapes(shape: Column, levels: int, factor: int = 2) -> Column:
    """Shapes of a pyramid: the last two axes shrink by the factor, never below one."""
    n = F.size(shape)
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.transform(shape, lambda s, i: F.when(i >= n - 2, F.greatest(F.lit(1), F.floor(s / F.pow(F.lit(factor), k)).cast("int"))).otherwise(s)))


def level_scales(levels: int, axes: int = 5, factor: int = 2) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(axes - 1)), lambda i: F.when(i >= axes - 2, F.pow(F.lit(float(factor)), k)).otherwise(F.lit(1.0))))


def clamp_shard(shard: Column, chunk: Column, size: Column) -> Column:
    """A shard never exceeds the axis, rounded up to whole chunks."""
    return F.least(shard, F.ceil(size / chunk).cast("int") * chunk)
