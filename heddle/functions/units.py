"""Durations, sizes and numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def duration_seconds(text: Column | str) -> Column:
    """``D-HH:MM:SS``, ``HH:MM:SS`` and ``MM:SS`` in seconds; anything else is 0, never NULL."""
    v = _c(text)
    dashed = v.contains("-")
    days = F.when(dashed, F.split(v, "-")[0].try_cast("int")).otherwise(F.lit(0))
    clock = F.split(F.when(dashed, F.get(F.split(v, "-"), F.lit(1))).otherwise(v), ":")
    part = lambda i: F.get(clock, F.lit(i)).try_cast("double")
    value = F.when(F.size(clock) == 3, days * 86400 + part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(clock) == 2, days * 86400 + part(0) * 60 + part(1))
    return F.coalesce(value.cast("double"), F.lit(0.0))


def size_bytes(text: Column | str) -> Column:
    """``123K``, ``123M``, ``12G``, ``1T`` or plain bytes, to the base of 1024; anything else is 0, never NULL."""
    v = F.trim(_c(text))
    power = F.element_at(F.create_map(*[F.lit(x) for kv in (("K", 1024.0), ("M", 1024.0**2), ("G", 1024.0**3), ("T", 1024.0**4)) for x in kv]), F.right(v, F.lit(1)))
    number = F.when(power.isNotNull(), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v).try_cast("double")
    return F.coalesce(number * F.coalesce(power, F.lit(1.0)), F.lit(0.0))


def format_duration(seconds: Column | str) -> Column:
    s = _c(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.format_string("%dh:%02dm:%02ds", h, m, r)).when(m > 0, F.format_string("%dm:%02ds", m, r)).otherwise(F.format_string("%ds", r))


def format_gb(text: Column | str) -> Column:
    b = size_bytes(text)
    return F.when(b == 0, F.lit("-")).otherwise(F.format_string("%.1fGB", b / F.lit(1024.0**3)))


def gpu_metrics(usage: Column | str) -> Column:
    """struct<util_pct, mem_gb> of a list of ``key=value`` parted by commas; NULL where absent or malformed."""
    m = F.str_to_map(_c(usage), F.lit(","), F.lit("="))
    util, mem = F.element_at(m, "gres/gpuutil"), size_bytes(F.element_at(m, "gres/gpumem"))
    return F.struct(F.when(util.rlike(r"^\d+(\.\d*)?$"), util.try_cast("double")).alias("util_pct"), F.when(mem > 0, mem / F.lit(1024.0**3)).alias("mem_gb"))


def neg_log10(p: Column | str, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(_c(p), F.lit(floor)))


def nan_to_null(x: Column | str) -> Column:
    return F.nullif(_c(x).cast("double"), F.lit(float("nan")))


def finite_or_zero(x: Column | str) -> Column:
    v = _c(x).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def nan_to_zero_clipped(x: Column | str) -> Column:
    """NaN becomes 0, infinities the largest doubles."""
    v, top = _c(x).cast("double"), 1.7976931348623157e308
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(F.greatest(F.least(v, F.lit(top)), F.lit(-top)))


def octave(v: Column) -> Column:
    """Whole number that never falls as v grows: sign, power of two and the 256th of it. There are at most 600,000 such numbers; infinities have their own."""
    size = F.abs(v)
    e = F.floor(F.log2(size))
    step = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(1 << 20)).otherwise((e + 1100) * 256 + F.floor((size / F.pow(F.lit(2.0), e) - 1) * 256))
    return (F.signum(v).cast("long") * step).cast("long")
