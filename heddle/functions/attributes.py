"""Attributes of image stores and configurations, read from JSON text and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEVEL = "contrast_limits: array<string>, contrast_limits_per_channel: array<array<string>>"
_SCHEMA = f"struct<{_LEVEL}, clims_per_level: map<string, struct<{_LEVEL}>>, gamma_per_channel: array<double>>"


def _pair(x: Column) -> Column:
    """Two numbers, or NULL."""
    n = F.transform(x, lambda v: v.try_cast("double"))
    return F.when((F.size(n) == 2) & ~F.exists(n, lambda v: v.isNull()), n)


def contrast_limits(attributes: Column, level: Column, n_channels: Column) -> Column:
    """struct<limits, per_channel, gamma> of a pyramid level: from the per-level map of the position if there is one, else from the level's own attributes. Anything that is not a pair of numbers is NULL; channels beyond the list are NULL."""
    a = F.from_json(attributes, _SCHEMA)
    mapped = F.size(a["clims_per_level"]) > 0
    own = F.element_at(a["clims_per_level"], level.cast("string"))
    limits = F.when(mapped, own["contrast_limits"]).otherwise(a["contrast_limits"])
    each = F.when(mapped, own["contrast_limits_per_channel"]).otherwise(a["contrast_limits_per_channel"])
    per_channel = F.when(each.isNotNull(), F.transform(F.sequence(F.lit(0), n_channels - 1), lambda i: _pair(F.get(each, i))))
    return F.struct(_pair(limits).alias("limits"), per_channel.alias("per_channel"), a["gamma_per_channel"].alias("gamma"))


#: Labels of channels without fluorescence.
PLAIN_LABELS = ("phase", "bf", "brightfield")


def has_fluorescence(channels: Column, fixed: Column | None = None) -> Column:
    """Whether any channel of a map (name to label) has a label that is not plain; channels of fixed panels are left out."""
    skip = F.coalesce(fixed, F.array().cast("array<string>")) if fixed is not None else F.array().cast("array<string>")
    label = lambda e: F.lower(F.trim(F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.exists(F.map_entries(channels), lambda e: ~F.array_contains(skip, e["key"]) & (label(e) != "") & ~label(e).isin(*PLAIN_LABELS)), F.lit(False))
