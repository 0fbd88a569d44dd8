"""Names of experiments, wells, channels, labels and features as column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_lit = F.lit


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def experiment_key(name: Column | str) -> Column:
    """First ``ops`` with four digits anywhere, lower-cased; NULL if there is none."""
    return F.nullif(F.lower(F.regexp_extract(_c(name), r"(?i)(ops\d{4})", 1)), _lit(""))


def experiment_short(name: Column | str) -> Column:
    """The key, or what stands before the first underscore."""
    return F.coalesce(experiment_key(name), F.substring_index(_c(name), "_", 1))


def experiment_number(key: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(key), r"(?i)^ops0*(\d+)", 1), _lit("")).cast("int")


def experiment_date(name: Column | str) -> Column:
    """Date text of a name that consists of key and date only."""
    return F.nullif(F.regexp_extract(_c(name), r"(?i)^ops\d{4}_(\d{8})$", 1), _lit(""))


def is_experiment(name: Column | str, suffix: bool = False) -> Column:
    return F.coalesce(_c(name).rlike(r"^ops\d{4}_\d{8}(_.+)?$" if suffix else r"^ops\d{4}_\d{8}$"), _lit(False))


def canonical_well(well: Column | str) -> Column:
    """ROW/COL: a bare number gets row A, letters with digits are parted, anything else is kept."""
    w = F.upper(F.trim(_c(well).cast("string")))
    return (
        F.when(w.contains("/"), w)
        .when(w.rlike(r"^\d+$"), F.concat(_lit("A/"), w))
        .when(w.rlike(r"^[A-Z]+\d+$"), F.concat(F.regexp_extract(w, r"^([A-Z]+)(\d+)$", 1), _lit("/"), F.regexp_extract(w, r"^([A-Z]+)(\d+)$", 2)))
        .otherwise(w)
    )


def parse_well(well: Column | str) -> Column:
    """struct<row, col> of the canonical well."""
    parts = F.split(canonical_well(well), "/")
    return F.struct(F.get(parts, _lit(0)).alias("row"), F.get(parts, _lit(1)).try_cast("int").alias("col"))


def well_prefix(well: Column | str) -> Column:
    """"A/1/0" becomes "A1-"; a value without a slash is kept."""
    parts = F.split(_c(well), "/")
    return F.when(F.size(parts) >= 2, F.concat(parts[0], parts[1], _lit("-"))).otherwise(_c(well))


def position_path(position: Column | str) -> Column:
    """"A1-Site_0" becomes "A/1/0"; other forms are kept."""
    parts = F.split(_c(position), "-Site_")
    return F.when(F.size(parts) == 2, F.concat(canonical_well(F.get(parts, _lit(0))), _lit("/"), F.get(parts, _lit(1)))).otherwise(_c(position))


def well_group(key: Column | str) -> Column:
    """Row and column of a position path."""
    return F.substring_index(_c(key), "/", 2)


#: Spellings of a channel by its canonical name.
CHANNEL_SPELLINGS = {"BF": ("brightfield", "bf", "bright field", "phase", "bf_phase"), "GFP": ("gfp",), "mCherry": ("mcherry", "m-cherry", "cherry")}


def canonical_channel(name: Column | str) -> Column:
    low, out = F.lower(F.trim(_c(name))), F.trim(_c(name))
    for canonical, spellings in CHANNEL_SPELLINGS.items():
        out = F.when(low.isin(*spellings), _lit(canonical)).otherwise(out)
    return F.coalesce(out, _lit(""))


def normalize_channel(name: Column | str) -> Column:
    """Phase, Phase2D, Phase3D stand for the bright-field channel."""
    return F.when(_c(name).startswith("Phase"), _lit("BF")).otherwise(_c(name))


def split_label(label: Column | str) -> Column:
    """struct<organelle, marker> of a channel map label: split at the first comma; ``no label`` and NULL are unlabeled."""
    v = _c(label)
    parts = F.split(v, ",", 2)
    many = v.contains(",") & (v != "Phase") & (v != "no label")
    organelle = F.when(v.isNull() | (v == "no label"), _lit("unlabeled")).when(many, F.trim(parts[0])).otherwise(v)
    return F.struct(organelle.alias("organelle"), F.when(many, F.trim(F.get(parts, _lit(1)))).alias("marker"))


def split_label_strict(label: Column | str) -> Column:
    """struct<organelle, marker> split at the first comma that a space follows."""
    v = _c(label)
    parts = F.split(v, ", ", 2)
    return F.struct(F.trim(parts[0]).alias("organelle"), F.when(v.contains(", "), F.trim(F.get(parts, _lit(1)))).alias("marker"))


def sanitize_label(label: Column | str) -> Column:
    """Slashes become underscores, then the part behind the first comma is taken, then spaces become underscores."""
    v = F.translate(_c(label), "/\\", "__")
    v = F.when(v.contains(","), F.trim(F.get(F.split(v, ",", 2), _lit(1)))).otherwise(v)
    return F.replace(v, _lit(" "), _lit("_"))


def signal_file(signal: Column | str) -> Column:
    """A signal's label as a file name: spaces become underscores, slashes hyphens; commas and round brackets go."""
    return F.translate(_c(signal), " /,()", "_-")


def derived_label(channel: Column | str) -> Column:
    """Label spelled out in a channel's own name: ``CP1_organelle_marker`` and ``4i_R1_organelle_marker`` or ``4i_R1_marker``; NULL otherwise."""
    v = _c(channel)
    parts = F.split(v, "_", 3)
    rest = F.get(parts, _lit(2))
    inner = F.split(rest, "_", 2)
    return (
        F.when(v.rlike("^CP[12]_") & (F.size(parts) == 3), F.concat(parts[1], _lit(", "), rest))
        .when(v.rlike("^4i_[Rr]") & (F.size(parts) == 3), F.when(rest.contains("_"), F.concat(inner[0], _lit(", "), F.get(inner, _lit(1)))).otherwise(rest))
    )


def short_label(label: Column | str, channel: Column | str) -> Column:
    """Marker, or organelle; an unlabeled channel is named after itself."""
    parts = split_label(label)
    marker = F.nullif(parts.getField("marker"), _lit(""))
    return F.coalesce(marker, F.when(parts.getField("organelle") == "unlabeled", F.concat(_lit("unlabeled_"), _c(channel))), parts.getField("organelle"))


def feature_name(experiment: Column | str, label: Column | str, channel: Column | str, kind: Column, index: Column) -> Column:
    return F.concat_ws("_", experiment_short(experiment), short_label(label, channel), kind, index.cast("string"))


#: Words that tell a dye (anywhere in the marker) and exact names of virtual stains; label-free channels.
DYE_WORDS = ("dye", "tracker", "live", "spy", "bodipy", "phrodo", "cellrox", "cellevent", "chromalive", "emission")
VIRTUAL_STAINS = ("vs", "2d", "3d", "virtual stain")


def channel_type(name: Column | str, label_free: tuple[str, ...]) -> Column:
    return F.when(_c(name).isin(*label_free), _lit("labelfree")).otherwise(_lit("fluorescent"))


def marker_type(marker: Column | str) -> Column:
    low = F.lower(_c(marker))
    return F.when(low.isNull() | (low == ""), None).when(low.rlike("|".join(DYE_WORDS)), _lit("live_cell_dye")).when(low.isin(*VIRTUAL_STAINS), _lit("virtual_stain")).otherwise(_lit("endogenous_tag"))


def channel_metadata(name: Column, index: Column, label: Column, kind: Column) -> Column:
    """struct of a channel's name, index, type, annotation and description; the annotation is NULL for unlabeled and phase channels."""
    parts = split_label_strict(label)
    organelle, marker = parts.getField("organelle"), parts.getField("marker")
    annotated = label.isNotNull() & (label != "") & ~F.lower(label).isin("no label", "phase")
    start = F.when(kind == "fluorescent", F.concat(_lit("Max projected "), organelle)).otherwise(F.concat(F.upper(F.substring(organelle, 1, 1)), F.lower(F.substring(organelle, 2, 1 << 30))))
    description = F.when(annotated & (organelle != ""), F.when(F.coalesce(marker, _lit("")) != "", F.concat(start, _lit(" visualized via "), marker)).otherwise(start))
    note = F.when(annotated, F.struct(organelle.alias("organelle"), marker.alias("marker"), marker_type(marker).alias("marker_type"), label.alias("full_label")))
    return F.struct(name.alias("name"), index.alias("index"), kind.alias("channel_type"), note.alias("biological_annotation"), description.alias("description"))


def fuzzy(text: Column | str) -> Column:
    """Underscores and hyphens as spaces, lower case."""
    return F.lower(F.translate(_c(text), "_-", "  "))


def collapsed(text: Column | str) -> Column:
    """Without underscores, hyphens and spaces, lower case."""
    return F.lower(F.translate(_c(text), "_- ", ""))


def parse_list(text: Column | str) -> Column:
    """array<string> of a list written as ['A', 'B']; blank or malformed text gives an empty array."""
    return F.coalesce(F.from_json(F.translate(_c(text), "'", '"'), "array<string>"), F.array().cast("array<string>"))


def parse_pipes(text: Column | str) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(_c(text), r"\|"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def parse_sources(text: Column | str, known: tuple[str, ...]) -> Column:
    """Comma list checked against the known names, in order and without repeats; an unknown name raises an error."""
    names = F.array_distinct(F.filter(F.transform(F.split(F.lower(_c(text)), ","), lambda x: F.trim(x)), lambda x: x != ""))
    odd = F.array_except(names, F.array(*map(_lit, known)))
    return F.when(F.size(odd) > 0, F.raise_error(F.concat(_lit("unknown sources: "), F.array_join(odd, ", "))).cast("array<string>")).otherwise(names)


def step_key(*parts: Column) -> Column:
    """Parts that are there, joined by underscores."""
    return F.concat_ws("_", *parts)


def safe_key(text: Column | str) -> Column:
    """Cache key as a file name: ``/`` becomes two underscores, colon and space one."""
    return F.translate(F.replace(_c(text), _lit("/"), _lit("__")), ": ", "__")


def rerun_path(path: Column | str, mode: Column) -> Column:
    """Output folder of a mode: anything but production goes to ``/rerun``, once."""
    return F.when(mode.eqNullSafe("production") | _c(path).endswith("/rerun"), _c(path)).otherwise(F.concat(F.rtrim(_c(path), _lit("/")), _lit("/rerun")))


# Controls: four definitions that the callers keep apart.


def is_control_exact(name: Column | str) -> Column:
    return F.coalesce(_c(name) == "NTC", _lit(False))


def is_control_prefix(name: Column | str) -> Column:
    return F.coalesce(F.upper(_c(name)).startswith("NTC") | F.lower(_c(name)).contains("non-targeting"), _lit(False))


def is_control_anywhere(name: Column | str) -> Column:
    return F.coalesce(_c(name).rlike("(?i)NTC|non-targeting"), _lit(False))


def control_reason(gene_id: Column, ncbi_id: Column, name: Column) -> Column:
    """Which rule of the cascade makes a row a control, or NULL."""
    blank = name.isNull() | F.trim(name).isin("", "None")
    return F.when(gene_id == -1, "gene_id").when(ncbi_id == -1, "ncbi_id").when(blank, "blank").when(name.rlike("(?i)ntc|non-targeting|^0$"), "name")
