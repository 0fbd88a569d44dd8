"""Catalogues of experiments: exclusion rules, channel labels, steps, completeness, signal groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import names as N
from heddle.operators.spatial import numbered


def excluded(experiments: DataFrame, rules: DataFrame, categories: list[str], cutoff: str | None = None, name: str = "name") -> DataFrame:
    """Flag ``excluded``: dated before the cut-off (as text), or named or numbered by a rule of the categories.

    The rules are a configuration table; names and numbers are two semi-joins on keys, never an OR join.
    """
    used = rules.where(F.col("category").isin(*categories))
    by_name = used.where("name IS NOT NULL").select(F.col("name").alias("_n")).distinct().withColumn("_hit_name", F.lit(True))
    by_number = used.where("number IS NOT NULL").select(F.col("number").alias("_k")).distinct().withColumn("_hit_number", F.lit(True))
    keyed = experiments.withColumn("_num", N.experiment_number(N.experiment_key(name))).withColumn("_day", N.experiment_date(name))
    out = keyed.join(by_name, F.col(name) == F.col("_n"), "left").join(by_number, F.col("_num") == F.col("_k"), "left")
    old = F.lit(False) if cutoff is None else F.coalesce(F.col("_day") < cutoff, F.lit(False))
    return out.select(*experiments.columns, (old | F.coalesce("_hit_name", F.lit(False)) | F.coalesce("_hit_number", F.lit(False))).alias("excluded"))


def exclusion_reasons(experiments: DataFrame, rules: DataFrame, cutoff: str | None = None, name: str = "name") -> DataFrame:
    """``experiments`` with ``reason``: of the first rule (by ``ordinal``) that has the experiment's name or its number, or else that it is before the cut-off date; NULL without either, or if that rule gives none.

    The first rule is found per name and per number before the experiments are joined, so a rule that is given very often costs one row.
    """
    first = lambda key, by: rules.where(f"{key} IS NOT NULL").groupBy(F.col(key).alias(by)).agg(F.min(F.struct("ordinal", "reason")).alias(f"{by}_r"))
    keyed = experiments.withColumn("_num", N.experiment_number(N.experiment_key(name))).withColumn("_day", N.experiment_date(name))
    out = keyed.join(first("name", "_n"), F.col(name) == F.col("_n"), "left").join(first("number", "_k"), F.col("_num") == F.col("_k"), "left")
    ruled = F.least("_n_r", "_k_r")  # the earlier of both; NULL is left out
    late = F.lit(None).cast("string") if cutoff is None else F.when(F.col("_day") < cutoff, F.lit(f"before date cutoff ({cutoff})"))
    return out.select(*experiments.columns, F.when(ruled.isNotNull(), ruled["reason"]).otherwise(late).alias("reason"))


#: Tags of the kinds of imaging, and the flags of a channel map that stand for them.
BASE_DESIGN, DESIGN_FLAGS, LIBRARY_DESIGN = "livecell_OPS", {"cell_painting": "Cell_Painting", "four_i": "4i"}, ("merfish", "MERFISH")


def design_tags(experiments: DataFrame, flags: DataFrame, codebooks: DataFrame, name: str = "name") -> DataFrame:
    """``experiments`` with ``design``: the base tag, one for each flag that is enabled in the experiment's channel map (in the order in which the map names them), and one if its codebook's name says so.

    ``flags`` (experiment, pos, flag, enabled) and ``codebooks`` (experiment, codebook) go by the experiment's short key.
    """
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in DESIGN_FLAGS.items() for x in kv]), F.col("flag"))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(DESIGN_FLAGS) for x in (k, i)])
    on = flags.where("enabled").select(F.col("experiment").alias("_exp"), tag.alias("t"), F.struct("pos", F.element_at(order, F.col("flag")).alias("k")).alias("at")).where("t IS NOT NULL")
    on = on.groupBy("_exp", "t").agg(F.min("at").alias("at")).groupBy("_exp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]).alias("_on"))
    word, more = LIBRARY_DESIGN
    books = codebooks.groupBy(F.col("experiment").alias("_exp2")).agg(F.bool_or(F.lower("codebook").contains(word)).alias("_book"))
    keyed = experiments.withColumn("_key", F.coalesce(N.experiment_key(name), F.col(name)))
    out = keyed.join(on, F.col("_key") == F.col("_exp"), "left").join(books, F.col("_key") == F.col("_exp2"), "left")
    empty = F.array().cast("array<string>")
    design = F.concat(F.array(F.lit(BASE_DESIGN)), F.coalesce("_on", empty), F.when(F.coalesce("_book", F.lit(False)), F.array(F.lit(more))).otherwise(empty))
    return out.select(*experiments.columns, design.alias("design"))


def bad_channels(channels: DataFrame, rules: DataFrame, words: tuple[str, ...] = ("no label", "bleedthrough", "autofluorescence")) -> DataFrame:
    """Flag ``bad`` of (experiment, channel, label): the label holds a word, or a rule names the experiment (or its number) and channel."""
    low = F.lower(F.col("channel"))
    keyed = channels.withColumn("_key", N.experiment_short("experiment")).withColumn("_num", N.experiment_number(N.experiment_key("experiment"))).withColumn("_ch", low)
    a = rules.where("name IS NOT NULL").select(F.lower("name").alias("_key2"), F.lower("channel").alias("_ch2")).distinct().withColumn("_a", F.lit(True))
    b = rules.where("number IS NOT NULL").select(F.col("number").alias("_num2"), F.lower("channel").alias("_ch3")).distinct().withColumn("_b", F.lit(True))
    out = keyed.join(a, (F.lower("_key") == F.col("_key2")) & (F.col("_ch") == F.col("_ch2")), "left").join(b, (F.col("_num") == F.col("_num2")) & (F.col("_ch") == F.col("_ch3")), "left")
    worded = F.coalesce(F.lower("label").rlike("|".join(words)), F.lit(False))
    return out.select(*channels.columns, (worded | F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))).alias("bad"))


def keep_libraries(experiments: DataFrame, other: DataFrame, forced: DataFrame, name: str = "name") -> DataFrame:
    """Experiments of the default library, and those forced in."""
    return experiments.join(other.select(name).distinct().join(forced.select(name).distinct(), name, "left_anti"), name, "left_anti")


def resolve_names(queries: DataFrame, known: DataFrame, query: str = "query", name: str = "name") -> DataFrame:
    """Full name of each query by the first rule that finds one: exact, number, prefix, substring; the query itself otherwise. Several hits of a rule: the first in order.

    Each rule is a join by key. A name that contains a query also holds its first three characters (or all of a shorter one),
    so names are listed under their runs of up to three characters and only those of the query's run are compared.
    """
    asked = queries.select(F.col(query).alias("_q")).distinct()
    k = known.select(F.col(name).alias("_name")).where("_name IS NOT NULL").distinct()
    exact = asked.join(k, F.col("_q") == F.col("_name")).select("_q", F.lit(0).alias("_r"), "_name")
    number = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    numbered = k.select(number(F.col("_name"), r"^ops0*(\d+)(?:_|$)").alias("_n"), "_name").where("_n IS NOT NULL").groupBy("_n").agg(F.min("_name").alias("_name"))
    by_number = asked.withColumn("_n", number(F.lower("_q"), r"^(?:ops)?0*(\d+)$")).join(numbered, "_n").select("_q", F.lit(1).alias("_r"), "_name")
    size = F.length("_name")
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col("_name"), i, n)))))
    listed = k.where(size > 0).select("_name", F.explode(runs).alias("_g"))
    some = asked.where("_q <> ''").withColumn("_g", F.left("_q", F.lit(3))).join(listed, "_g").where(F.col("_name").contains(F.col("_q")))
    inside = some.select("_q", F.when(F.col("_name").startswith(F.col("_q")), 2).otherwise(3).alias("_r"), "_name")
    empty = asked.join(k.agg(F.min("_name").alias("_name")).withColumn("_q", F.lit("")), "_q").where("_name IS NOT NULL").select("_q", F.lit(2).alias("_r"), "_name")
    best = exact.union(by_number).union(inside).union(empty).groupBy("_q").agg(F.min_by("_name", F.struct("_r", "_name")).alias("_found"))
    return asked.join(best, "_q", "left").select(F.col("_q").alias(query), F.coalesce("_found", "_q").alias("resolved"))


def channel_index_map(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Source index of each destination channel by canonical name, first duplicate wins, NULL if absent. If no name matches at all and the counts agree, by position; otherwise an error.

    Both tables are (store, idx, channel); all stores are mapped at once.
    """
    src = source.withColumn("_k", N.canonical_channel("channel")).where("_k <> ''").groupBy("store", "_k").agg(F.min("idx").alias("source_idx"))
    n_src = source.groupBy("store").agg(F.count("*").alias("_ns"))
    out = dest.withColumn("_k", N.canonical_channel("channel")).join(src, ["store", "_k"], "left").join(n_src, "store", "left")
    w = Window.partitionBy("store")
    none, n = F.count("source_idx").over(w) == 0, F.count("*").over(w)
    wrong = F.raise_error(F.concat(F.lit("no channel names match and counts differ in "), F.col("store").cast("string"))).cast("int")
    return out.select("store", "idx", "channel", F.when(none, F.when(F.col("_ns") == n, F.col("idx")).otherwise(wrong)).otherwise(F.col("source_idx")).alias("source_idx"))


#: Labels of names that no rule finds.
FIXED_LABELS = {"ChromaLive_488_emission": "ChromaLIVE 488 excitation", "ChromaLive488emission": "ChromaLIVE 488 excitation", "FastAct": "actin filament, FastAct_SPY555 Live Cell Dye", "unlabeled": "no label"}


def resolve_labels(files: DataFrame, channel_map: DataFrame, siblings: dict[str, str] | None = None) -> DataFrame:
    """Label of each (experiment, channel) by an ordered ladder: direct name, own spelling in the name, six kinds of reverse match per map entry in map order, fixed names, unmapped.

    Adds label, short, yaml_channel, method. The ladder is a rank: candidates join on the experiment only (a
    map has a handful of entries each) and the smallest (entry, kind) wins.
    """
    siblings = siblings or {}
    tag, rest = F.lit(None).cast("string"), F.col("channel")
    suffix = F.lit("")
    for t, s in siblings.items():
        tag, rest, suffix = F.when(F.col("channel").startswith(t), F.lit(t)).otherwise(tag), F.when(F.col("channel").startswith(t), F.substring("channel", len(t) + 1, 1 << 30)).otherwise(rest), F.when(F.col("channel").startswith(t), F.lit(s)).otherwise(suffix)
    base = files.select("experiment", "channel").distinct().withColumn("_tag", tag).withColumn("_sfx", suffix).withColumn("_rest", rest)
    base = base.withColumn("_c", F.when(F.col("_rest").isin("Phase2D", "Phase3D"), F.lit("Phase")).otherwise(F.col("_rest"))).withColumn("_exp", N.experiment_short("experiment"))
    entries = channel_map.where("channel_name IS NOT NULL").select(F.col("experiment").alias("_exp"), F.col("pos").alias("_pos"), F.col("channel_name").alias("_name"), F.col("label").alias("_label"))
    c = base.join(entries, "_exp", "left")
    marker = F.when(F.col("_label").contains(","), F.trim(F.get(F.split("_label", ",", 2), F.lit(1))))
    kinds = [(F.col("_name") == N.normalize_channel("_c"), 0, "direct"), (marker == F.col("_c"), 1, "reverse_marker"), (F.col("_label") == F.col("_c"), 2, "reverse_label"), (N.fuzzy(marker) == N.fuzzy("_c"), 3, "reverse_marker_fuzzy"), (N.fuzzy("_label") == N.fuzzy("_c"), 4, "reverse_label_fuzzy"), (N.collapsed(marker) == N.collapsed("_c"), 5, "reverse_marker_collapsed"), (N.collapsed("_label") == N.collapsed("_c"), 6, "reverse_label_collapsed")]
    kind = F.coalesce(*[F.when(k, F.lit(i)) for k, i, _ in kinds])
    # direct matches come first whatever the entry, then the entries in order with their kinds
    order = F.when(kind == 0, F.struct(F.lit(0).alias("a"), F.col("_pos").alias("p"), F.lit(0).alias("k"))).when(kind > 0, F.struct(F.lit(2).alias("a"), F.col("_pos").alias("p"), kind.alias("k")))
    best = c.withColumn("_o", order).groupBy("experiment", "channel", "_tag", "_sfx", "_c").agg(F.min("_o").alias("_o"), F.min_by(F.struct("_name", "_label"), F.col("_o")).alias("_e"))
    own, fixed = N.derived_label("_c"), F.element_at(F.create_map(*[F.lit(x) for kv in FIXED_LABELS.items() for x in kv]), F.col("_c"))
    silent = (F.col("_o.a") == 0) & (F.col("_e._label") == "no label")
    direct, back = F.col("_o.a") == 0, F.col("_o.a") == 2
    method = F.when(silent, "direct_autofluorescence").when(direct | own.isNotNull(), "direct").when(back, F.element_at(F.array(*[F.lit(n) for _, _, n in kinds]), F.col("_o.k") + 1)).when(fixed.isNotNull(), "hardcoded").otherwise("unresolved")
    auto = F.concat(F.lit("autofluorescence"), F.lit(", "), F.lower("_c"))
    label = F.when(silent, auto).when(direct, F.col("_e._label")).when(own.isNotNull(), own).when(back, F.col("_e._label")).when(fixed.isNotNull(), fixed).otherwise(F.concat(F.lit("(unmapped: "), F.col("_c"), F.lit(")")))
    back_short = F.when(F.col("_o.k").isin(1, 3, 5), F.trim(F.get(F.split("_e._label", ",", 2), F.lit(1)))).otherwise(F.col("_e._label"))
    short = F.when(silent, F.concat(F.lit("autofluorescence_"), F.lower("_c"))).when(direct, N.short_label(F.col("_e._label"), F.col("_c"))).when(own.isNotNull(), N.short_label(own, F.col("_c"))).when(back, back_short).when(fixed.isNotNull(), fixed).otherwise(F.col("_c"))
    yaml_channel = F.when(~direct & own.isNull() & back, F.col("_e._name")).otherwise(F.col("_c"))
    plus = F.when(F.col("_tag").isNotNull(), F.concat(F.lit("+"), F.rtrim(F.col("_tag"), F.lit(":")))).otherwise(F.lit(""))
    return best.select("experiment", "channel", F.when(label.endswith(F.col("_sfx")), label).otherwise(F.concat(label, "_sfx")).alias("label"), short.alias("short"), F.concat(F.coalesce("_tag", F.lit("")), yaml_channel).alias("yaml_channel"), F.concat(method, plus).alias("method"))


def rename_features(features: DataFrame, channel_map: DataFrame) -> DataFrame:
    """New name of each (experiment, feature): the channel in ``single_object_CHANNEL_`` and ``coloc_C1_C2_`` becomes its label; the first match in map order wins, others stay."""
    entries = channel_map.where("channel_name IS NOT NULL").select(F.col("experiment").alias("_exp"), "pos", "channel_name", N.sanitize_label(N.short_label("label", "channel_name")).alias("_new"))
    plain = F.replace(F.col("channel_name"), F.lit(" "), F.lit("_"))
    spelled = entries.select("_exp", "pos", "_new", F.posexplode(F.when(F.col("channel_name") == "BF", F.array(F.lit("BF"), F.lit("Phase2D"), F.lit("Phase3D"), F.lit("Phase"))).otherwise(F.array(plain))).alias("alias_no", "alias"))
    one = spelled.select("_exp", F.lit("single_object_").alias("_head"), F.struct(F.col("pos").alias("a"), F.lit(0).alias("b"), F.col("alias_no").alias("c"), F.lit(0).alias("d")).alias("_o"), F.concat(F.lit("single_object_"), "alias", F.lit("_")).alias("_from"), F.concat(F.lit("single_object_"), "_new", F.lit("_")).alias("_to"))
    r = spelled.select("_exp", *[F.col(c).alias(f"r_{c}") for c in ("pos", "_new", "alias_no", "alias")])
    two = spelled.join(r, "_exp").select("_exp", F.lit("coloc_").alias("_head"), F.struct(F.col("pos").alias("a"), F.col("r_pos").alias("b"), F.col("alias_no").alias("c"), F.col("r_alias_no").alias("d")).alias("_o"), F.concat(F.lit("coloc_"), "alias", F.lit("_"), "r_alias", F.lit("_")).alias("_from"), F.concat(F.lit("coloc_"), "_new", F.lit("_"), "r__new", F.lit("_")).alias("_to"))
    patterns = one.union(two)
    keyed = features.select("experiment", "feature").distinct().withColumn("_exp", N.experiment_short("experiment")).withColumn("_head", F.when(F.col("feature").startswith("single_object_"), "single_object_").when(F.col("feature").startswith("coloc_"), "coloc_"))
    hit = keyed.join(patterns, ["_exp", "_head"], "left").withColumn("_ok", F.when(F.col("feature").contains(F.col("_from")), F.col("_o")))
    best = hit.groupBy("experiment", "feature").agg(F.min_by(F.struct("_from", "_to"), F.col("_ok")).alias("_m"))
    return best.select("experiment", "feature", F.coalesce(F.replace(F.col("feature"), F.col("_m._from"), F.col("_m._to")), "feature").alias("renamed"))


def find_channels(channel_map: DataFrame, marker: str | None = None, organelle: str | None = None) -> DataFrame:
    """(experiment, channel_name, label) with a marker (case matters) or an organelle (it does not)."""
    parts = N.split_label("label")
    rows = channel_map.where("channel_name IS NOT NULL")
    if marker is not None:
        rows = rows.where(parts.getField("marker") == marker)
    if organelle is not None:
        rows = rows.where(F.lower(parts.getField("organelle")) == organelle.lower())
    return rows.select("experiment", "channel_name", "label")


def dictionary_lookup(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Match of a name with either side of a dictionary (k, v); a key match is preferred. Two key joins, no OR join."""
    low = F.lower(F.trim(F.col(key)))
    k = pairs.select(F.lower(F.trim("k")).alias("_a"), F.col("v").alias("_v1")).groupBy("_a").agg(F.min("_v1").alias("_v1"))
    v = pairs.select(F.lower(F.trim("v")).alias("_b"), F.col("k").alias("_v2")).groupBy("_b").agg(F.min("_v2").alias("_v2"))
    return rows.join(k, low == F.col("_a"), "left").join(v, low == F.col("_b"), "left").select(*rows.columns, F.coalesce("_v1", "_v2").alias("matched"))


def step_states(steps: DataFrame, outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Missing outputs of what each step depends on: (step, n_missing, ready). ``outputs`` (step, path) leaves out steps that can't be checked; those never block."""
    deps = steps.select("step", F.explode_outer("deps").alias("dep"))
    missing = outputs.join(files.select("path").distinct(), "path", "left_anti").groupBy("step").agg(F.count("*").alias("n")).withColumnRenamed("step", "dep")
    out = deps.join(missing, "dep", "left").groupBy("step").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_missing"))
    return out.withColumn("ready", F.col("n_missing") == 0)


def progress(expected: DataFrame, files: DataFrame, name: str = "experiment") -> DataFrame:
    """Existing and expected outputs of each experiment, in order of its number: done, partial or open."""
    found = expected.join(files.select("path").distinct().withColumn("_x", F.lit(1)), "path", "left")
    out = found.groupBy(name).agg(F.count("_x").alias("n_existing"), F.count("*").alias("n_expected"))
    state = F.when(F.col("n_existing") == F.col("n_expected"), "completed").when(F.col("n_existing") > 0, "partial").otherwise("to_process")
    return out.select(name, "n_existing", "n_expected", state.alias("state"), F.coalesce(N.experiment_number(N.experiment_key(name)), F.lit(9999)).alias("order_no"))


def embedding_status(experiments: DataFrame, configured: DataFrame, embeddings: DataFrame, aggregates: DataFrame, files: DataFrame) -> DataFrame:
    """fully, embeddings_only, none or no_config: all expected files of a kind must be there; a kind without expected files counts as there."""
    have = files.select("path").distinct().withColumn("_x", F.lit(True))
    every = lambda e, n: e.join(have, "path", "left").groupBy("experiment").agg(F.bool_and(F.coalesce("_x", F.lit(False))).alias(n))
    out = experiments.join(configured.select("experiment").distinct().withColumn("_c", F.lit(True)), "experiment", "left").join(every(embeddings, "_e"), "experiment", "left").join(every(aggregates, "_g"), "experiment", "left")
    e, g = F.coalesce("_e", F.lit(True)), F.coalesce("_g", F.lit(True))
    return out.select("experiment", F.when(F.col("_c").isNull(), "no_config").when(e & g, "fully").when(e, "embeddings_only").otherwise("none").alias("status"))


def signal_groups(channels: DataFrame, check: bool = True) -> DataFrame:
    """Experiments of each signal (experiment, signal, n_rows); unknown and unmapped signals are skipped. The same pair twice is an error."""
    used = channels.where(~F.col("signal").rlike(r"^\(unmapped|^unknown$"))
    one = used.groupBy("signal", "experiment").agg(F.count("*").alias("_n"), F.sum("n_rows").alias("n_rows"))
    if check:
        one = one.withColumn("experiment", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("twice: "), "signal", F.lit(" "), "experiment")).cast("string")).otherwise(F.col("experiment")))
    return one.groupBy("signal").agg(F.array_join(F.sort_array(F.collect_list("experiment")), ",").alias("experiments"), F.count("*").alias("n_experiments"), F.sum("n_rows").alias("n_rows"))


def first_location(found: DataFrame, key: str, ordinal: str) -> DataFrame:
    """First row of each key by storage order."""
    return found.groupBy(key).agg(F.min_by(F.struct(*found.columns), ordinal).alias("_r")).select("_r.*")


def job_status(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """State of each wanted job, PENDING if it is not listed; states that begin with CANCELLED are one."""
    state = F.coalesce(F.when(F.col("state").startswith("CANCELLED"), "CANCELLED").otherwise(F.col("state")), F.lit("PENDING"))
    return wanted.join(jobs, "job_id", "left").select("job_id", state.alias("state"))


def status_counts(status: DataFrame) -> DataFrame:
    """Running, pending, completed and failed jobs, and whether nothing is left to wait for."""
    s = F.col("state")
    out = status.agg(F.count_if(s == "RUNNING").alias("running"), F.count_if(s == "PENDING").alias("pending"), F.count_if(s == "COMPLETED").alias("completed"), F.count_if(~s.isin("RUNNING", "PENDING", "COMPLETED")).alias("failed"))
    return out.withColumn("done", (F.col("running") + F.col("pending")) == 0)


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when(done > 0, elapsed / done * (total - done))


def grid_cells(rows: DataFrame, order: list[str], n_rows: int) -> DataFrame:
    """``row`` and ``col`` of each row in a grid filled column by column, in the given order."""
    k = numbered(rows, order, "_k").withColumn("_k", F.col("_k") - 1)
    return k.withColumn("row", (F.col("_k") % n_rows).cast("int")).withColumn("col", F.floor(F.col("_k") / n_rows).cast("int")).drop("_k")
