"""Queries of names, annotation, validation, catalogues, geometry and job accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import attributes as X
from heddle.functions import boxes as B
from heddle.functions import names as N
from heddle.functions import units as U
from heddle.operators import annotate as A
from heddle.operators import catalog as C
from heddle.operators import jobs as J
from heddle.operators import spatial as G
from heddle.operators import summary as S
from heddle.operators import validate as V
from heddle.operators import validate_pass as VP
from heddle.plans.inputs import cte, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# names ---------------------------------------------------------------------------------------------


@query(cte("experiments") + r"SELECT name, nullif(lower(regexp_extract(name, '(?i)(ops\d{4})', 1)), '') AS key, try_cast(nullif(regexp_extract(lower(regexp_extract(name, '(?i)(ops\d{4})', 1)), '^ops0*(\d+)', 1), '') AS INT) AS number, nullif(regexp_extract(name, '(?i)^ops\d{4}_(\d{8})$', 1), '') AS day, regexp_matches(name, '^ops\d{4}_\d{8}$') AS strict, regexp_matches(name, '^ops\d{4}_\d{8}(_.+)?$') AS suffixed FROM experiments")
def experiment_key(spark, sf_dir):
    e = read(spark, sf_dir, "experiments")
    return e.select("name", N.experiment_key("name").alias("key"), N.experiment_number(N.experiment_key("name")).alias("number"), N.experiment_date("name").alias("day"), N.is_experiment("name").alias("strict"), N.is_experiment("name", True).alias("suffixed"))


@query(r"""WITH w AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN (c_custkey % 12)::VARCHAR WHEN 1 THEN concat(' b', c_custkey % 12) WHEN 2 THEN 'a/3/1' WHEN 3 THEN concat('AA', c_custkey % 9) ELSE 'x-y' END AS well FROM customer), u AS (SELECT *, upper(trim(well)) AS t FROM w)
    SELECT c_custkey, CASE WHEN contains(t, '/') THEN t WHEN regexp_matches(t, '^\d+$') THEN concat('A/', t) WHEN regexp_matches(t, '^[A-Z]+\d+$') THEN concat(regexp_extract(t, '^([A-Z]+)', 1), '/', regexp_extract(t, '(\d+)$', 1)) ELSE t END AS well,
    CASE WHEN contains(well, '/') THEN concat(split_part(well, '/', 1), split_part(well, '/', 2), '-') ELSE well END AS prefix FROM u""")
def well_canonical(spark, sf_dir):
    k = F.col("c_custkey")
    well = F.when(k % 5 == 0, (k % 12).cast("string")).when(k % 5 == 1, F.concat(F.lit(" b"), k % 12)).when(k % 5 == 2, F.lit("a/3/1")).when(k % 5 == 3, F.concat(F.lit("AA"), k % 9)).otherwise(F.lit("x-y"))
    return _table(spark, sf_dir, "customer").select("c_custkey", well.alias("w")).select("c_custkey", N.canonical_well("w").alias("well"), N.well_prefix("w").alias("prefix"))


@query("SELECT c_custkey, concat('A/', c_custkey % 9 + 1, '/', c_custkey % 4) AS path, concat('A/', c_custkey % 9 + 1) AS well FROM customer")
def position_path(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("A"), F.col("c_custkey") % 9 + 1, F.lit("-Site_"), F.col("c_custkey") % 4).alias("p"))
    return c.select("c_custkey", N.position_path("p").alias("path"), N.well_group(N.position_path("p")).alias("well"))


_SAN = "replace(CASE WHEN contains(translate(label, '/\\', '__'), ',') THEN trim(substr(translate(label, '/\\', '__'), strpos(translate(label, '/\\', '__'), ',') + 1)) ELSE translate(label, '/\\', '__') END, ' ', '_')"
_MANY = "label LIKE '%,%' AND label <> 'Phase' AND label <> 'no label'"
_MARK = f"CASE WHEN {_MANY} THEN trim(substr(label, strpos(label, ',') + 1)) END"
_ORG = f"CASE WHEN label IS NULL OR label = 'no label' THEN 'unlabeled' WHEN {_MANY} THEN trim(split_part(label, ',', 1)) ELSE label END"


@query(cte("labels_text") + f"SELECT id, {_SAN} AS clean FROM labels_text")
def label_sanitize(spark, sf_dir):
    return read(spark, sf_dir, "labels_text").select("id", N.sanitize_label("label").alias("clean"))


@query(cte("labels_text") + f"""SELECT id, {_ORG} AS organelle, {_MARK} AS marker, coalesce(nullif({_MARK}, ''), CASE WHEN {_ORG} = 'unlabeled' THEN concat('unlabeled_', channel) END, {_ORG}) AS short,
    CASE WHEN channel LIKE 'CP1%' THEN concat(split_part(channel, '_', 2), ', ', split_part(channel, '_', 3)) WHEN channel LIKE '4i%' THEN split_part(channel, '_', 3) END AS derived FROM labels_text""")
def label_parse(spark, sf_dir):
    t = read(spark, sf_dir, "labels_text")
    return t.select("id", N.split_label("label").getField("organelle").alias("organelle"), N.split_label("label").getField("marker").alias("marker"), N.short_label("label", "channel").alias("short"), N.derived_label("channel").alias("derived"))


@query(cte("labels_text") + "SELECT id, replace(replace(replace(replace(replace(label, ' ', '_'), ',', ''), '(', ''), ')', ''), '/', '-') AS file FROM (SELECT id, concat('(', label, ')') AS label FROM labels_text)")
def signal_files(spark, sf_dir):
    t = read(spark, sf_dir, "labels_text").select("id", F.concat(F.lit("("), F.coalesce("label", F.lit("")), F.lit(")")).alias("label"))
    return t.select("id", N.signal_file("label").alias("file"))


@query(cte("labels_text") + f"""SELECT id, CASE WHEN channel LIKE 'Phase%' THEN 'BF' ELSE channel END AS normal, CASE lower(channel) WHEN 'gfp' THEN 'GFP' WHEN 'm-cherry' THEN 'mCherry' ELSE channel END AS canonical, CASE WHEN channel IN ('Phase2D', 'BF') THEN 'labelfree' ELSE 'fluorescent' END AS kind,
    CASE WHEN {_MARK} IS NULL OR {_MARK} = '' THEN NULL WHEN regexp_matches(lower({_MARK}), 'dye|tracker|live|spy|bodipy|phrodo|cellrox|cellevent|chromalive|emission') THEN 'live_cell_dye' ELSE 'endogenous_tag' END AS marker_type FROM labels_text""")
def channel_names(spark, sf_dir):
    t = read(spark, sf_dir, "labels_text")
    return t.select("id", N.normalize_channel("channel").alias("normal"), N.canonical_channel("channel").alias("canonical"), N.channel_type("channel", ("Phase2D", "BF")).alias("kind"), N.marker_type(N.split_label("label").getField("marker")).alias("marker_type"))


@query(cte("labels_text") + """, p AS (SELECT *, CASE WHEN contains(label, ', ') THEN trim(substr(label, 1, strpos(label, ', ') - 1)) ELSE trim(label) END AS o, CASE WHEN contains(label, ', ') THEN trim(substr(label, strpos(label, ', ') + 2)) END AS m, label IS NOT NULL AND lower(label) NOT IN ('no label', 'phase', '') AS ok FROM labels_text)
    SELECT id, CASE WHEN ok THEN o END AS organelle, CASE WHEN ok THEN m END AS marker, CASE WHEN ok AND o <> '' THEN CASE WHEN coalesce(m, '') <> '' THEN concat('Max projected ', o, ' visualized via ', m) ELSE concat('Max projected ', o) END END AS description FROM p""")
def channel_metadata(spark, sf_dir):
    t = read(spark, sf_dir, "labels_text")
    m = N.channel_metadata(F.col("channel"), F.col("id"), F.col("label"), F.lit("fluorescent"))
    return t.select("id", m.alias("m")).select("id", F.col("m.biological_annotation.organelle").alias("organelle"), F.col("m.biological_annotation.marker").alias("marker"), F.col("m.description").alias("description"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN concat(p_name, '|', p_brand) ELSE p_type END AS items, concat(p_type, '|', trim(p_name)) AS piped FROM part""")
def list_text(spark, sf_dir):
    p, k = _table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_brand", F.lit("']"))).otherwise(F.concat(F.lit("['"), "p_type", F.lit("']")))
    return p.select("p_partkey", text.alias("t"), F.concat("p_type", F.lit(" | |"), "p_name").alias("q")).select("p_partkey", F.array_join(N.parse_list("t"), "|").alias("items"), F.array_join(N.parse_pipes("q"), "|").alias("piped"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'corum,string' WHEN 1 THEN 'string' WHEN 2 THEN '' ELSE 'go,corum' END AS sources FROM part")
def source_lists(spark, sf_dir):
    """Comma lists against the known names: any case, blanks and repeats."""
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, " Corum, STRING,corum").when(k == 1, "string").when(k == 2, " ,").otherwise("go,, corum ")
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(N.parse_sources(text, ("corum", "string", "go")), ",").alias("sources"))


@query(cte("channel_map", "features") + r""", e AS (SELECT experiment AS k, pos, channel_name, replace(CASE WHEN label LIKE '%,%' THEN trim(substr(label, strpos(label, ',') + 1)) ELSE label END, ' ', '_') AS new FROM channel_map WHERE channel_name IS NOT NULL),
    al AS (SELECT k, pos, new, unnest(CASE WHEN channel_name = 'BF' THEN ['BF', 'Phase2D', 'Phase3D', 'Phase'] ELSE [replace(channel_name, ' ', '_')] END) AS alias, unnest(CASE WHEN channel_name = 'BF' THEN [0, 1, 2, 3] ELSE [0] END) AS no FROM e),
    pat AS (SELECT k, 'single_object_' AS head, pos AS a, 0 AS b, no AS c, 0 AS d, concat('single_object_', alias, '_') AS f, concat('single_object_', new, '_') AS t FROM al UNION ALL SELECT x.k, 'coloc_', x.pos, y.pos, x.no, y.no, concat('coloc_', x.alias, '_', y.alias, '_'), concat('coloc_', x.new, '_', y.new, '_') FROM al x JOIN al y ON x.k = y.k),
    m AS (SELECT i.experiment, i.feature, f, t, row_number() OVER (PARTITION BY i.experiment, i.feature ORDER BY a, b, c, d) AS rn FROM features i JOIN pat ON pat.k = left(i.experiment, 7) AND starts_with(i.feature, head) AND contains(i.feature, f))
    SELECT i.experiment, i.feature, coalesce(replace(i.feature, f, t), i.feature) AS renamed FROM features i LEFT JOIN m ON m.experiment = i.experiment AND m.feature = i.feature AND rn = 1""")
def feature_rename(spark, sf_dir):
    return C.rename_features(read(spark, sf_dir, "features"), read(spark, sf_dir, "channel_map"))


_LADDER_FILES = "SELECT DISTINCT experiment, unnest([channel_name, replace(trim(substr(label, strpos(label, ',') + 1)), ' ', '_'), upper(label), 'Phase2D', 'CP1_er_COPE', 'FastAct', 'zzz']) AS channel FROM channel_map WHERE channel_name IS NOT NULL"


@query(cte("channel_map") + f""", files AS ({_LADDER_FILES}), c AS (SELECT *, CASE WHEN channel IN ('Phase2D', 'Phase3D') THEN 'Phase' ELSE channel END AS ch FROM files),
    e AS (SELECT experiment, pos, channel_name, label, CASE WHEN label LIKE '%,%' THEN trim(substr(label, strpos(label, ',') + 1)) END AS marker FROM channel_map WHERE channel_name IS NOT NULL),
    j AS (SELECT c.experiment, c.channel, ch, pos, channel_name, label, marker, CASE WHEN channel_name = CASE WHEN ch LIKE 'Phase%' THEN 'BF' ELSE ch END THEN 0 WHEN marker = ch THEN 1 WHEN label = ch THEN 2 WHEN lower(translate(marker, '_-', '  ')) = lower(translate(ch, '_-', '  ')) THEN 3 WHEN lower(translate(label, '_-', '  ')) = lower(translate(ch, '_-', '  ')) THEN 4 WHEN lower(translate(marker, '_- ', '')) = lower(translate(ch, '_- ', '')) THEN 5 WHEN lower(translate(label, '_- ', '')) = lower(translate(ch, '_- ', '')) THEN 6 END AS kind FROM c LEFT JOIN e ON e.experiment = c.experiment),
    b AS (SELECT *, row_number() OVER (PARTITION BY experiment, channel ORDER BY (kind IS NULL)::INT, (kind > 0)::INT, pos, kind) AS rn FROM j)
    SELECT experiment, channel, CASE WHEN kind = 0 THEN label WHEN ch LIKE 'CP1_%' THEN 'er, COPE' WHEN kind > 0 THEN label WHEN ch = 'FastAct' THEN 'actin filament, FastAct_SPY555 Live Cell Dye' ELSE concat('(unmapped: ', ch, ')') END AS label,
    CASE WHEN kind = 0 OR ch LIKE 'CP1_%' THEN 'direct' WHEN kind > 0 THEN ['reverse_marker', 'reverse_label', 'reverse_marker_fuzzy', 'reverse_label_fuzzy', 'reverse_marker_collapsed', 'reverse_label_collapsed'][kind] WHEN ch = 'FastAct' THEN 'hardcoded' ELSE 'unresolved' END AS method FROM b WHERE rn = 1""")
def label_ladder(spark, sf_dir):
    m = read(spark, sf_dir, "channel_map")
    second = F.replace(F.trim(F.substring_index("label", ",", -1)), F.lit(" "), F.lit("_"))
    files = m.where("channel_name IS NOT NULL").select("experiment", F.explode(F.array("channel_name", second, F.upper("label"), F.lit("Phase2D"), F.lit("CP1_er_COPE"), F.lit("FastAct"), F.lit("zzz"))).alias("channel"))
    return C.resolve_labels(files, m).select("experiment", "channel", "label", "method")


@query(cte("channel_map") + "SELECT experiment, channel_name, label FROM channel_map WHERE channel_name IS NOT NULL AND label LIKE '%,%' AND lower(trim(split_part(label, ',', 1))) = 'economy'")
def channels_by_organelle(spark, sf_dir):
    return C.find_channels(read(spark, sf_dir, "channel_map"), organelle="Economy")


@query(r"""WITH n AS (SELECT DISTINCT concat('ops', lpad((o_orderkey % 400)::VARCHAR, 4, '0'), '_2024') AS name FROM orders), q AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN concat('ops', lpad((c_custkey % 400)::VARCHAR, 4, '0'), '_2024') WHEN 1 THEN (c_custkey % 500)::VARCHAR WHEN 2 THEN concat('ops0', c_custkey % 5) ELSE '99_20' END AS query FROM customer),
    h AS (SELECT query, name, CASE WHEN name = query THEN 0 WHEN regexp_extract(name, '^ops0*(\d+)(?:_|$)', 1) = nullif(regexp_extract(lower(query), '^(?:ops)?0*(\d+)$', 1), '') THEN 1 WHEN starts_with(name, query) THEN 2 WHEN contains(name, query) THEN 3 END AS r FROM q LEFT JOIN n ON contains(name, query) OR regexp_extract(name, '^ops0*(\d+)(?:_|$)', 1) = nullif(regexp_extract(lower(query), '^(?:ops)?0*(\d+)$', 1), ''))
    SELECT query, coalesce(name, query) AS resolved FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (r IS NULL)::INT, r, name) AS rn FROM h) WHERE rn = 1""")
def name_ladder(spark, sf_dir):
    k = F.col("c_custkey")
    n = _table(spark, sf_dir, "orders").select(F.concat(F.lit("ops"), F.lpad((F.col("o_orderkey") % 400).cast("string"), 4, "0"), F.lit("_2024")).alias("name"))
    q = F.when(k % 4 == 0, F.concat(F.lit("ops"), F.lpad((k % 400).cast("string"), 4, "0"), F.lit("_2024"))).when(k % 4 == 1, (k % 500).cast("string")).when(k % 4 == 2, F.concat(F.lit("ops0"), k % 5)).otherwise(F.lit("99_20"))
    return C.resolve_names(_table(spark, sf_dir, "customer").select(q.alias("query")).distinct(), n)


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'k1' WHEN 1 THEN 'v2' END AS matched FROM customer")
def dictionary_lookup(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, " V1").when(F.col("c_custkey") % 3 == 1, "K2 ").otherwise("none").alias("q"))
    pairs = spark.createDataFrame([("k1", "v1"), ("k2", "v2")], "k string, v string")
    return C.dictionary_lookup(c, pairs, "q").select("c_custkey", "matched")


@query("SELECT n_nationkey AS store, idx, channel, CASE channel WHEN 'BF' THEN CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END WHEN 'GFP' THEN CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END END AS source_idx FROM nation, (VALUES (0, 'BF'), (1, 'Cy5'), (2, 'GFP')) d(idx, channel)")
def channel_index_map(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("store"))
    names = F.when(F.col("store") % 2 == 0, F.array(*map(F.lit, ("gfp", "Phase", "m-cherry", "BF")))).otherwise(F.array(*map(F.lit, ("bright field", "gfp", "phase"))))
    return C.channel_index_map(n.select("store", F.posexplode(names).alias("idx", "channel")), n.select("store", F.posexplode(F.array(*map(F.lit, ("BF", "Cy5", "GFP")))).alias("idx", "channel")))


# annotation ----------------------------------------------------------------------------------------


@query("SELECT concat('r', r_regionkey) AS set_id, s_suppkey AS gene FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey UNION SELECT concat('n', s_nationkey), s_suppkey FROM supplier UNION SELECT 'all', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def closure_recursive(spark, sf_dir):
    """Region, nation, supplier as a hierarchy, with a cycle from each region to the top."""
    n, r, s = (_table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    region = r.select(F.lit("all").alias("set_id"), F.concat(F.lit("r"), "r_regionkey").alias("component"))
    back = r.select(F.lit("back").alias("set_id"), F.lit("back").alias("component")).distinct()
    nation = n.select(F.concat(F.lit("r"), "n_regionkey").alias("set_id"), F.concat(F.lit("n"), "n_nationkey").alias("component"))
    genes = s.select(F.concat(F.lit("n"), "s_nationkey").alias("set_id"), F.col("s_suppkey").alias("gene"))
    return A.closure(region.union(nation).union(back), genes)


_KEYWORDS = [("metal", 0, "bolt"), ("metal", 0, "steel"), ("colour", 1, "red"), ("colour", 1, "blue"), ("colour", 1, "brand#1"), ("shape", 2, "ring"), ("shape", 2, "small")]


@query(cte("genes") + ", k(category, ordinal, keyword) AS (VALUES " + ", ".join(map(str, _KEYWORDS)) + "), s AS (SELECT gene, category, ordinal, sum(contains(text, keyword)::INT) AS score FROM genes, k GROUP BY ALL) SELECT gene, CASE WHEN score > 0 THEN category END AS category, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, ordinal) AS rn FROM s) WHERE rn = 1")
def keyword_argmax(spark, sf_dir):
    k = spark.createDataFrame(_KEYWORDS, "category string, ordinal int, keyword string")
    return A.keyword_category(read(spark, sf_dir, "genes"), "gene", "text", k)


_PATTERNS = [("reds", 0, "^red"), ("rings", 1, "ring$"), ("widgets", 2, "wid.et")]


@query(cte("genes") + ", p(category, ordinal, pattern) AS (VALUES " + ", ".join(map(str, _PATTERNS)) + ") SELECT gene, arg_min(category, ordinal) AS category FROM genes JOIN p ON regexp_matches(name, pattern) GROUP BY gene")
def regex_first_match(spark, sf_dir):
    p = spark.createDataFrame(_PATTERNS, "category string, ordinal int, pattern string")
    return _pattern(read(spark, sf_dir, "genes"), p)


def _pattern(genes, patterns):
    named = A.pattern_category(genes.select("name").distinct(), "name", patterns)
    return genes.select("gene", "name").join(named, "name").select("gene", "category")


@query(cte("genes", "members") + ", p(category, ordinal, pattern) AS (VALUES " + ", ".join(map(str, _PATTERNS)) + "), g2 AS (SELECT member AS gene, arg_min(set_id, (ordinal, set_id)) AS category FROM members GROUP BY member), g4 AS (SELECT gene, arg_min(category, ordinal) AS category FROM genes JOIN p ON regexp_matches(name, pattern) GROUP BY gene) SELECT g.gene, coalesce(g2.category, g4.category, 'Other') AS category FROM genes g LEFT JOIN g2 USING (gene) LEFT JOIN g4 USING (gene)")
def category_cascade(spark, sf_dir):
    g = read(spark, sf_dir, "genes")
    clusters = A.first_by_order(read(spark, sf_dir, "members"), "member", "set_id", "ordinal").select(F.col("member").alias("gene"), F.col("set_id").alias("category"))
    p = spark.createDataFrame(_PATTERNS, "category string, ordinal int, pattern string")
    return A.cascade(g.select("gene"), "gene", [clusters, _pattern(g, p)])


@query("SELECT p_partkey, c AS category FROM (SELECT p_partkey, unnest([p_type, concat('b', p_partkey % 3)]) AS c FROM part) WHERE c IN ('ECONOMY', 'SMALL', 'b0')")
def multimap_explode(spark, sf_dir):
    g = _table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return A.multi_map(g, F.array("p_type", F.concat(F.lit("b"), F.col("p_partkey") % 3)), ["ECONOMY", "SMALL", "b0"]).select("p_partkey", "category")


@query("SELECT p_type AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM part GROUP BY p_type")
def category_coverage(spark, sf_dir):
    return A.coverage(_table(spark, sf_dir, "part").select(F.col("p_type").alias("category"))).withColumn("share", F.round("share", 6))


@query("WITH s AS (SELECT p_partkey AS id, unnest([p_size % 3, p_size % 5]) AS m, p_partkey AS o FROM part), e AS (SELECT id, list_sort(list(DISTINCT m)) AS members, arg_min(m, (o, m)) AS label, min(o) AS o FROM s GROUP BY id) SELECT array_to_string(members, ',') AS members, arg_min(label, (o, label)) AS label, count(*) AS n_sets FROM e GROUP BY members")
def set_dedupe(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.col("p_size") % 3, F.col("p_size") % 5)).alias("m"))
    d = A.distinct_sets(p.withColumn("o", F.struct("p_partkey", "m")), "p_partkey", "m", "o")
    return d.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(cte("members") + "SELECT member, array_to_string(list_sort(list(DISTINCT set_id)), ',') AS sets FROM members GROUP BY member HAVING count(DISTINCT set_id) > 1")
def disjointness_check(spark, sf_dir):
    return A.overlapping_members(read(spark, sf_dir, "members"), "set_id", "member").withColumn("sets", F.array_join("sets", ","))


@query(cte("members") + "SELECT set_id, count(DISTINCT member) AS n FROM members WHERE set_id <> 's1' AND member IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY set_id HAVING count(DISTINCT member) >= 2")
def eligible_clusters(spark, sf_dir):
    active = _table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("member"))
    return A.eligible_clusters(read(spark, sf_dir, "members"), active, "set_id", "member", skip=("s1",))


@query("SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 10")
def lookup_default(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return A.lookup(_table(spark, sf_dir, "customer"), n, "c_nationkey", "n_name", F.lit("none")).select("c_custkey", "n_name")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'p3' ELSE 'p' END AS project, CASE WHEN c_nationkey = 4 THEN 'l4' ELSE 'l' END AS library FROM customer")
def config_override(spark, sf_dir):
    o = spark.createDataFrame([(3, "p3", None), (4, None, "l4")], "c_nationkey int, project string, library string")
    return A.override(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), o, "c_nationkey", ["project", "library"], {"project": "p", "library": "l"}).select("c_custkey", "project", "library")


# validation ----------------------------------------------------------------------------------------


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates, count(*) FILTER (n > 1) AS n_keys FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def duplicate_ids(spark, sf_dir):
    return V.duplicate_count(_table(spark, sf_dir, "documents"), "text")


@query(cte("controls") + "SELECT CASE WHEN gene_id = -1 THEN 'gene_id' WHEN ncbi_id = -1 THEN 'ncbi_id' WHEN gene_name IS NULL OR trim(gene_name) IN ('', 'None') THEN 'blank' WHEN regexp_matches(gene_name, '(?i)ntc|non-targeting|^0$') THEN 'name' ELSE 'none' END AS reason, count(*) AS n FROM controls GROUP BY 1")
def control_cascade(spark, sf_dir):
    return V.control_counts(read(spark, sf_dir, "controls"), F.col("gene_id"), F.col("ncbi_id"), F.col("gene_name"))


@query(cte("controls") + "SELECT c_custkey, coalesce(gene_name = 'NTC', false) AS exact, coalesce(starts_with(upper(gene_name), 'NTC') OR contains(lower(gene_name), 'non-targeting'), false) AS prefix, coalesce(regexp_matches(gene_name, '(?i)NTC|non-targeting'), false) AS anywhere FROM controls")
def control_predicates(spark, sf_dir):
    c = read(spark, sf_dir, "controls")
    return c.select("c_custkey", N.is_control_exact("gene_name").alias("exact"), N.is_control_prefix("gene_name").alias("prefix"), N.is_control_anywhere("gene_name").alias("anywhere"))


@query("SELECT count(DISTINCT p_name) AS n_guides, count(DISTINCT p_brand) AS n_genes, count(*) FILTER (p_name IS NULL) AS n_missing, count(DISTINCT p_name) = 4208 AS guides_ok, count(DISTINCT p_brand) = 25 AS genes_ok FROM part")
def library_size(spark, sf_dir):
    return V.library_size(_table(spark, sf_dir, "part"), "p_name", "p_brand", 4208, 25)


@query(cte("quality") + "SELECT count(*) AS n, count(*) FILTER (quality IS NOT NULL AND lang = 'en') AS both, count(*) FILTER (quality IS NOT NULL AND NOT lang = 'en') AS only_a, count(*) FILTER (quality IS NULL AND lang = 'en') AS only_b, count(*) FILTER (quality IS NULL AND NOT lang = 'en') AS neither FROM quality")
def conditional_coverage(spark, sf_dir):
    return V.pair_coverage(read(spark, sf_dir, "quality"), F.col("quality").isNotNull(), F.col("lang") == "en")


@query(cte("quality") + "SELECT count(*) AS n, round(avg((quality IS NOT NULL AND lang IS NOT NULL)::INT), 6) AS complete_share, CASE WHEN count(toxic) = 0 THEN 'toxic' ELSE '' END AS all_null FROM quality")
def completeness(spark, sf_dir):
    return V.completeness(read(spark, sf_dir, "quality"), ["quality", "lang"]).withColumn("complete_share", F.round("complete_share", 6))


_CAT = cte("quality") + ", c AS (SELECT coalesce(source, '_unassigned') AS source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) AS total FROM quality GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'TOTAL', sum(en)::BIGINT, sum(de)::BIGINT, sum(total)::BIGINT FROM c"


@query(_CAT)
def pivot_rollup_counts(spark, sf_dir):
    return V.category_table(read(spark, sf_dir, "quality"), "source", "lang", ["en", "de"])


@query(cte("quality") + "SELECT quality, count(*) AS n FROM quality GROUP BY quality ORDER BY n DESC, quality NULLS FIRST LIMIT 2")
def value_counts_topn(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return S.value_counts(read(spark, sf_dir, "quality"), "quality", 2)


@query(cte("quality") + """SELECT * FROM (SELECT 'cell' AS level, 'issue' AS severity, 'nulls' AS check_name, 'quality' AS subject, count(*) FILTER (quality IS NULL) AS n, round(100.0 * count(*) FILTER (quality IS NULL) / count(*), 6) AS pct FROM quality
    UNION ALL SELECT 'cell', 'issue', 'missing_column', 'no_such', 1, NULL UNION ALL SELECT 'cell', 'issue', 'wrong_type', 'lang', 1, NULL UNION ALL SELECT 'cell', 'issue', 'misplaced_columns', 'network_x', 1, NULL
    UNION ALL SELECT 'cell', 'warning', 'drift_readiness', 'quality,lang', count(*), round(100.0 * avg((quality IS NOT NULL AND lang IS NOT NULL)::INT), 6) FROM quality HAVING avg((quality IS NOT NULL AND lang IS NOT NULL)::INT) < 0.5
    UNION ALL SELECT 'cell', 'issue', 'dual_coverage', 'both', count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL), round(100.0 * count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) / count(*), 6) FROM quality)""")
def validation_report(spark, sf_dir):
    q = read(spark, sf_dir, "quality").withColumn("network_x", F.col("n_chars"))
    checks = [V.schema_issues(q, "cell", {"doc_id": "number", "lang": "number", "no_such": "string"}), V.null_issues(q, "cell", ["doc_id", "quality"]), V.misplaced_columns(q, "cell"), V.completeness_warnings(q, "cell", ["quality", "lang"]), V.coverage_issues(q, "cell", F.col("quality").isNotNull(), F.col("toxic").isNotNull())]
    return V.report(checks).withColumn("pct", F.round("pct", 6))


@query("SELECT 'cell' AS level, 1::BIGINT AS n_issues, 0::BIGINT AS n_warnings, false AS passed UNION ALL SELECT 'gene', 0, 0, true")
def validation_verdict(spark, sf_dir):
    q = read(spark, sf_dir, "quality")
    return V.verdicts(spark.createDataFrame([("cell",), ("gene",)], "level string"), V.null_issues(q, "cell", ["doc_id", "quality"]))


_PLANTED = "SELECT cast(c_custkey AS varchar(20)) AS cell_id, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_mktsegment END AS well, CASE WHEN c_custkey % 31 = 0 THEN -1 ELSE c_nationkey END AS gene_id, CASE WHEN c_custkey % 31 = 0 THEN 'NTC' ELSE concat('g', cast(c_nationkey AS varchar(10))) END AS gene, CASE c_custkey % 7 WHEN 0 THEN 'None' WHEN 1 THEN '' ELSE concat('s', cast(c_custkey % 50 AS varchar(10))) END AS guide, CASE WHEN c_custkey % 3 = 0 THEN 1.0 END AS x, CASE WHEN c_custkey % 11 > 0 THEN 1 END AS box_a, CASE WHEN c_custkey % 13 > 0 THEN 1 END AS box_b, c_acctbal AS balance FROM customer"


@query(f"""WITH c AS ({_PLANTED}), n AS (SELECT count(*) AS n FROM c),
    r AS (SELECT 'issue' AS severity, 'nulls' AS check_name, 'well' AS subject, count(*) FILTER (well IS NULL) AS k, NULL AS pct, true AS shared FROM c
    UNION ALL SELECT 'issue', 'duplicates', 'cell_id', count(*) - count(DISTINCT cell_id), NULL, true FROM (SELECT * FROM c UNION ALL SELECT * FROM c WHERE gene_id = -1)
    UNION ALL SELECT 'issue', 'quality', 'zero_features', 1, 100 / 3.0, false UNION ALL SELECT 'issue', 'quality', 'constant_features', 1, 100 / 3.0, false
    UNION ALL SELECT 'issue', 'dual_coverage', 'both', count(*) FILTER (box_a IS NOT NULL AND box_b IS NOT NULL), NULL, true FROM c UNION ALL SELECT 'issue', 'dual_coverage', 'neither', count(*) FILTER (box_a IS NULL AND box_b IS NULL), NULL, true FROM c
    UNION ALL SELECT 'warning', 'incomplete', 'drift', count(*) FILTER (x IS NOT NULL), NULL, true FROM c
    UNION ALL SELECT 'issue', 'library_size', 'guides', count(DISTINCT nullif(nullif(guide, ''), 'None')), 100.0 * count(DISTINCT nullif(nullif(guide, ''), 'None')) / 40, false FROM c
    UNION ALL SELECT 'issue', 'missing_column', 'none', 1, NULL, false)
    SELECT 'cell' AS level, severity, check_name, subject, k::BIGINT AS n, round(CASE WHEN shared AND check_name = 'duplicates' THEN 100.0 * k / (SELECT count(*) + count(*) FILTER (gene_id = -1) FROM c) WHEN shared THEN 100.0 * k / n ELSE pct END, 6)::DOUBLE AS pct FROM r, n WHERE k > 0""")
def validation_pass(spark, sf_dir):
    """All checks of a table with planted faults in one pass; its clean twin, the level ``gene``, raises nothing. The repeats are checked on the table with its controls twice."""
    c = spark.sql(_PLANTED.replace("FROM customer", "FROM {customer}"), customer=_table(spark, sf_dir, "customer"))
    c = c.withColumn("v", F.array(F.col("balance"), F.lit(0.0), F.lit(3.0)))
    cell = VP.Checks("cell", {"cell_id": "string", "none": "number"}, ["cell_id", "well"], None, "v", 3, "network_", (F.col("box_a").isNotNull(), F.col("box_b").isNotNull()), {"drift": ["x"]}, ("gene_id", None, "gene"), "guide", "gene", 40, 25)
    gene = VP.Checks("gene", {"gene": "string"}, ["gene"], "cell_id", control=("gene_id", None, "gene"), gene="gene", genes=25)
    twice = VP.validate_table(c.union(c.where("gene_id = -1")), VP.Checks("cell", key="cell_id"))
    return V.report([VP.validate_table(c, cell), VP.validate_table(c, gene), twice]).withColumn("pct", F.round("pct", 6))


@query(f"""WITH c AS ({_PLANTED}), e AS (SELECT DISTINCT well FROM c WHERE well IS NOT NULL), l AS (SELECT well AS experiment, level FROM e, (SELECT unnest(['cell', 'guide', 'gene']) AS level)),
    f AS (SELECT l.*, CASE WHEN level = 'guide' AND experiment LIKE 'A%' THEN 1 WHEN level = 'cell' AND experiment LIKE 'M%' THEN 1 ELSE 0 END AS n_issues, CASE WHEN level = 'gene' THEN 1 ELSE 0 END AS n_warnings FROM l)
    SELECT experiment, level, n_issues::BIGINT AS n_issues, n_warnings::BIGINT AS n_warnings, n_issues = 0 AS passed FROM f UNION ALL SELECT experiment, 'all', sum(n_issues)::BIGINT, sum(n_warnings)::BIGINT, sum(n_issues) = 0 FROM f GROUP BY experiment""")
def experiment_verdicts(spark, sf_dir):
    """Segments stand for experiments: those with an A have no file of guides, those with an M an issue of their cells; all have a warning."""
    e = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("experiment")).distinct()
    level = lambda name: F.lit(name).alias("level")
    present = e.select("experiment", level("cell")).union(e.select("experiment", level("gene"))).union(e.where("experiment NOT LIKE 'A%'").select("experiment", level("guide")))
    issues = e.select("experiment", level("gene"), F.lit("warning").alias("severity")).union(e.where("experiment LIKE 'M%'").select("experiment", level("cell"), F.lit("issue")))
    return VP.experiment_verdicts(issues, present)


@query(cte("quality") + "SELECT 'cell' AS level, 'issue' AS severity, 'unassigned_features' AS check_name, 'quality' AS subject, count(*) FILTER (quality IS NULL) AS n, round(100.0 * count(*) FILTER (quality IS NULL) / count(*), 6) AS pct FROM quality")
def unassigned_features(spark, sf_dir):
    return VP.unassigned_issues(read(spark, sf_dir, "quality"), "cell", "quality").withColumn("pct", F.round("pct", 6))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY text LIMIT 5")
def duplicate_examples(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return V.duplicate_examples(_table(spark, sf_dir, "documents"), "text")


# catalogues ----------------------------------------------------------------------------------------


@query(cte("experiments", "exclusions") + r", u AS (SELECT * FROM exclusions WHERE category IN ('bad', 'old')) SELECT name, coalesce(nullif(regexp_extract(name, '(?i)^ops\d{4}_(\d{8})$', 1), '') < '20231000', false) OR name IN (SELECT name FROM u WHERE name IS NOT NULL) OR coalesce(try_cast(nullif(regexp_extract(name, '^ops0*(\d+)', 1), '') AS INT) IN (SELECT number FROM u WHERE number IS NOT NULL), false) AS excluded FROM experiments")
def exclusion_filter(spark, sf_dir):
    return C.excluded(read(spark, sf_dir, "experiments"), read(spark, sf_dir, "exclusions"), ["bad", "old"], "20231000")


@query(cte("experiments", "exclusions") + r""", u AS (SELECT *, CASE WHEN category = 'old' THEN NULL ELSE concat(category, ' ', coalesce(name, number::VARCHAR)) END AS reason, CASE category WHEN 'bad' THEN 0 WHEN 'old' THEN 1 ELSE 2 END * 1000 + coalesce(number, try_cast(substr(name, 4) AS INT)) AS ordinal FROM exclusions),
    k AS (SELECT name, try_cast(nullif(regexp_extract(name, '^ops0*(\d+)', 1), '') AS INT) AS num, nullif(regexp_extract(name, '(?i)^ops\d{4}_(\d{8})$', 1), '') AS day FROM experiments),
    h AS (SELECT k.name, arg_min(coalesce(reason, 'none'), ordinal) AS r FROM k JOIN u ON u.name = k.name OR u.number = k.num GROUP BY k.name)
    SELECT k.name, CASE WHEN r IS NOT NULL THEN nullif(r, 'none') WHEN day < '20231000' THEN 'before date cutoff (20231000)' END AS reason FROM k LEFT JOIN h USING (name)""")
def exclusion_reasons(spark, sf_dir):
    """The first rule that has the experiment's name or number, or the cut-off date."""
    rules = read(spark, sf_dir, "exclusions").withColumn("reason", F.when(F.col("category") != "old", F.concat("category", F.lit(" "), F.coalesce("name", F.col("number").cast("string")))))
    place = F.when(F.col("category") == "bad", 0).when(F.col("category") == "old", 1).otherwise(2) * 1000
    return C.exclusion_reasons(read(spark, sf_dir, "experiments"), rules.withColumn("ordinal", place + F.coalesce("number", F.substring("name", 4, 10).try_cast("int"))), "20231000")


@query("SELECT p_partkey, concat('livecell_OPS', CASE p_partkey % 4 WHEN 1 THEN ',Cell_Painting' WHEN 2 THEN ',4i,Cell_Painting' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN ',MERFISH' ELSE '' END) AS design FROM part")
def design_tags(spark, sf_dir):
    p = _table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("part"), "p_partkey"))
    k = F.col("p_partkey") % 4
    row = lambda pos, flag, on: F.struct(F.lit(pos).alias("pos"), F.lit(flag).alias("flag"), on.alias("enabled"))
    flags = p.select(F.col("name").alias("experiment"), F.explode(F.array(row(2, "cell_painting", k.isin(1, 2)), row(1, "four_i", k == 2), row(3, "four_i", k == 2), row(0, "other", F.lit(True)))).alias("f")).select("experiment", "f.*")
    books = p.select(F.col("name").alias("experiment"), F.when(F.col("p_size") % 5 == 0, "book_MERFISH_2.csv").when(F.col("p_size") % 5 == 1, "plain.csv").alias("codebook"))
    return C.design_tags(p, flags, books).select("p_partkey", F.array_join("design", ",").alias("design"))


@query(cte("channel_map") + "SELECT experiment, pos, channel_name AS channel, label, coalesce(regexp_matches(lower(label), 'economy'), false) OR coalesce(experiment = 'ops0007' AND lower(channel_name) = 'gfp', false) OR coalesce(regexp_extract(experiment, '^ops0*(\\d+)', 1) = '12' AND lower(channel_name) = 'bf', false) AS bad FROM channel_map")
def bad_channels(spark, sf_dir):
    m = read(spark, sf_dir, "channel_map").withColumnRenamed("channel_name", "channel")
    rules = spark.createDataFrame([("OPS0007", None, "gfp"), (None, 12, "BF")], "name string, number int, channel string")
    return C.bad_channels(m, rules, ("economy",))


@query("SELECT p_brand AS signal, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS experiments, count(DISTINCT p_type) AS n_experiments, count(*) AS n_rows FROM part WHERE p_brand <> 'Brand#1' GROUP BY p_brand")
def signal_groups(spark, sf_dir):
    p = _table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_type").alias("experiment")).agg(F.count("*").alias("n_rows"))
    return C.signal_groups(p.withColumn("signal", F.when(F.col("p_brand") == "Brand#1", "unknown").otherwise(F.col("p_brand"))))


@query(cte("docs_steps", "files") + ", f AS (SELECT DISTINCT path FROM files), a AS (SELECT experiment, bool_and(f.path IS NOT NULL) AS ok FROM docs_steps d LEFT JOIN f USING (path) GROUP BY experiment), e AS (SELECT DISTINCT experiment FROM docs_steps) SELECT experiment, CASE WHEN experiment LIKE '%7_2024%' THEN 'no_config' WHEN ok THEN 'fully' ELSE 'none' END AS status FROM e JOIN a USING (experiment)")
def status_classify(spark, sf_dir):
    d, f = read(spark, sf_dir, "docs_steps"), read(spark, sf_dir, "files")
    e = d.select("experiment").distinct()
    return C.embedding_status(e, e.where("experiment NOT LIKE '%7_2024%'"), d, d, f)


@query(cte("docs_steps", "files") + "SELECT experiment, count(f.path) AS n_existing, count(*) AS n_expected, CASE WHEN count(f.path) = count(*) THEN 'completed' WHEN count(f.path) > 0 THEN 'partial' ELSE 'to_process' END AS state, coalesce(try_cast(nullif(regexp_extract(experiment, '^ops0*(\\d+)', 1), '') AS INT), 9999) AS order_no FROM docs_steps d LEFT JOIN (SELECT DISTINCT path FROM files) f USING (path) GROUP BY experiment")
def progress_counts(spark, sf_dir):
    d = read(spark, sf_dir, "docs_steps")
    return C.progress(d, read(spark, sf_dir, "files"))


@query(cte("docs_steps", "files") + ", m AS (SELECT experiment, count(*) AS n FROM docs_steps WHERE path NOT IN (SELECT path FROM files) GROUP BY experiment), s AS (SELECT DISTINCT experiment AS step, CASE WHEN experiment LIKE '%1_2024%' THEN [] ELSE ['ops0003_20240101', 'ops0004_20240101'] END AS deps FROM docs_steps), x AS (SELECT step, unnest(CASE WHEN len(deps) = 0 THEN [NULL] ELSE deps END) AS dep FROM s) SELECT step, coalesce(sum(n), 0)::BIGINT AS n_missing, coalesce(sum(n), 0) = 0 AS ready FROM x LEFT JOIN m ON m.experiment = dep GROUP BY step")
def step_dependencies(spark, sf_dir):
    d = read(spark, sf_dir, "docs_steps")
    steps = d.select(F.col("experiment").alias("step")).distinct().withColumn("deps", F.when(F.col("step").like("%1_2024%"), F.array().cast("array<string>")).otherwise(F.array(F.lit("ops0003_20240101"), F.lit("ops0004_20240101"))))
    return C.step_states(steps, d.withColumnRenamed("experiment", "step"), read(spark, sf_dir, "files"))


@query("SELECT o_custkey AS k, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def first_location(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    return C.first_location(o, "k", "o_orderkey")


@query("SELECT count(*) FILTER (s = 'RUNNING') AS running, count(*) FILTER (s = 'PENDING') AS pending, count(*) FILTER (s = 'COMPLETED') AS completed, count(*) FILTER (s NOT IN ('RUNNING', 'PENDING', 'COMPLETED')) AS failed, false AS done FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'CANCELLED' ELSE 'FAILED' END AS s FROM orders)")
def job_status(spark, sf_dir):
    o, k = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")), F.col("job_id") % 5
    jobs = o.where(k > 0).withColumn("state", F.when(k == 1, "RUNNING").when(k == 2, "COMPLETED").when(k == 3, "CANCELLED by 7").otherwise("FAILED"))
    return C.status_counts(C.job_status(o, jobs))


# geometry ------------------------------------------------------------------------------------------

_BOX = r"regexp_extract_all(bbox, '-?\d+')"


@query(cte("boxes") + f"SELECT id, CASE WHEN len({_BOX}) = 4 THEN {_BOX}[1]::INT END AS ymin, CASE WHEN len({_BOX}) = 4 THEN {_BOX}[2]::INT END AS xmin, CASE WHEN len({_BOX}) = 4 THEN {_BOX}[3]::INT END AS ymax, CASE WHEN len({_BOX}) = 4 THEN {_BOX}[4]::INT END AS xmax FROM boxes")
def bbox_normalize(spark, sf_dir):
    return read(spark, sf_dir, "boxes").select("id", B.parse_box("bbox").alias("b")).select("id", "b.*")


@query(cte("boxes") + f", b AS (SELECT id, {_BOX}[1]::INT AS ymin, {_BOX}[2]::INT AS xmin, {_BOX}[3]::INT AS ymax, {_BOX}[4]::INT AS xmax FROM boxes WHERE len({_BOX}) = 4), p AS (SELECT id, trunc(ymin - greatest(0, 128 - (ymax - ymin)) / 2.0)::INT AS ymin, trunc(xmin - greatest(0, 128 - (xmax - xmin)) / 2.0)::INT AS xmin, trunc(ymax + greatest(0, 128 - (ymax - ymin)) / 2.0)::INT AS ymax, trunc(xmax + greatest(0, 128 - (xmax - xmin)) / 2.0)::INT AS xmax FROM b) SELECT id, greatest(0, ymin) AS ymin, greatest(0, xmin) AS xmin, least(900, ymax) AS ymax, least(900, xmax) AS xmax FROM p")
def bbox_pad_clip(spark, sf_dir):
    b = read(spark, sf_dir, "boxes").select("id", B.parse_box("bbox").alias("b")).where("b IS NOT NULL")
    return b.select("id", B.clip_box(B.pad_box(F.col("b"), 128, 128), 900, 900).alias("b")).select("id", "b.*")


@query(cte("pixels") + "SELECT tile, label, min(y) AS ymin, min(x) AS xmin, max(y) + 1 AS ymax, max(x) + 1 AS xmax, count(*) AS area FROM pixels WHERE label <> 0 GROUP BY tile, label")
def label_to_bbox(spark, sf_dir):
    return G.label_boxes(read(spark, sf_dir, "pixels"), ["tile"])


@query(cte("pixels") + ", b AS (SELECT label, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM pixels WHERE label % 3 > 0 GROUP BY label) SELECT p.tile, p.y, p.x, p.label, coalesce(y0, p.y - 64)::INT AS ymin, coalesce(x0, p.x - 64)::INT AS xmin, coalesce(y1, p.y + 64)::INT AS ymax, coalesce(x1, p.x + 64)::INT AS xmax FROM pixels p LEFT JOIN b USING (label)")
def boxes_for_cells(spark, sf_dir):
    """Cells with the box of their label, or a square around them where it has none."""
    p = read(spark, sf_dir, "pixels")
    boxes = G.label_boxes(p.where("label % 3 > 0").withColumn("g", F.lit(1)), ["g"]).drop("g", "area")
    return G.boxes_for_cells(p, boxes, ["label"])


@query(cte("pixels") + "SELECT * FROM pixels WHERE x > (SELECT min(x) FROM pixels) + 8 AND x < (SELECT max(x) FROM pixels) - 8 AND y > (SELECT min(y) FROM pixels) + 8 AND y < (SELECT max(y) FROM pixels) - 8")
def edge_filter(spark, sf_dir):
    return G.inside_edges(read(spark, sf_dir, "pixels"), 8)


@query("SELECT p_partkey AS id, r AS row, c AS col, r * (h // 3 - 10) AS y0, r * (h // 3 - 10) + h // 3 AS y1, c * (w // 3 - 10) AS x0, c * (w // 3 - 10) + w // 3 AS x1 FROM (SELECT p_partkey, 100 + p_size AS h, 90 + p_size AS w FROM part), range(3) a(r), range(3) b(c)")
def tile_bounds(spark, sf_dir):
    i = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 100).alias("height"), (F.col("p_size") + 90).alias("width"))
    return G.tiles_by_stride(i, 3, 10).drop("height", "width")


@query("SELECT p_partkey AS id, r AS row, c AS col, greatest(0, r * (h // 3) - 10) AS y0, least(h, CASE WHEN r = 2 THEN h ELSE (r + 1) * (h // 3) END + 10) AS y1, greatest(0, c * (w // 3) - 10) AS x0, least(w, CASE WHEN c = 2 THEN w ELSE (c + 1) * (w // 3) END + 10) AS x1 FROM (SELECT p_partkey, 100 + p_size AS h, 90 + p_size AS w FROM part), range(3) a(r), range(3) b(c)")
def tile_bounds_overlap(spark, sf_dir):
    i = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 100).alias("height"), (F.col("p_size") + 90).alias("width"))
    return G.tiles_with_overlap(i, 3, 10).drop("height", "width")


@query("""WITH i AS (SELECT p_partkey AS id, (300 + p_size * 12)::INT AS h, (252 + p_partkey % 400 * 12)::INT AS w FROM part), c AS (SELECT *, h // 2 AS cy, w // 2 AS cx, least(h // 2, w // 2) AS r FROM i),
    y AS (SELECT *, unnest(['center', 'mid', 'edge']) AS place, unnest([cy, cy - r // 2, cy - (r - 60)]) AS y FROM c)
    SELECT id, place, y::INT AS y, cx::INT AS x, greatest(0, y - 50)::INT AS y0, least(h, greatest(0, y - 50) + 100)::INT AS y1, greatest(0, cx - 50)::INT AS x0, least(w, greatest(0, cx - 50) + 100)::INT AS x1, greatest(0, (h - 280) // 2)::INT AS c0, least(h, greatest(0, (h - 280) // 2) + 280)::INT AS c1, (id % 3 + 2)::INT AS grid FROM y""")
def region_boxes(spark, sf_dir):
    """Three regions of each image, the rows of its central square, and the side of its grid of parts."""
    h, w = (F.lit(300) + F.col("p_size") * 12).cast("int"), (F.lit(252) + F.col("p_partkey") % 400 * 12).cast("int")
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), h.alias("h"), w.alias("w"))
    side = F.col("id") % 3 + 2
    rois = p.select("id", G.central_roi(F.col("h"), F.col("w"), 280).alias("c"), G.subtile_grid(side * side, F.col("h"), F.col("w")).alias("grid"), F.explode(G.three_rois(F.col("h"), F.col("w"), 100, 60)).alias("r"))
    return rois.select("id", "r.*", F.col("c.y0").alias("c0"), F.col("c.y1").alias("c1"), "grid")


@query("SELECT p_partkey AS id, t, c FROM part, range(51) a(t), range(3) b(c) WHERE t < p_size % 4 + 1 AND c < p_partkey % 3 + 1")
def enumerate_units(spark, sf_dir):
    return G.units(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4 + 1).alias("n_t"), (F.col("p_partkey") % 3 + 1).cast("int").alias("n_c")))


@query(cte("positions") + ", r AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY ord) AS r, count(*) OVER (PARTITION BY well) AS n FROM positions) SELECT well, ord, position FROM r WHERE r - 1 >= n // 2 - least(5, n) // 2 AND r - 1 < n // 2 - least(5, n) // 2 + least(5, n)")
def balanced_sample(spark, sf_dir):
    return G.balanced_sample(read(spark, sf_dir, "positions"), "well", "ord", 5)


@query(cte("positions") + ", w AS (SELECT DISTINCT well FROM positions) SELECT well, 100 // (SELECT count(*) FROM w) + CASE WHEN row_number() OVER (ORDER BY well) <= 100 % (SELECT count(*) FROM w) THEN 1 ELSE 0 END AS n FROM w")
def sample_shares(spark, sf_dir):
    return G.shares(read(spark, sf_dir, "positions").select("well").distinct(), 100, "well")


@query(cte("positions") + """, w AS (SELECT well, row_number() OVER (ORDER BY well) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT well FROM positions)),
    r AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY ord) - 1 AS r, count(*) OVER (PARTITION BY well) AS n FROM positions JOIN w USING (well)),
    k AS (SELECT *, least(n, 100 // m + CASE WHEN i <= 100 % m THEN 1 ELSE 0 END) AS k FROM r)
    SELECT well, position FROM k WHERE r >= n // 2 - k // 2 AND r < n // 2 - k // 2 + k""")
def sampled_positions(spark, sf_dir):
    """A hundred positions over all wells, from the middle of each."""
    return G.sample_positions(read(spark, sf_dir, "positions"), "well", "position", 100).select("well", "position")


@query(cte("positions") + """, p AS (SELECT concat(well, '/', c) AS well, position, ord FROM (SELECT *, ord % 7 AS c FROM positions)),
    w AS (SELECT well, count(*) AS n, row_number() OVER (ORDER BY well) - 1 AS i, count(*) OVER () AS m FROM p GROUP BY well),
    s AS (SELECT *, least(n, 2) AS g FROM w WHERE i >= CASE WHEN 10 >= m THEN 0 ELSE m // 2 - 5 END AND i < CASE WHEN 10 >= m THEN 0 ELSE m // 2 - 5 END + 10),
    t AS (SELECT *, least(n, ceil(10.0 / count(*) OVER ())::INT) AS part FROM s), u AS (SELECT well, n, greatest(0, least(part, 10 - (sum(part) OVER (ORDER BY well) - part))) AS part FROM t),
    r AS (SELECT p.well, position, row_number() OVER (PARTITION BY p.well ORDER BY ord) - 1 - n // 2 AS o, part FROM p JOIN u USING (well))
    SELECT well, position FROM (SELECT *, row_number() OVER (PARTITION BY well ORDER BY abs(o), o) AS q FROM r) WHERE q <= part""")
def discovered_positions(spark, sf_dir):
    """Ten positions of the central wells, spreading from the middle of each."""
    p = read(spark, sf_dir, "positions").withColumn("well", F.concat("well", F.lit("/"), (F.col("ord") % 7).cast("string")))
    return G.discover_positions(p, "well", "position", 10).select("well", "position")


@query(cte("positions") + "SELECT well, arg_max(position, regexp_replace(position, '\\D', '', 'g')::INT) AS position FROM positions GROUP BY well")
def last_per_group(spark, sf_dir):
    return G.last_position(read(spark, sf_dir, "positions"), "well", "position")


@query(cte("controls") + ", d AS (SELECT DISTINCT coalesce(gene_name, 'NTC') AS gene_name FROM controls) SELECT gene_name, (dense_rank() OVER (ORDER BY gene_name) - 1)::INT AS code FROM d")
def dense_label_codes(spark, sf_dir):
    return G.label_codes(read(spark, sf_dir, "controls"), "gene_name")


@query("SELECT p_size AS level_size, concat('1,', greatest(1, p_size), ',40;1,', greatest(1, p_size // 2), ',20;1,', greatest(1, p_size // 4), ',10') AS shapes, least(64, ceil(p_size / 16.0)::INT * 16) AS shard FROM part GROUP BY p_size")
def pyramid_shapes(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_size").distinct()
    return p.select(F.col("p_size").alias("level_size"), F.array_join(F.transform(B.level_shapes(F.array(F.lit(1), F.col("p_size"), F.lit(40)), 3), lambda v: F.array_join(v.cast("array<string>"), ",")), ";").alias("shapes"), B.clamp_shard(F.lit(64), F.lit(16), F.col("p_size")).alias("shard"))


@query(cte("pixels") + "SELECT tile, bool_or(label <> 0) AS has_data FROM pixels GROUP BY tile")
def data_presence(spark, sf_dir):
    t = read(spark, sf_dir, "pixels").groupBy("tile", "y").agg(F.collect_list("label").alias("values"))
    return G.has_data(t, ["tile"], "values")


# jobs ----------------------------------------------------------------------------------------------

_T = "try_cast(split_part({0}, ':', {1}) AS DOUBLE)"


@query(cte("durations") + """, d AS (SELECT id, CASE WHEN contains(duration, '-') THEN try_cast(split_part(duration, '-', 1) AS INT) ELSE 0 END AS dd, CASE WHEN contains(duration, '-') THEN split_part(duration, '-', 2) ELSE duration END AS c FROM durations)
    SELECT id, coalesce(CASE len(string_split(c, ':')) WHEN 3 THEN dd * 86400 + """ + f"{_T.format('c', 1)} * 3600 + {_T.format('c', 2)} * 60 + {_T.format('c', 3)} WHEN 2 THEN dd * 86400 + {_T.format('c', 1)} * 60 + {_T.format('c', 2)}" + " END, 0.0) AS seconds FROM d")
def duration_parse(spark, sf_dir):
    return read(spark, sf_dir, "durations").select("id", U.duration_seconds("duration").alias("seconds"))


@query(cte("durations") + """SELECT id, coalesce(CASE right(size, 1) WHEN 'K' THEN try_cast(left(size, -1) AS DOUBLE) * 1024 WHEN 'M' THEN try_cast(left(size, -1) AS DOUBLE) * 1048576 WHEN 'G' THEN try_cast(left(size, -1) AS DOUBLE) * 1073741824 WHEN 'T' THEN try_cast(left(size, -1) AS DOUBLE) * 1099511627776 ELSE try_cast(size AS DOUBLE) END, 0.0) AS bytes FROM durations""")
def size_parse(spark, sf_dir):
    return read(spark, sf_dir, "durations").select("id", U.size_bytes("size").alias("bytes"))


@query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN format('{}h:{:02d}m:{:02d}s', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN format('{}m:{:02d}s', s // 60, s % 60) ELSE format('{}s', s) END AS text FROM (SELECT o_orderkey, o_orderkey * 7 % 9000 AS s FROM orders)")
def duration_format(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", U.format_duration(F.col("o_orderkey") * 7 % 9000).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 100)::DOUBLE END AS util_pct, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_orderkey / 1024.0, 6) END AS mem_gb FROM orders")
def gpu_metrics(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("cpu=1,gres/gpuutil="), F.when(k % 3 == 0, F.lit("x")).otherwise((k % 100).cast("string")), F.lit(",gres/gpumem="), F.when(k % 5 == 0, F.lit("junk")).otherwise(F.concat(k.cast("string"), F.lit("M"))))
    o = _table(spark, sf_dir, "orders").select("o_orderkey", U.gpu_metrics(text).alias("g"))
    return o.select("o_orderkey", "g.util_pct", F.round("g.mem_gb", 6).alias("mem_gb"))


@query(cte("job_records") + ", m AS (SELECT * FROM job_records WHERE NOT contains(job_id, '.')), s AS (SELECT *, split_part(job_id, '.', 1) AS j, row_number() OVER (PARTITION BY split_part(job_id, '.', 1) ORDER BY CASE WHEN job_id LIKE '%.0' THEN 1 ELSE 2 END) AS rn FROM job_records WHERE job_id LIKE '%.0' OR job_id LIKE '%.batch'), k AS (SELECT job_id AS j FROM m UNION SELECT j FROM s) SELECT k.j AS job_id, coalesce(nullif(trim(s.max_rss), ''), m.max_rss) AS max_rss, coalesce(nullif(trim(s.elapsed), ''), m.elapsed) AS elapsed FROM k LEFT JOIN m ON m.job_id = k.j LEFT JOIN s ON s.j = k.j AND rn = 1")
def job_step_priority(spark, sf_dir):
    return J.best_records(read(spark, sf_dir, "job_records"), ["max_rss", "elapsed"])


@query("SELECT l_shipmode, count(*) AS n_jobs, min(e) FILTER (e > 0) AS min_s, max(e) FILTER (e > 0) AS max_s, round(avg(CASE WHEN e > 0 THEN 100 * 30.0 / (e * 2) END), 6) AS cpu_pct FROM (SELECT l_returnflag AS l_shipmode, (l_suppkey % 50 * 60)::DOUBLE AS e FROM lineitem) GROUP BY l_shipmode")
def resource_summary(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("l_shipmode"), F.format_string("00:%02d:00", F.col("l_suppkey") % 50).alias("elapsed"), F.lit("").alias("max_rss"), F.lit("00:30").alias("total_cpu"), F.lit(2).alias("alloc_cpus"))
    return J.resource_summary(li, ["l_shipmode"]).select("l_shipmode", "n_jobs", "min_s", "max_s", F.round("cpu_pct", 6).alias("cpu_pct"))


#: Entries at several depths below their step, some without a host or a readable time.
_DEEP = "SELECT concat(log_key, CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN '_a' WHEN 2 THEN concat('_ps', cast(ord % 5 AS varchar(10)), '_pe') ELSE '__x' END) AS log_key, CASE ord % 6 WHEN 0 THEN 'soon' WHEN 1 THEN '12.5' ELSE duration END AS duration, CASE WHEN ord % 7 = 0 THEN cast(NULL AS varchar(10)) ELSE hostname END AS hostname, CASE WHEN ord % 3 = 0 THEN cast(ord % 101 AS double) END AS gpu_sm_util_avg_pct, cast(ord * 17 % 4096 AS double) AS gpu_mem_used_mib, CASE WHEN ord % 5 = 0 THEN concat('model', cast(ord % 2 AS varchar(10))) ELSE '' END AS gpu_models FROM calls"


@query(cte("calls") + f""", d AS ({_DEEP}), p AS (SELECT DISTINCT regexp_replace(log_key, '_[^_]*$', '') AS parent FROM d),
    c AS (SELECT *, CASE WHEN duration = 'soon' THEN NULL ELSE regexp_extract(duration, '^([0-9.]+)', 1)::DOUBLE END AS s FROM d)
    SELECT parent, count(*) AS n, round(sum(s), 2) AS total_s, round(min(s), 2) AS min_s, round(max(s), 2) AS max_s, coalesce(string_agg(DISTINCT hostname, ',' ORDER BY hostname), '') AS hosts,
    round(min(gpu_sm_util_avg_pct), 2) AS gpu_sm_util_min, round(max(gpu_mem_used_mib), 1) AS gpu_mem_mib_max, coalesce(string_agg(DISTINCT nullif(gpu_models, ''), ',' ORDER BY nullif(gpu_models, '')), '') AS gpu_models
    FROM p JOIN c ON starts_with(log_key, parent || '_') GROUP BY parent""")
def subtask_rollup(spark, sf_dir):
    """Sub-tasks at any depth below their parents."""
    c = spark.sql(_DEEP.replace("FROM calls", "FROM {calls}"), calls=read(spark, sf_dir, "calls"))
    parents = c.select(F.regexp_replace("log_key", "_[^_]*$", "").alias("log_key"))
    return J.subtask_rollup(c, parents).select("parent", "n", "total_s", "min_s", "max_s", "hosts", "gpu_sm_util_min", "gpu_mem_mib_max", "gpu_models")


@query(cte("calls") + "SELECT hostname, max(ord) AS ord FROM calls GROUP BY hostname")
def latest_per_key(spark, sf_dir):
    return J.latest_per_key(read(spark, sf_dir, "calls").select("hostname", "ord"), "hostname", "ord")


@query("SELECT event_id, round(coalesce((c - lag(c) OVER (PARTITION BY user_id ORDER BY event_id)) / 2.0, 0), 6) AS rate FROM (SELECT event_id, user_id, (event_id * 31 % 1000)::DOUBLE AS c FROM events)")
def counter_rate(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") * 31 % 1000).cast("double").alias("c"))
    return J.counter_rate(e, "user_id", "event_id", "c", 2.0).select("event_id", F.round("rate", 6).alias("rate"))


@query("SELECT round(avg(v), 4) AS mean_of_max, max(v) AS max_of_max, count(*) AS n_ticks FROM (SELECT user_id, max(value) AS v FROM events GROUP BY user_id)")
def tick_means(spark, sf_dir):
    return J.tick_means(_table(spark, sf_dir, "events"), "user_id", "value").withColumn("mean_of_max", F.round("mean_of_max", 4))


@query("SELECT p_partkey, concat_ws('_', p_name, CASE WHEN p_partkey % 2 = 0 THEN p_type END, p_brand) AS step_key, translate(replace(concat(p_brand, '/', p_name, ':x'), '/', '__'), ': ', '__') AS safe_key FROM part")
def step_and_cache_keys(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", N.step_key(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), F.col("p_brand")).alias("step_key"), N.safe_key(F.concat("p_brand", F.lit("/"), "p_name", F.lit(":x"))).alias("safe_key"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS low, CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN 2.5::DOUBLE END AS high, CASE WHEN p_partkey % 3 = 1 THEN 4.0::DOUBLE END AS first_high, p_partkey % 3 = 1 AS second_missing FROM part")
def contrast_limits(spark, sf_dir):
    own = F.format_string('{"contrast_limits": [0, %d]}', "p_size")
    mapped = F.lit('{"clims_per_level": {"0": {"contrast_limits": [1, 2.5], "contrast_limits_per_channel": [[3, 4], [5]]}}, "contrast_limits": [9, 9]}')
    text = F.when(F.col("p_partkey") % 3 == 0, own).when(F.col("p_partkey") % 3 == 1, mapped).otherwise(F.lit('{"contrast_limits": ["x", 1]}'))
    p = _table(spark, sf_dir, "part").select("p_partkey", X.contrast_limits(text, F.lit(0), F.lit(2)).alias("c"))
    return p.select("p_partkey", F.get("c.limits", F.lit(0)).alias("low"), F.get("c.limits", F.lit(1)).alias("high"), F.get(F.get("c.per_channel", F.lit(0)), F.lit(1)).alias("first_high"), (F.col("c.per_channel").isNotNull() & F.get("c.per_channel", F.lit(1)).isNull()).alias("second_missing"))


@query("SELECT p_partkey, p_partkey % 4 = 1 AS fluorescent FROM part")
def fluorescence_presence(spark, sf_dir):
    k = F.col("p_partkey") % 4
    channels = F.create_map(F.lit("BF"), F.lit("Phase"), F.lit("GFP"), F.when(k == 0, F.lit(" brightfield ")).when(k == 3, F.lit(None).cast("string")).otherwise(F.col("p_name")))
    return _table(spark, sf_dir, "part").select("p_partkey", X.has_fluorescence(channels, F.when(k == 2, F.array(F.lit("GFP")))).alias("fluorescent"))
