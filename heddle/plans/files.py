"""Queries of sources and sinks (each writes the driver's tables in a source's format below the shared folder and reads them back) and of the small expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import names as N
from heddle.functions import units as U
from heddle.functions import vectors as X
from heddle.operators import catalog as C
from heddle.operators import profiles as P
from heddle.operators import retrieval as R
from heddle.operators import spatial as G
from heddle.plans.inputs import cte, read
from heddle.sources import readers as S

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r6(x):
    return F.round(x, 6) + F.lit(0.0)


# sources -------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, substr(p_name, 3, 10) AS \"sgRNA\", p_brand AS gene_name, p_size::BIGINT AS size FROM part")
def csv_codebook(spark, sf_dir):
    """Header, inferred types, renamed columns, unnamed ones dropped, a cut barcode."""
    path = S.work_folder(spark, "codebook")
    _table(spark, sf_dir, "part").select(F.lit(0).alias("Unnamed: 0"), F.col("p_partkey").alias("id"), F.col("p_name").alias("sgRNA"), F.col("p_brand").alias("gene"), F.col("p_size").alias("size")).write.option("header", True).csv(path)
    out = S.read_codebook(spark, path, {"gene": "gene_name"}, offset=2)
    return out.select(F.col("id").cast("long").alias("id"), "sgRNA", "gene_name", F.col("size").cast("long").alias("size"))


@query("SELECT c_custkey::BIGINT AS id, concat('A/', c_nationkey % 3 + 1) AS well, CASE WHEN c_nationkey % 3 = 1 THEN c_mktsegment END AS segment FROM customer")
def csv_parts(spark, sf_dir):
    """One file per well, of which one has a further column."""
    base, c = S.work_folder(spark, "wells"), _table(spark, sf_dir, "customer")
    parts = {f"A/{k + 1}": f"{base}/{k}" for k in range(3)}
    for k, path in enumerate(parts.values()):
        c.where(F.col("c_nationkey") % 3 == k).select(F.col("c_custkey").alias("id"), *[F.col("c_mktsegment").alias("segment")] * (k == 1)).write.option("header", True).csv(path)
    return S.read_parts(spark, parts).select(F.col("id").cast("long").alias("id"), "well", "segment")


@query("SELECT concat('g', p_partkey) AS gene, trim(unnest([p_type, p_brand])) AS category FROM part WHERE p_partkey % 5 > 0")
def tsv_pipe_list(spark, sf_dir):
    path, k = S.work_folder(spark, "categories"), F.col("p_partkey")
    t = _table(spark, sf_dir, "part").select(F.when(k % 5 > 0, F.concat(F.lit("g"), k)).alias("gene_name"), F.concat("p_type", F.lit(" | |"), "p_brand", F.lit("|")).alias("reactome_categories"))
    t.write.option("header", True).option("sep", "\t").csv(path)
    return S.read_categories(spark, path).select("gene", F.explode("categories").alias("category"))


@query("SELECT concat('g', s_suppkey) AS gene, lower(concat_ws(' ', s_name, CASE WHEN s_suppkey % 3 > 0 THEN 'Text, with comma' ELSE '' END)) AS text FROM supplier WHERE s_suppkey % 4 > 0")
def csv_annotations(spark, sf_dir):
    path, k = S.work_folder(spark, "annotations"), F.col("s_suppkey")
    t = _table(spark, sf_dir, "supplier").select(F.when(k % 4 > 0, F.concat(F.lit("g"), k)).alias("name"), F.col("s_name").alias("a"), F.when(k % 3 > 0, "Text, with comma").alias("b"))
    t.write.option("header", True).csv(path)
    return S.read_annotations(spark, path, "name", ["a", "b"])


@query("SELECT concat('r', r_regionkey) AS set_id, r_name AS name, concat('n', n_nationkey) AS gene FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'top', 'component', concat('r', r_regionkey) FROM region")
def yaml_gene_sets(spark, sf_dir):
    path, n = S.work_folder(spark, "sets"), _table(spark, sf_dir, "nation")
    genes = n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("n"), "n_nationkey"))), ", ").alias("genes"))
    line = F.concat(F.lit("r"), "r_regionkey", F.lit(": {name: '"), "r_name", F.lit("', genes: ["), "genes", F.lit("]}"))
    sets = _table(spark, sf_dir, "region").join(genes, F.col("n_regionkey") == F.col("r_regionkey")).select(line.alias("value"))
    top = _table(spark, sf_dir, "region").agg(F.concat(F.lit("top: {components: ["), F.array_join(F.collect_list(F.concat(F.lit("r"), "r_regionkey")), ", "), F.lit("]}")).alias("value"))
    sets.union(top).coalesce(1).write.text(path)
    genes, parts = S.read_gene_sets(spark, path)
    return genes.union(parts.select("set_id", F.lit("component"), "component"))


@query("SELECT concat('ops', lpad(n_nationkey::VARCHAR, 4, '0')) AS experiment, 0 AS pos, 'BF' AS channel_name, 'Phase' AS label FROM nation UNION ALL SELECT concat('ops', lpad(n_nationkey::VARCHAR, 4, '0')), 1, NULL, NULL FROM nation UNION ALL SELECT concat('ops', lpad(n_nationkey::VARCHAR, 4, '0')), 2, 'GFP', n_name FROM nation")
def yaml_channel_map(spark, sf_dir):
    """Entries that are no channels keep NULLs."""
    path, key = S.work_folder(spark, "channels"), F.concat(F.lit("ops"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))
    _table(spark, sf_dir, "nation").select(F.concat(key, F.lit(": [{channel_name: BF, label: Phase}, {cell_painting: {enabled: true}}, {channel_name: GFP, label: '"), "n_name", F.lit("'}]")).alias("value")).coalesce(1).write.text(path)
    return S.read_channel_map(spark, path)


@query("SELECT 'bad' AS category, CASE WHEN n_nationkey % 2 = 0 THEN concat('ops', n_nationkey) END AS name, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey::INT END AS number, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS reason, '20240101' AS cutoff FROM nation")
def yaml_exclusions(spark, sf_dir):
    path, k = S.work_folder(spark, "exclusions"), F.col("n_nationkey")
    entry = F.when(k % 2 == 0, F.concat(F.lit("{name: ops"), k, F.lit(", reason: '"), "n_name", F.lit("'}"))).otherwise(k.cast("string"))
    lines = _table(spark, sf_dir, "nation").agg(F.concat(F.lit("{date_cutoff: 20240101, bad: ["), F.array_join(F.collect_list(entry), ", "), F.lit("], bad_channels: [{number: 3, channel: GFP}]}")).alias("value"))
    lines.coalesce(1).write.text(path)
    rules, _, cutoff = S.read_exclusions(spark, path)
    return rules.withColumn("cutoff", F.lit(cutoff))


@query("SELECT vec_id, label, true AS other_dropped, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 5) AS weighted, (vec_id % 7 = 0)::INT AS n_null FROM embeddings")
def profiles_landing(spark, sf_dir):
    """Profiles in Parquet, a column per feature: the metadata columns that exist, one array of features, NaN as NULL."""
    path, v = S.work_folder(spark, "profiles"), _table(spark, sf_dir, "embeddings")
    n = v.select(F.max(F.size("embedding"))).first()[0] or 0
    wide = v.select("vec_id", "label", F.lit("text").alias("note"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(n)], F.when(F.col("vec_id") % 7 == 0, float("nan")).otherwise(0.0).alias("last"))
    wide.write.parquet(path)
    out = S.read_profiles(spark, path, ["vec_id", "label", "absent"])
    total = F.aggregate(F.transform("features", lambda x, i: F.coalesce(x, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", "label", F.lit(len(out.columns) == 3).alias("other_dropped"), F.round(total, 5).alias("weighted"), F.size(F.filter("features", lambda x: x.isNull())).alias("n_null"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "orders", "lineitem", "events")) + " UNION ALL SELECT 'missing', 0")
def footer_counts(spark, sf_dir):
    return S.count_rows(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("region", "nation", "customer", "orders", "lineitem", "events")} | {"missing": f"{sf_dir}/missing.parquet"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def cached_scan(spark, sf_dir):
    """Built once, then read from the cache: a second builder is never called, and the filter reaches the scan."""
    folder = S.work_folder(spark, "cache")
    S.cached(spark, folder, "orders", "all/of: them", lambda: _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))

    def again():
        raise AssertionError("the cache is fresh")

    return S.cached(spark, folder, "orders", "all/of: them", again, source=f"{folder}/gone", where="o_totalprice > 200000")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stale_cache(spark, sf_dir):
    """A cache older than its source is built again."""
    folder, key = S.work_folder(spark, "cache"), ("events", "by type")
    S.cached(spark, folder, *key, lambda: spark.sql("SELECT 'old' AS event_type, 0L AS n"))
    source = f"{folder}/source"
    jvm = spark._jvm
    _table(spark, sf_dir, "events").select("event_type").write.parquet(source)
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.setTimes(path, fs.getFileStatus(path).getModificationTime() + 60_000, -1)
    return S.cached(spark, folder, *key, lambda: spark.read.parquet(source).groupBy("event_type").agg(F.count("*").alias("n")), source)


@query("SELECT DISTINCT event_type FROM events")
def listing_scan(spark, sf_dir):
    """Folders found by listing files, without reading them."""
    path = S.work_folder(spark, "listing")
    _table(spark, sf_dir, "events").select("event_type", "value").write.partitionBy("event_type").parquet(path)
    found = S.list_files(spark, path, "*.parquet").where("length > 0")
    return found.select(F.url_decode(F.regexp_extract("path", "event_type=([^/]+)/", 1)).alias("event_type")).distinct()


@query("SELECT concat(l_orderkey, '.', l_linenumber) AS job_id, CASE WHEN l_linenumber % 2 = 0 THEN 'COMPLETED' ELSE 'RUNNING' END AS state, CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag END AS node FROM lineitem")
def accounting_scan(spark, sf_dir):
    """Lines parted by pipes, some too short."""
    path, n = S.work_folder(spark, "accounting"), F.col("l_linenumber")
    line = F.concat_ws("|", F.concat("l_orderkey", F.lit("."), n), F.when(n % 2 == 0, "COMPLETED").otherwise("RUNNING"), F.when(n % 3 > 0, F.col("l_returnflag")))
    _table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(path)
    return S.read_accounting(spark, path, ["job_id", "state", "node"])


@query("SELECT r_regionkey, r_name FROM region")
def layered_path(spark, sf_dir):
    """The first folder that exists."""
    return spark.read.parquet(S.first_existing(spark, [f"{sf_dir}/fast/region.parquet", f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet"])).select("r_regionkey", "r_name")


# sinks ---------------------------------------------------------------------------------------------


@query(cte("p_values") + "SELECT brand AS name, count(*) AS n, 'brand' AS sweep FROM p_values GROUP BY brand UNION ALL SELECT p_type, count(*), 'type' FROM part GROUP BY p_type")
def csv_sinks(spark, sf_dir):
    """Result tables as delimited files, and the union of the sweeps read back."""
    base = S.work_folder(spark, "results")
    S.write_csv(read(spark, sf_dir, "p_values").groupBy(F.col("brand").alias("name")).agg(F.count("*").alias("n")), f"{base}/brand")
    S.write_csv(_table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n")), f"{base}/type")
    return S.read_parts(spark, {k: f"{base}/{k}" for k in ("brand", "type")}, "sweep").withColumn("n", F.col("n").cast("long"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def chunked_layout(spark, sf_dir):
    """Range-partitioned, sorted files of a bounded number of rows."""
    path = S.work_folder(spark, "chunked")
    S.write_chunked(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, ["o_custkey"], ["o_orderkey"], 4, 500)
    return spark.read.parquet(path)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '/out/a' ELSE '/out/a/rerun' END AS path FROM customer")
def rerun_paths(spark, sf_dir):
    k = F.col("c_custkey")
    path, mode = F.when(k % 3 == 1, "/out/a/rerun").when(k % 6 == 2, "/out/a/").otherwise("/out/a"), F.when(k % 3 == 0, "production").when(k % 3 == 1, "debug")
    return _table(spark, sf_dir, "customer").select("c_custkey", N.rerun_path(path, mode).alias("path"))


# filters and expressions ---------------------------------------------------------------------------


@query(cte("experiments", "exclusions") + "SELECT DISTINCT name FROM experiments WHERE name NOT LIKE '%_redo' OR name LIKE '%1%'")
def library_filter(spark, sf_dir):
    """Experiments of another library go, unless they are forced in."""
    e = read(spark, sf_dir, "experiments")
    return C.keep_libraries(e, e.where("name LIKE '%\\_redo'"), e.where("name LIKE '%1%'"))


@query(cte("channel_map") + "SELECT experiment, channel_name, label FROM channel_map WHERE channel_name IS NOT NULL")
def channel_entries(spark, sf_dir):
    return C.find_channels(read(spark, sf_dir, "channel_map"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice / (o_orderkey % 10) * (10 - o_orderkey % 10) END AS eta FROM orders")
def eta_estimate(spark, sf_dir):
    done = F.col("o_orderkey") % 10
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.eta_seconds(F.col("o_totalprice"), done, F.lit(10)).alias("eta"))


@query(cte("experiments") + "SELECT name, row_number() OVER (ORDER BY coalesce(try_cast(nullif(regexp_extract(lower(name), '^ops0*(\\d+)', 1), '') AS INT), 9999), name) AS place FROM experiments")
def numeric_sort(spark, sf_dir):
    """Experiments in order of their number; the place is read from the sorted rows."""
    e = read(spark, sf_dir, "experiments").withColumn("n", F.coalesce(N.experiment_number(N.experiment_key("name")), F.lit(9999)))
    return G.numbered(e, ["n", "name"], "place").select("name", "place")


@query("SELECT n_name, ((row_number() OVER (ORDER BY n_nationkey) - 1) % 4)::INT AS row, ((row_number() OVER (ORDER BY n_nationkey) - 1) // 4)::INT AS col FROM nation")
def grid_layout(spark, sf_dir):
    return C.grid_cells(_table(spark, sf_dir, "nation"), ["n_nationkey"], 4).select("n_name", "row", "col")


@query("SELECT p_partkey, round(-log10(greatest(CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 1.0 / p_partkey END, 1e-300)), 6) + 0.0 AS neg_log10_p FROM part")
def p_value_logs(spark, sf_dir):
    p = F.when(F.col("p_partkey") % 9 == 0, 0.0).otherwise(F.lit(1.0) / F.col("p_partkey"))
    return _table(spark, sf_dir, "part").select("p_partkey", _r6(U.neg_log10(p)).alias("neg_log10_p"))


@query("SELECT id, CASE WHEN id % 4 IN (0, 1, 2) THEN 0 ELSE id END::DOUBLE AS zeroed, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1.7976931348623157e308 WHEN 2 THEN -1.7976931348623157e308 ELSE id END::DOUBLE AS clipped, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'infinity' WHEN 2 THEN '-infinity' ELSE id::VARCHAR END::DOUBLE AS nulled FROM (SELECT p_partkey AS id FROM part)")
def nan_cleaning(spark, sf_dir):
    """The three variants: everything odd as zero, infinities as the largest numbers, NaN as NULL."""
    k = F.col("p_partkey")
    v = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("inf")).when(k % 4 == 2, float("-inf")).otherwise(k.cast("double"))
    return _table(spark, sf_dir, "part").select(k.alias("id"), U.finite_or_zero(v).alias("zeroed"), U.nan_to_zero_clipped(v).alias("clipped"), U.nan_to_null(v).alias("nulled"))


@query("WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT label, arg_min(e, vec_id) AS m FROM v GROUP BY label) SELECT vec_id, round(list_cosine_similarity(e, m), 6) + 0.0 AS cosine, round(list_distance(e, m), 6) + 0.0 AS euclidean FROM v JOIN c USING (label)")
def vector_algebra(spark, sf_dir):
    """Cosine and distance of each vector to the first of its label."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", "label", X.doubles("embedding").alias("e"))
    first = v.groupBy("label").agg(F.min_by("e", "vec_id").alias("m"))
    return v.join(first, "label").select("vec_id", _r6(X.cosine("e", "m")).alias("cosine"), _r6(X.euclidean("e", "m")).alias("euclidean"))


@query("SELECT p_partkey AS id, concat(c, b, a, f, e, d) AS mirrored, concat(d, e, f, a, b, c) AS flipped, concat(c, f, b, e, a, d) AS turned FROM (SELECT p_partkey, (p_partkey % 7)::VARCHAR AS a, (p_size % 9)::VARCHAR AS b, 'c' AS c, (p_partkey % 3)::VARCHAR AS d, 'e' AS e, (p_size % 5)::VARCHAR AS f FROM part)")
def tile_flips(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda x: x.cast("string")
    tile = F.array(F.array(text(k % 7), text(s % 9), F.lit("c")), F.array(text(k % 3), F.lit("e"), text(s % 5)))
    flat = lambda t: F.array_join(F.flatten(t), "")
    t = _table(spark, sf_dir, "part").select("p_partkey", "p_size", tile.alias("t"))
    return t.select(k.alias("id"), flat(G.flip(F.col("t"))).alias("mirrored"), flat(G.flip(F.col("t"), True)).alias("flipped"), flat(G.rotate(F.col("t"))).alias("turned"))


@query("""WITH r AS (SELECT p_partkey AS id, p_partkey % 15 AS k FROM part),
    pairs AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS k, (1.0::DOUBLE / i + 2.0::DOUBLE / j) / 2 AS ap FROM range(1, 7) a(i), range(1, 7) b(j) WHERE i < j)
    SELECT id, round((SELECT count(*) FROM pairs q WHERE q.ap >= p.ap - 1e-12) / 15.0::DOUBLE, 2) AS p_value FROM r JOIN pairs p USING (k)""")
def permutation_exact(spark, sf_dir):
    """Two positives among six rows have fifteen rankings, so the exact share of those at least as good is known; a million draws give it to two digits."""
    pairs = [(1 / i + 2 / j) / 2 for i in range(1, 7) for j in range(i + 1, 7)]
    ap = F.element_at(F.array(*map(F.lit, pairs)), (F.col("p_partkey") % 15 + 1).cast("int"))
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ap.alias("average_precision"), ap.alias("normalized_average_precision"), F.lit(2).alias("n_pos_pairs"), F.lit(6).alias("n_total_pairs"))
    return R.with_p_values(rows, ["id"]).select("id", F.round("p_value", 2).alias("p_value"))


@query("WITH s AS (SELECT var_samp(l_quantity::DOUBLE) AS a, var_samp(l_discount::DOUBLE * 100) AS c, covar_samp(l_quantity::DOUBLE, l_discount::DOUBLE * 100) AS b FROM lineitem), e AS (SELECT ((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)) / (a + c) AS r FROM s) SELECT 1 AS component, round(r, 6) AS ratio, round(r, 6) AS cumulative FROM e UNION ALL SELECT 2, round(1 - r, 6), 1.0::DOUBLE FROM e")
def pca_exact(spark, sf_dir):
    """Two features that vary and one that does not: the shares are the roots of a quadratic equation."""
    v = _table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100, F.lit(3.0)).alias("v"))
    return P.explained(spark, P.fit_pca(v, "v", 16)).select("component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))
