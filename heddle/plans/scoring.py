"""Queries of retrieval scoring, profile preparation and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators import density as DE
from heddle.operators import neighbour_graph as NG
from heddle.operators import profiles as P
from heddle.operators import retrieval as R
from heddle.operators import summary as S
from heddle.plans.inputs import cte, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "vectors")


def _ap_sql(pos: str, neg: str, rows: str = "vectors", keys: str = "a.label AS g") -> str:
    return f""", v AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {rows}),
    pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, {keys}, ({pos}) AS pos, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE ({pos}) OR ({neg})),
    ranked AS (SELECT i, g, pos, row_number() OVER w AS rk, sum(pos::INT) OVER (PARTITION BY i, g ORDER BY s DESC, j ROWS UNBOUNDED PRECEDING) AS tp FROM pairs WINDOW w AS (PARTITION BY i, g ORDER BY s DESC, j)),
    ap AS (SELECT i, g, sum(CASE WHEN pos THEN tp / rk::DOUBLE END) / sum(pos::INT) AS ap, sum(pos::INT) AS n_pos, count(*) AS n_total FROM ranked GROUP BY i, g HAVING sum(pos::INT) > 0 AND sum(pos::INT) < count(*)),
    nap AS (SELECT *, (ap - n_pos / n_total::DOUBLE) / (1 - n_pos / n_total::DOUBLE) AS nap FROM ap) """


_MAP = "SELECT g AS {0}, round(avg(ap), 6) AS mean_average_precision, round(avg(nap), 6) AS mean_normalized_average_precision, count(*) AS n_rows FROM nap GROUP BY g"


def _means(ap: DataFrame, by: str) -> DataFrame:
    return R.mean_average_precision(ap, [by]).select(by, r6("mean_average_precision"), r6("mean_normalized_average_precision"), "n_rows")


@query(cte("vectors") + _ap_sql("a.label = b.label", "a.label <> b.label") + _MAP.format("label"))
def map_distinctiveness(spark, sf_dir):
    return _means(R.distinctiveness_rows(_vectors(spark, sf_dir), "vec_id", "embedding", "label", "vec_id"), "label")


@query(cte("vectors") + _ap_sql("a.label = b.label", "a.is_control <> b.is_control") + _MAP.format("label"))
def map_activity(spark, sf_dir):
    return _means(R.activity_rows(_vectors(spark, sf_dir), "vec_id", "embedding", "label", "vec_id", "is_control"), "label")


@query(cte("vectors") + _ap_sql("a.label = b.label", "a.label <> b.label") + "SELECT v.vec_id, v.label, round(ap, 6) AS average_precision, round(nap, 6) AS normalized_average_precision, coalesce(n_pos, 0)::BIGINT AS n_pos_pairs, coalesce(n_total, 0)::BIGINT AS n_total_pairs FROM v LEFT JOIN nap ON i = vec_id")
def ap_rows(spark, sf_dir):
    ap = R.distinctiveness_rows(_vectors(spark, sf_dir), "vec_id", "embedding", "label", "vec_id")
    return ap.select("vec_id", "label", r6("average_precision"), r6("normalized_average_precision"), "n_pos_pairs", "n_total_pairs")


@query(cte("vectors") + ", g AS (SELECT *, CASE WHEN label < 6 THEN concat('c', label % 3) ELSE label::VARCHAR END AS grp FROM vectors)" + _ap_sql("a.grp = b.grp", "a.grp <> b.grp", "g", "a.grp AS g") + _MAP.format("group_id"))
def map_group_expanded(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    sets = v.where("label < 6").select(F.concat(F.lit("c"), F.col("label") % 3).alias("set_id"), F.col("label").alias("member")).distinct()
    rows = R.expanded_groups(v, sets, "label")
    return _means(R.average_precision(rows, "vec_id", "embedding", R.Constraints(pos_same=["group_id"], neg_differ=["group_id"]), keep=["group_id"]), "group_id")


@query(cte("vectors") + """, v AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vectors),
    pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label % 3 AS g, b.label % 3 = a.label % 3 AS pos, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id AND (b.label % 3 <> a.label % 3 OR b.label <> a.label)),
    ranked AS (SELECT i, g, pos, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rk, sum(pos::INT) OVER (PARTITION BY i ORDER BY s DESC, j ROWS UNBOUNDED PRECEDING) AS tp FROM pairs),
    nap AS (SELECT *, (ap - n_pos / n_total::DOUBLE) / (1 - n_pos / n_total::DOUBLE) AS nap FROM (SELECT i, g, sum(CASE WHEN pos THEN tp / rk::DOUBLE END) / sum(pos::INT) AS ap, sum(pos::INT) AS n_pos, count(*) AS n_total FROM ranked GROUP BY i, g HAVING sum(pos::INT) > 0 AND sum(pos::INT) < count(*)))
    """ + _MAP.format("set_id"))
def map_complex_sets(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    sets = v.select((F.col("label") % 3).alias("set_id"), F.col("label").alias("member")).distinct()
    return _means(R.consistency_rows(v, sets, "vec_id", "embedding", "label"), "set_id")


_CATEGORY_SQL = cte("vectors") + """, m AS (SELECT DISTINCT unnest([label % 2, label % 3 + 10]) AS c, label AS member FROM vectors), c AS (SELECT c FROM m GROUP BY c HAVING count(*) >= 3), mm AS (SELECT m.* FROM m JOIN c USING (c)),
    v AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vectors),
    pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, mm.c AS g, n.member IS NOT NULL AS pos, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN mm ON mm.member = a.label JOIN v b ON a.vec_id <> b.vec_id LEFT JOIN mm n ON n.c = mm.c AND n.member = b.label WHERE n.member IS NULL OR b.label <> a.label),
    ranked AS (SELECT i, g, pos, row_number() OVER (PARTITION BY i, g ORDER BY s DESC, j) AS rk, sum(pos::INT) OVER (PARTITION BY i, g ORDER BY s DESC, j ROWS UNBOUNDED PRECEDING) AS tp FROM pairs),
    nap AS (SELECT *, (ap - n_pos / n_total::DOUBLE) / (1 - n_pos / n_total::DOUBLE) AS nap FROM (SELECT i, g, sum(CASE WHEN pos THEN tp / rk::DOUBLE END) / sum(pos::INT) AS ap, sum(pos::INT) AS n_pos, count(*) AS n_total FROM ranked GROUP BY i, g HAVING sum(pos::INT) > 0 AND sum(pos::INT) < count(*)))
    """ + _MAP.format("set_id")


@query(_CATEGORY_SQL)
def map_category_multi(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    genes = v.select(F.col("label").alias("gene")).distinct().withColumn("categories", F.array(F.col("gene") % 2, F.col("gene") % 3 + 10))
    return _means(R.consistency_rows(v, R.category_membership(genes), "vec_id", "embedding", "label"), "set_id")


@query(cte("vectors") + """, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vectors)
    SELECT id, neighbour, rank::INT AS rank FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS rank FROM v a JOIN v b ON a.vec_id <> b.vec_id) WHERE rank <= 15""")
def nearest_neighbours(spark, sf_dir):
    """The number of neighbours is the feature."""
    return R.nearest(_vectors(spark, sf_dir), "vec_id", "embedding").select("id", "neighbour", "rank")


@query()
def neighbour_graph(spark, sf_dir):
    """Weighted edges of the approximate neighbours: an index, so no SQL; see ``neighbour_recall``."""
    return NG.neighbour_graph(_vectors(spark, sf_dir), "vec_id", "embedding")


@query("SELECT count(*) * least(15, count(*) - 1) AS n_pairs, true AS enough FROM embeddings")
def neighbour_recall(spark, sf_dir):
    """Exact neighbours of all rows, and whether the approximate ones hold at least nine in ten of them."""
    v = _vectors(spark, sf_dir)
    exact = R.nearest(v, "vec_id", "embedding").select("id", "neighbour")
    found = NG.approximate_neighbours(v, "vec_id", "embedding").select("id", "neighbour", F.lit(1).alias("hit"))
    return exact.join(found, ["id", "neighbour"], "left").agg(F.count("*").alias("n_pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part),
    s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, sqrt(var_samp(x)) AS a, covar_samp(x, y) / sqrt(var_samp(x)) AS b, var_samp(y) AS vy, pow(count(*)::DOUBLE, -1.0::DOUBLE / 6) AS h FROM p),
    t AS (SELECT *, sqrt(vy - b * b) AS d FROM s), q AS (SELECT id, (x - mx) / (a * h) AS u, y - my AS v, b, d, h FROM p, t), z AS (SELECT id, u, (v - u * (b * h)) / (d * h) AS w FROM q),
    c AS (SELECT floor(u / 4) AS su, floor(w / 4) AS sw, count(*) AS n, avg(u) AS u, avg(w) AS w FROM z GROUP BY floor(u / 4), floor(w / 4), floor(u / 0.125), floor(w / 0.125))
    SELECT id, round(sum(c.n * exp(-((z.u - c.u) ** 2 + (z.w - c.w) ** 2) / 2)) / any_value(2 * pi() * t.n * a * d * h * h) * 1e6, 3) AS density FROM z, c, t WHERE abs(floor(z.u / 4) - su) <= 1 AND abs(floor(z.w / 4) - sw) <= 1 GROUP BY id""")
def kernel_density(spark, sf_dir):
    """Density (a million times) of the parts by size and price."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    return DE.density(p).select("id", F.round(F.col("density") * 1e6, 3).alias("density"))


@query()
def map_screen(spark, sf_dir):
    """Ratios of significant groups of a whole screen: permutation p-values are seeded draws, so no SQL."""
    v = _vectors(spark, sf_dir).withColumn("guide", F.col("vec_id"))
    sets = v.select((F.col("label") % 3).alias("set_id"), F.col("label").alias("member")).distinct()
    out = R.score_screen(v, v, sets, sets, "label", "guide", "embedding", "vec_id", "vec_id", "is_control")
    parts = [d.select(F.lit(k).alias("metric"), "*") for k, d in out.items() if k.endswith("_ratio")]
    return reduce(DataFrame.unionByName, parts)


@query()
def map_pvalue_perm(spark, sf_dir):
    """Permutation p-values are seeded draws: no SQL."""
    v = _vectors(spark, sf_dir)
    return R.score(v, "vec_id", "embedding", R.Constraints(pos_same=["label"], neg_differ=["label"]), ["label"], null_size=R.NULL_SIZE)


_BH = """, q AS (SELECT *, p::DOUBLE * count(*) OVER (PARTITION BY {0}) / row_number() OVER (PARTITION BY {0} ORDER BY p) AS q FROM p_values),
    bh AS (SELECT *, least(1.0::DOUBLE, min(q) OVER (PARTITION BY {0} ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS corrected FROM q) """


@query(cte("p_values") + _BH.format("1") + "SELECT id, round(corrected, 6) AS corrected_p_value, corrected < 0.05 AS below_corrected_p, round(-log10(greatest(corrected, 1e-300)), 6) + 0.0 AS neg_log10_p FROM bh")
def bh_correction(spark, sf_dir):
    return R.correct_p_values(read(spark, sf_dir, "p_values").withColumn("p", F.col("p").cast("double")), "p").select("id", r6("corrected_p_value"), "below_corrected_p", (F.round("neg_log10_p", 6) + F.lit(0.0)).alias("neg_log10_p"))


@query(cte("p_values") + _BH.format("brand") + "SELECT brand, round(avg((corrected < 0.4)::INT), 6) AS ratio, count(*) AS n_groups FROM bh GROUP BY brand")
def significant_ratio(spark, sf_dir):
    c = R.correct_p_values(read(spark, sf_dir, "p_values").withColumn("p", F.col("p").cast("double")), "p", ["brand"], 0.4)
    return c.groupBy("brand").agg(F.round(F.avg(F.col("below_corrected_p").cast("double")), 6).alias("ratio"), F.count("*").alias("n_groups"))


@query(cte("p_values") + """, v AS (SELECT id, brand, CASE WHEN id % 13 = 0 THEN NULL ELSE score::DOUBLE END AS score, CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN NULL ELSE p::DOUBLE END AS p FROM p_values UNION ALL SELECT p_partkey, concat('few', p_partkey % 40000), 1.0, 0.5 FROM part WHERE p_partkey % 4 = 1)
    SELECT brand, round(CASE WHEN count(*) < 3 THEN 'NaN'::DOUBLE ELSE coalesce(sum(score * -log10(greatest(least(p, 1.0), 1e-6)) / 6.0) / nullif(count(*) FILTER (score IS NOT NULL AND p IS NOT NULL), 0), 'NaN'::DOUBLE) END, 6) AS auc_score FROM v GROUP BY brand""")
def auc_score(spark, sf_dir):
    """Some p are NULL, some NaN, some scores NULL: means are over what is known. Brands of a single row have no score."""
    v, k = read(spark, sf_dir, "p_values"), F.col("id")
    p = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("p").cast("double"))
    v = v.select("brand", F.when(k % 13 > 0, F.col("score").cast("double")).alias("score"), p.alias("p"))
    few = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 4 = 1").select(F.concat(F.lit("few"), F.col("p_partkey") % 40000), F.lit(1.0), F.lit(0.5))
    return S.weighted_score(v.union(few), "score", "p", by=("brand",)).select("brand", r6("auc_score"))


@query(cte("p_values") + """, g AS (SELECT k * (6.0::DOUBLE / 99) AS x, pow(10.0::DOUBLE, -(k * (6.0::DOUBLE / 99))) AS t FROM range(100) r(k)),
    c AS (SELECT x, count(*) FILTER (p::DOUBLE < t) / count(*)::DOUBLE * coalesce(avg(score::DOUBLE) FILTER (p::DOUBLE < t), 0.0) AS y FROM p_values, g GROUP BY x),
    s AS (SELECT x, y, lag(x) OVER (ORDER BY x) AS lx, lag(y) OVER (ORDER BY x) AS ly FROM c)
    SELECT round(sum((x - lx) * (y + ly) / 2) / max(x), 6) AS area FROM s""")
def threshold_sweep_auc(spark, sf_dir):
    v = read(spark, sf_dir, "p_values").withColumn("p", F.col("p").cast("double")).withColumn("score", F.col("score").cast("double"))
    return S.trapezoid(S.threshold_sweep(v, "score", "p", S.log_grid(spark)), "x", "y").select(r6("area"))


_Z = ["quantity", "price", "discount", "tax", "constant"]


def _z_sql(where: str) -> str:
    a = ", ".join(f"avg({c}::DOUBLE) FILTER ({where}) AS a_{c}, CASE WHEN stddev_samp({c}::DOUBLE) FILTER ({where}) = 0 THEN 1 ELSE stddev_samp({c}::DOUBLE) FILTER ({where}) END AS s_{c}" for c in _Z)
    return cte("wide") + f", s AS (SELECT {a} FROM wide) SELECT part, " + ", ".join(f"round(({c}::DOUBLE - a_{c}) / s_{c}, 5) + 0.0 AS {c}" for c in _Z) + " FROM wide, s"


def _z(spark, sf_dir, control):
    out = P.zscore(read(spark, sf_dir, "wide"), _Z, control)
    return out.select("part", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in _Z])


@query(_z_sql("true"))
def zscore_global(spark, sf_dir):
    return _z(spark, sf_dir, None)


@query(_z_sql("brand = 'Brand#1'"))
def zscore_control(spark, sf_dir):
    return _z(spark, sf_dir, F.col("brand") == "Brand#1")


@query(_z_sql("true"))
def zscore_control_fallback(spark, sf_dir):
    """No control row at all: the global statistics are used."""
    return _z(spark, sf_dir, F.col("brand") == "no such brand")


@query(cte("wide") + "SELECT part, round(quantity, 5) AS f1, round(tax, 5) AS f2, 2::INT AS n FROM wide")
def drop_zero_variance(spark, sf_dir):
    w = read(spark, sf_dir, "wide").select("part", F.array("quantity", F.col("constant").cast("double"), "tax", F.lit(0.0)).alias("v"))
    out = P.drop_constant(w, "v")
    return out.select("part", F.round(F.get("v", F.lit(0)), 5).alias("f1"), F.round(F.get("v", F.lit(1)), 5).alias("f2"), F.size("v").alias("n"))


@query("SELECT 66::BIGINT AS n_features, 0::BIGINT AS n_all_missing, 0::BIGINT AS n_with_inf, 1::BIGINT AS n_zero, (SELECT count(*) FROM (SELECT i, var_pop(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY i) WHERE v = 0)::BIGINT + 1 AS n_constant, false AS zero_issue, false AS constant_issue")
def feature_quality(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(0.0), F.lit(1.0))).alias("v"))
    return P.feature_quality(v, "v")


@query()
def pca_variance(spark, sf_dir):
    return P.explained(spark, P.fit_pca(_vectors(spark, sf_dir), "embedding", 16)).select("component", r6("ratio"), r6("cumulative"))


@query("WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), v AS (SELECT round(sum(n) OVER (ORDER BY n DESC, p_brand) / (SELECT count(*) FROM part)::DOUBLE, 9) AS c FROM b) SELECT t AS threshold, least(sum((c < t)::INT) + 1, count(*))::BIGINT AS n_pcs FROM (VALUES (0.05::DOUBLE), (0.35::DOUBLE), (0.95::DOUBLE), (1.5::DOUBLE)) g(t), v GROUP BY t")
def pcs_for_threshold(spark, sf_dir):
    """Cumulative shares of the brands in all parts, the largest first."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    brands = part.groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    variance = brands.select(F.round(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "p_brand")) / F.col("total"), 9).alias("cumulative"))
    grid = spark.createDataFrame([(0.05,), (0.35,), (0.95,), (1.5,)], "threshold double")
    return P.components_for(variance, grid)


@query(cte("curves") + """, g AS (SELECT x, series FROM (SELECT DISTINCT x FROM curves), (SELECT DISTINCT series FROM curves)),
    n AS (SELECT g.x, g.series, c.y, (SELECT max(x) FROM curves l WHERE l.series = g.series AND l.x <= g.x) AS lx, (SELECT min(x) FROM curves r WHERE r.series = g.series AND r.x >= g.x) AS rx FROM g LEFT JOIN curves c ON c.series = g.series AND c.x = g.x),
    v AS (SELECT n.x, CASE WHEN lx IS NULL THEN r.y WHEN rx IS NULL OR lx = rx THEN l.y ELSE l.y + (r.y - l.y) * (n.x - lx) / (rx - lx) END AS v FROM n LEFT JOIN curves l ON l.series = n.series AND l.x = lx LEFT JOIN curves r ON r.series = n.series AND r.x = rx)
    SELECT x, round(avg(v), 4) AS y, count(v) AS n FROM v GROUP BY x""")
def curve_interpolate(spark, sf_dir):
    return S.mean_curve(read(spark, sf_dir, "curves"), "series", "x", "y").select("x", F.round("y", 4).alias("y"), "n")


@query("SELECT m AS metric, count(v) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3 FROM (SELECT 'l_quantity' AS m, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY m")
def distribution_summary(spark, sf_dir):
    d = S.distribution(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_discount", "l_tax"])
    return d.select("metric", "n", *[F.round(c, 4).alias(c) for c in ("mean", "q1", "median", "q3")])


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE NOT regexp_matches(p_name, '(?i)ntc|non-targeting') ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50")
def top_ranked(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    from heddle.functions.names import is_control_anywhere

    return S.top_rows(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_retailprice"), "p_retailprice", 50, "p_partkey", is_control_anywhere("p_name"))


@query(cte("quality") + "SELECT quality, count(*) AS n FROM quality GROUP BY quality")
def value_counts(spark, sf_dir):
    return S.value_counts(read(spark, sf_dir, "quality"), "quality")


@query(cte("experiments") + "SELECT name, CASE WHEN len(e) > 2 THEN concat(len(e), 'ops_exps_sig') ELSE concat(array_to_string(e, '_'), '_sig') END AS label FROM (SELECT name, CASE WHEN name LIKE '%1%' THEN [name, 'b', 'c'] ELSE [name, 'b'] END AS e FROM experiments)")
def channel_ranking_label(spark, sf_dir):
    e = read(spark, sf_dir, "experiments")
    joined = F.when(F.col("name").contains("1"), F.concat("name", F.lit(", b,c"))).otherwise(F.concat("name", F.lit(",b")))
    return e.select("name", S.channel_label(joined, F.lit("sig")).alias("label"))
