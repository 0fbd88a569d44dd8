"""Worked examples and invariants of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import boxes as B
from heddle.functions import names as N
from heddle.functions import units as U
from heddle.operators import annotate as A
from heddle.operators import catalog as C
from heddle.operators import profiles as P
from heddle.operators import retrieval as R
from heddle.operators import spatial as G
from heddle.operators import summary as S


def values(spark, expr, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_labels(spark):
    given = ["ER/Golgi, COPE", "ER\\Golgi, COPE", "organelle, MARKER PROTEIN", "A/B\\C", "no label", "", ", MARKER", "multiple   spaces"]
    assert values(spark, N.sanitize_label, given) == ["COPE", "COPE", "MARKER_PROTEIN", "A_B_C", "no_label", "", "MARKER", "multiple___spaces"]
    assert values(spark, N.normalize_channel, ["Phase2D", "Phase3D", "Phase", "GFP", "Cy5"]) == ["BF", "BF", "BF", "GFP", "Cy5"]


MAP = [("ops0031", 0, "BF", "Phase"), ("ops0031", 1, "mCherry", "er, SEC61B"), ("ops0031", 2, "GFP", "5xUPRE"), ("ops0033", 0, "mCherry", "mitochondria, ChromaLive 561 emission"), ("ops0089", 0, "BF", "Phase"), ("ops0089", 1, "GFP", "early endosome, EEA1"), ("ops0031", 3, None, None)]


def test_feature_names(spark):
    m = spark.createDataFrame(MAP, "experiment string, pos int, channel_name string, label string")
    cases = {("ops0031", "single_object_Phase2D_cell_Area"): "single_object_Phase_cell_Area", ("ops0031_20250424", "single_object_mCherry_nucleus_MeanIntensity"): "single_object_SEC61B_nucleus_MeanIntensity", ("ops0031", "coloc_mCherry_GFP_cell_Correlation_Pearson"): "coloc_SEC61B_5xUPRE_cell_Correlation_Pearson", ("ops0031", "label_str"): "label_str", ("ops0033", "single_object_mCherry_cell_Area"): "single_object_ChromaLive_561_emission_cell_Area", ("ops9999", "single_object_GFP_x"): "single_object_GFP_x"}
    out = C.rename_features(spark.createDataFrame(list(cases), "experiment string, feature string"), m).collect()
    assert {(r.experiment, r.feature): r.renamed for r in out} == cases


def test_label_ladder(spark):
    m = spark.createDataFrame(MAP + [("ops0033", 1, "GFP", "no label")], "experiment string, pos int, channel_name string, label string")
    cases = [("ops0089", "GFP", "early endosome, EEA1", "direct"), ("ops0089", "EEA1", "early endosome, EEA1", "reverse_marker"), ("ops0089", "4i:eea1", "early endosome, EEA1 (4i)", "reverse_marker_fuzzy+4i"), ("ops0033", "GFP", "autofluorescence, gfp", "direct_autofluorescence"), ("ops0033", "ChromaLive561emission", "mitochondria, ChromaLive 561 emission", "reverse_marker_collapsed"), ("ops0001", "zz", "(unmapped: zz)", "unresolved"), ("ops0089", "Phase3D", "Phase", "direct")]
    out = C.resolve_labels(spark.createDataFrame([c[:2] for c in cases], "experiment string, channel string"), m, {"4i:": " (4i)"}).collect()
    assert {(r.experiment, r.channel): (r.label, r.method) for r in out} == {c[:2]: c[2:] for c in cases}


def test_durations_and_sizes(spark):
    assert values(spark, U.duration_seconds, ["1-02:34:56", "01:23:45", "junk", None, "10:05.5"]) == [95696.0, 5025.0, 0.0, 0.0, 605.5]
    assert math.isclose(values(spark, U.size_bytes, ["72378M"])[0] / 1024**3, 70.681641, abs_tol=1e-6)
    assert values(spark, U.size_bytes, ["xK", "", None, "12"]) == [0.0, 0.0, 0.0, 12.0]


def test_boxes(spark):
    assert [tuple(v) if v else None for v in values(spark, B.parse_box, ["(10, 20, 30, 40)", "[1 2 3 4]", "(1, 2, 3)", "1 2 3 4", None])] == [(10, 20, 30, 40), (1, 2, 3, 4), None, None, None]
    pad = lambda a: tuple(spark.range(1).select(B.pad_box(B.box(*map(F.lit, a)), 128, 128).alias("b")).first().b)
    assert pad((10, 20, 30, 40)) == (-44, -34, 84, 94)
    assert pad((10, 20, 31, 40))[0::2] == (-43, 84)


def test_tiles(spark):
    i = spark.createDataFrame([(100, 100)], "height int, width int")
    assert {(r.y0, r.y1) for r in G.tiles_by_stride(i, 2, 10).collect()} == {(0, 50), (40, 90)}
    assert {(r.y0, r.y1) for r in G.tiles_with_overlap(i, 2, 10).collect()} == {(0, 60), (40, 100)}


def test_average_precision_of_a_ranking():
    sims = np.array([[4.0, 3, 2, 1]])
    ap = lambda rel: R.rank_rows(sims[:, : len(rel)], np.array([rel], bool), ~np.array([rel], bool))[0]
    assert math.isclose(ap([1, 0, 1, 0]), 0.833333, abs_tol=1e-6)
    assert math.isclose(R.rank_rows(np.array([[5.0, 4, 3, 2, 1]]), np.array([[0, 1, 1, 0, 0]], bool), np.array([[1, 0, 0, 1, 1]], bool))[0], 0.583333, abs_tol=1e-6)
    assert ap([0, 0, 0, 0]) is None and ap([1, 1, 1, 1]) is None


@pytest.fixture(scope="module")
def profiles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 5), int(i % 5 == 0), [float(x) for x in rng.normal(size=6).round(1)]) for i in range(70)]
    rows += [(100, 1, 0, [0.0] * 6), (101, 1, 0, [float("nan"), 1.0, 1.0, 1.0, 1.0, float("inf")]), (102, 77, 0, [1.0] * 6), (103, 2, 0, rows[2][3])]
    return spark.createDataFrame(rows, "id long, label int, control int, v array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_equal_broadcast(profiles, metric):
    c = R.Constraints(pos_same=["label"], neg_differ=["label"])
    a, b = (R.average_precision(profiles, "id", "v", c, ["label"], metric, block_rows=20, broadcast_bytes=n).orderBy("id").collect() for n in (1 << 20, 0))
    assert len(a) == len(b) == 74
    for x, y in zip(a, b, strict=True):
        assert (x.id, x.n_pos_pairs, x.n_total_pairs) == (y.id, y.n_pos_pairs, y.n_total_pairs)
        assert (x.average_precision is None) == (y.average_precision is None)
        assert x.average_precision is None or math.isclose(x.average_precision, y.average_precision, abs_tol=1e-9)
        assert x.average_precision is None or 0 < x.average_precision <= 1 and x.normalized_average_precision <= x.average_precision + 1e-12


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_is_the_same_in_blocks(profiles, metric):
    a, b = (sorted((r.id, r.rank, r.neighbour) for r in R.nearest(profiles, "id", "v", 5, metric, n).collect()) for n in (1000, 9))
    assert a == b and len(a) == 74 * 5 and all(i != j for i, _, j in a)


def test_expanded_groups_without_sets_are_distinctiveness(spark, profiles):
    none = spark.createDataFrame([], "set_id string, member int")
    g = R.expanded_groups(profiles, none, "label")
    a = R.average_precision(g, "id", "v", R.Constraints(pos_same=["group_id"], neg_differ=["group_id"])).orderBy("id").collect()
    b = R.distinctiveness_rows(profiles, "id", "v", "label", "id").select("id", "average_precision").orderBy("id").collect()
    assert [(r.id, r.average_precision) for r in a] == [(r.id, r.average_precision) for r in b]
    twice = spark.createDataFrame([("a", 1), ("b", 1)], "set_id string, member int")
    with pytest.raises(Exception, match="in several sets"):
        R.expanded_groups(profiles, twice, "label").collect()


def test_significance(spark, profiles):
    out = R.score(profiles, "id", "v", R.Constraints(pos_same=["label"], neg_differ=["label"]), ["label"], null_size=2000).collect()
    assert all(0 < r.p_value <= 1 and r.corrected_p_value >= r.p_value - 1e-12 for r in out)
    again = R.score(profiles, "id", "v", R.Constraints(pos_same=["label"], neg_differ=["label"]), ["label"], null_size=2000).collect()
    assert {(r.label, r.p_value) for r in out} == {(r.label, r.p_value) for r in again}
    null = R.null_scores(2, 5, 200_000, 0)
    from itertools import combinations

    exact = np.mean([np.mean([(k + 1) / r for k, r in enumerate(c)]) for c in combinations(range(1, 6), 2)])
    assert abs(null.mean() - exact) < 2e-3
    p = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5), (5, None)], "id int, p_value double")
    assert [r.corrected_p_value for r in R.correct_p_values(p).orderBy("id").collect()] == pytest.approx([0.04, 0.04, 0.04, 0.5, None])


def test_screen(spark, profiles):
    sets = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 4), ("z", 1)], "set_id string, member int")
    rows = profiles.withColumn("guide", F.col("id"))
    out = R.score_screen(rows, rows, sets, sets, "label", "guide", "v", "id", "id", "control", null_size=500)
    assert set(out) == {f"{a}{b}" for a in ("activity", "distinctiveness", "complexes", "clusters") for b in ("", "_ratio")}
    assert out["activity"].count() >= 5 and 0 <= out["distinctiveness_ratio"].first().ratio <= 1
    assert out["complexes"].count() >= 0


def test_weighted_and_swept_scores(spark):
    g = spark.createDataFrame([(0.5, 1e-6), (0.8, 1e-3), (0.2, 1.0)], "s double, p double")
    assert math.isclose(S.weighted_score(g, "s", "p").first().auc_score, 0.3, abs_tol=1e-9)
    assert math.isnan(S.weighted_score(g.limit(2), "s", "p").first().auc_score)
    assert math.isclose(S.trapezoid(S.threshold_sweep(g, "s", "p", S.log_grid(spark)), "x", "y").first().area, 0.299158, abs_tol=1e-6)


def test_zscore_edges(spark):
    df = spark.createDataFrame([(1.0, True), (3.0, True), (5.0, False), (float("nan"), False), (None, False)], "x double, c boolean")
    assert [r.x for r in P.zscore(df, ["x"], F.col("c")).collect()][2] == pytest.approx(2.121320, abs=1e-6)
    assert P.zscore(df.limit(1), ["x"]).first().x is None
    out = [r.x for r in P.zscore(df, ["x"]).collect() if r.x is not None]
    assert abs(np.mean(out)) < 1e-9 and abs(np.std(out, ddof=1) - 1) < 1e-9


def test_components_for_thresholds(spark):
    v = spark.createDataFrame([(0.5,), (0.7,), (0.9,)], "cumulative double")
    out = P.components_for(v, spark.createDataFrame([(0.7,), (0.95,), (0.1,)], "threshold double")).collect()
    assert {r.threshold: r.n_pcs for r in out} == {0.7: 2, 0.95: 3, 0.1: 1}


def test_pca_matches_eigenvalues(spark, profiles):
    clean = profiles.where("id < 70")
    model = P.fit_pca(clean, "v", 5)
    x = np.array([r.v for r in clean.collect()])
    e = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r.ratio for r in P.explained(spark, model).collect()] == pytest.approx((e / e.sum())[:5], abs=1e-6)
    assert P.apply_pca(clean, "v", model).select(F.size("pcs")).first()[0] == 5


def test_closure_with_a_cycle(spark):
    sets = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "set_id string, component string")
    genes = spark.createDataFrame([("b", "g1"), ("c", "g2")], "set_id string, gene string")
    assert {(r.set_id, r.gene) for r in A.closure(sets, genes).collect()} == {(s, g) for s in "abc" for g in ("g1", "g2")}


def test_channel_map_falls_back_to_positions_or_fails(spark):
    t = lambda rows: spark.createDataFrame(rows, "store string, idx int, channel string")
    out = C.channel_index_map(t([("s", 0, "Channel0"), ("s", 1, "Channel1")]), t([("s", 0, "BF"), ("s", 1, "GFP")])).collect()
    assert {(r.channel, r.source_idx) for r in out} == {("BF", 0), ("GFP", 1)}
    with pytest.raises(Exception, match="counts differ"):
        C.channel_index_map(t([("s", 0, "Channel0")]), t([("s", 0, "BF"), ("s", 1, "GFP")])).collect()


def test_tiles_turn(spark):
    r = spark.range(1).select(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))).alias("t")).select(G.rotate(F.col("t")).alias("r"), G.flip(F.col("t")).alias("f"), G.flip(F.col("t"), True).alias("v")).first()
    assert r.r == [[2, 4], [1, 3]] and r.f == [[2, 1], [4, 3]] and r.v == [[3, 4], [1, 2]]


def test_closure_of_a_deep_hierarchy_of_shared_parts(spark):
    """Thirty levels of two sets each, both parts of both above: two to the thirtieth paths, sixty sets."""
    from heddle.operators import annotate as A

    sets = spark.createDataFrame([(f"s{k}{x}", f"s{k + 1}{y}") for k in range(30) for x in "ab" for y in "ab"], "set_id string, component string")
    genes = spark.createDataFrame([("s30a", "g"), ("s30b", "h")], "set_id string, gene string")
    out = A.closure(sets, genes).groupBy("gene").count().collect()
    assert {(r.gene, r["count"]) for r in out} == {("g", 61), ("h", 61)}


def test_names_are_resolved_without_nested_loops(spark, capsys):
    from heddle.operators import catalog as C

    known = spark.createDataFrame([("ops0001_2024",), ("ops0012_2024_x",), ("abc",), (None,), ("b",)], "name string")
    asked = spark.createDataFrame([("12",), ("ops1",), ("abc",), ("24_",), ("x",), ("ops00",), ("",), ("none",), ("bc",), ("4_x",)], "query string")
    out = C.resolve_names(asked, known)
    assert {r.query: r.resolved for r in out.collect()} == {"12": "ops0012_2024_x", "ops1": "ops0001_2024", "abc": "abc", "24_": "ops0012_2024_x", "x": "ops0012_2024_x", "ops00": "ops0001_2024", "": "abc", "none": "none", "bc": "abc", "4_x": "ops0012_2024_x"}


def test_correction_equals_the_definition(spark):
    from heddle.operators import retrieval as R

    rng = __import__("random").Random(3)
    rows = [(i, "ab"[i % 2], rng.choice([0.0, 1e-300, 1e-6, 0.5, 1.0, rng.random(), rng.random() ** 8])) for i in range(400)] + [(900, "a", None), (901, None, 0.01), (902, None, float("nan"))]
    df = spark.createDataFrame(rows, "id int, s string, p double")
    for scope in ((), ("s",)):
        got = {r.id: r.corrected_p_value for r in R.correct_p_values(df, "p", scope).collect()}
        for k in {r[1] for r in rows} if scope else {0}:
            own = sorted((r[2], r[0]) for r in rows if (not scope or r[1] == k) and r[2] is not None and r[2] == r[2])
            low = 1.0
            for rank in range(len(own), 0, -1):
                low = min(low, own[rank - 1][0] * len(own) / rank)
                assert abs(got[own[rank - 1][1]] - low) < 1e-12
        assert got[900] is None and got[902] is None and len(got) == len(rows)


def test_set_consistency_joins_by_key(spark):
    from heddle.operators import retrieval as R

    profiles = spark.createDataFrame([(i, i % 5, [float(i), 1.0]) for i in range(20)], "id long, label int, v array<double>")
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "set_id string, member int")
    plan = R.consistency_rows(profiles, sets, "id", "v", "label")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_distribution_equals_quantiles(spark):
    import math

    import numpy as np

    rng = np.random.default_rng(8)
    inf, nan = float("inf"), float("nan")
    a = [None, nan, 0.0, -0.0, 1e-320, -5e-324, 1e300, -1e200, 8.0, 7.999999999999999, *rng.normal(0, 3, 300).tolist(), *[2.5] * 60]
    b = [-v if v is not None else None for v in rng.integers(-3, 9, len(a)).astype(float).tolist()]
    df = spark.createDataFrame([(x, y, None, 4.0 if i == 3 else None, inf if i % 2 else -inf) for i, (x, y) in enumerate(zip(a, b))], "a double, b double, none double, one double, ends double")
    got = {r.metric: r for r in S.distribution(df, df.columns).collect()}
    for name, values in (("a", a), ("b", b), ("one", [4.0])):
        own = [v for v in values if v is not None and not math.isnan(v)]
        r = got[name]
        assert r.n == len(own) and np.allclose([r.mean, r.q1, r.median, r.q3], [math.fsum(own) / len(own), *np.quantile(own, [0.25, 0.5, 0.75])])
    assert tuple(got["none"]) == ("none", 0, None, None, None, None) and (got["ends"].q1, got["ends"].q3) == (-inf, inf)
    assert S.distribution(df.where("false"), ["a"]).count() == 0


def test_octaves_never_fall(spark):
    from pyspark.sql import functions as F

    from heddle.functions.units import octave

    edges = [x for e in range(-1074, 1024, 7) for x in (2.0**e, 2.0**e * 1.5, 2.0**e * (2 - 2**-52))]
    values = sorted({*edges, *(-x for x in edges), 0.0, 1e308, float("inf"), float("-inf")})
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(octave(F.col("x"))).collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("coalesce", ["false", "true"])
def test_mean_curve_equals_interpolation(spark, coalesce):
    """Against NumPy's interpolation, in several ranges and in one, with one long series, repeated, unknown and NULL values."""
    rng = np.random.default_rng(5)
    rows = [("long", float(x), float(y)) for x, y in zip(rng.choice(1000, 60, replace=False) / 7 + 1e6, rng.normal(size=60), strict=True)]
    rows += [(s, float(x) / 7 + 1e6, float(y)) for s in "abc" for x, y in zip(rng.integers(0, 1000, 5), rng.normal(size=5), strict=True)]
    rows += [("one", 1e6 + 3, 2.0), ("one", 1e6 + 3, 4.0), ("gap", 1e6 + 1, None), ("gap", 1e6 + 2, float("nan")), (None, 1e6 + 5, 9.0), ("a", None, 1.0), ("a", float("inf"), 1.0), ("b", 1e6 + 4, float("inf"))]
    points = spark.createDataFrame(rows, "series string, x double, y double")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, coalesce)
    try:
        out = {r.x: (r.y, r.n) for r in S.mean_curve(points, "series", "x", "y").collect()}
    finally:
        spark.conf.set(key, before)
    known = {}
    for s, x, y in rows:
        if s is not None and x is not None and np.isfinite(x) and y is not None and np.isfinite(y):
            known.setdefault(s, {}).setdefault(x, []).append(y)
    union = sorted({x for _, x, _ in rows if x is not None and np.isfinite(x)})
    want = np.mean([np.interp(union, sorted(k), [np.mean(k[x]) for x in sorted(k)]) for k in known.values()], axis=0)
    assert sorted(out) == union and {n for _, n in out.values()} == {len(known)}
    assert np.allclose([out[x][0] for x in union], want, atol=1e-7)


@pytest.mark.parametrize("block", [1, 7, 256])
def test_steep_series_leave_no_error_behind(spark, block):
    """Steps of next to no width beside series that reach far: the sum of slopes would lose all digits."""
    rng = np.random.default_rng(12)
    rows = []
    for s in range(41):
        at = float(rng.uniform(0, 1000))
        width = float(10 ** -rng.uniform(11, 13.5)) * max(at, 1)
        rows += [(s, 0.0, float(rng.random())), (s, at, 0.0), (s, at + width, 1.0), (s, 1000.0, float(rng.random()))]
    points = spark.createDataFrame(rows, "series int, x double, y double")
    xs = sorted({r[1] for r in rows})
    by = {s: sorted((x, y) for t, x, y in rows if t == s) for s in range(41)}
    want = np.mean([np.interp(xs, *zip(*by[s], strict=True)) for s in by], axis=0)
    got = {r.x: (r.y, r.n) for r in S.mean_curve(points, "series", "x", "y", block).collect()}
    assert sorted(got) == xs and all(abs(got[x][0] - w) < 1e-9 and got[x][1] == 41 for x, w in zip(xs, want, strict=True))


def test_mean_curve_without_known_values(spark):
    points = spark.createDataFrame([("a", 1.0, None)], "series string, x double, y double")
    assert [tuple(r) for r in S.mean_curve(points, "series", "x", "y").collect()] == [(1.0, None, 0)]
    assert S.mean_curve(points.where("x > 1"), "series", "x", "y").collect() == []


def test_codes_and_grids_number_all_rows(spark):
    rows = spark.createDataFrame([(f"g{i % 40:02d}" if i % 7 else None,) for i in range(300)], "name string")
    names = sorted({r.name or "NTC" for r in rows.collect()})
    assert {r.name: r.code for r in G.label_codes(rows, "name").collect()} == {n: i for i, n in enumerate(names)}
    panels = spark.range(11).withColumnRenamed("id", "k")
    assert {(r.k, r.row, r.col) for r in C.grid_cells(panels, ["k"], 4).collect()} == {(k, k % 4, k // 4) for k in range(11)}


def test_null_sets_are_equally_likely_on_both_sides():
    from collections import Counter
    from itertools import combinations

    for k in (2, 4):
        seen = Counter(map(tuple, R._random_ranks(np.random.default_rng(k), 60_000, k, 6).tolist()))
        sets = list(combinations(range(1, 7), k))
        assert set(seen) == set(sets)
        assert max(abs(n - 60_000 / len(sets)) for n in seen.values()) < 5 * (60_000 / len(sets)) ** 0.5


def test_parts_of_a_null_add_up(spark, monkeypatch):
    """The number of draws is exact when the null is no multiple of a part, and parts differ."""
    from pyspark.sql import Row

    ap = spark.createDataFrame([Row(g=g, average_precision=a, normalized_average_precision=a, n_pos_pairs=2, n_total_pairs=7) for g, a in [("x", 1.0), ("y", 0.0), (None, 0.4)]])
    monkeypatch.setattr(R, "NULL_PART", 400)
    R.null_scores.cache_clear()
    out = {r.g: r.p_value for r in R.with_p_values(ap, ["g"], 1000).collect()}
    R.null_scores.cache_clear()
    null = np.concatenate([R.null_scores(2, 7, n, R.SEED, part) for part, n in enumerate((400, 400, 200))])
    assert out == {g: pytest.approx((1 + int((null >= a - 1e-12).sum())) / 1001) for g, a in [("x", 1.0), ("y", 0.0), (None, 0.4)]}
    assert out["y"] == 1.0 and not np.array_equal(null[:400], null[400:800])


@pytest.mark.parametrize(("n", "h", "w", "side"), [(4, 8, 6, 2), (9, 9, 12, 3), (1, 5, 7, 1), (8, 8, 8, None), (4, 7, 8, None), (9, 9, 10, None)])
def test_grids_must_fit(spark, n, h, w, side):
    df = spark.createDataFrame([(n, h, w)], "n int, h int, w int").select(G.subtile_grid(F.col("n"), F.col("h"), F.col("w")).alias("s"))
    if side is None:
        with pytest.raises(Exception, match="square number|does not divide"):
            df.collect()
    else:
        assert df.first().s == side
