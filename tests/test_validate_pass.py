"""Every check raises its row and, on a clean table, does not; each column is read once."""

import math
import re

import pytest
from pyspark.sql import functions as F

from heddle.operators.validate_pass import Checks, experiment_verdicts, unassigned_issues, validate_table

NAN, INF = float("nan"), float("inf")
SCHEMA = "cell_id string, well string, gene_id int, gene string, guide string, x double, y double, box_a int, box_b int, v array<double>"
CLEAN = [(f"c{i}", "A/1", -1 if i % 15 == 0 else i, "NTC" if i % 15 == 0 else f"g{i % 4}", f"s{i % 6}", float(i), 1.0, 1, 1, [float(i), 0.5 * i, float(i % 7), -float(i), float(i * i)] * 4) for i in range(60)]


def checks(**more):
    base = dict(level="cell", expected={"cell_id": "string", "x": "number"}, critical=["cell_id", "well"], key="cell_id", features="v", n_features=20, misplaced="network_", pair=(F.col("box_a").isNotNull(), F.col("box_b").isNotNull()), complete={"well drift": ["x", "y"]}, control=("gene_id", None, "gene"), guide="guide", gene="gene", guides=6, genes=4)
    return Checks(**(base | more))


def raised(df, **more):
    return {(r.severity, r.check_name, r.subject): (r.n, r.pct) for r in validate_table(df, checks(**more)).collect()}


@pytest.fixture(scope="module")
def clean(spark):
    return spark.createDataFrame(CLEAN, SCHEMA)


def altered(spark, change):
    return spark.createDataFrame([change(i, dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r, strict=True))) for i, r in enumerate(CLEAN)], SCHEMA)


def test_a_clean_table_raises_nothing_and_is_read_once(spark, clean, tmp_path, capsys):
    assert raised(clean) == {}
    clean.write.parquet(f"{tmp_path}/t")
    validate_table(spark.read.parquet(f"{tmp_path}/t"), checks()).explain("formatted")
    read = [c.split(":")[0] for part in re.findall(r"ReadSchema: struct<(.*)>", capsys.readouterr().out) for c in part.split(",")]
    assert sorted(read) == sorted(set(read)) == sorted(c.split()[0] for c in SCHEMA.split(", "))


def put(**values):
    return lambda i, r: tuple({**r, **{k: v(i, r) for k, v in values.items()}}[c.split()[0]] for c in SCHEMA.split(", "))


@pytest.mark.parametrize(("change", "row", "n"), [
    (dict(well=lambda i, r: None if i < 3 else "A/1"), ("issue", "nulls", "well"), 3),
    (dict(cell_id=lambda i, r: f"c{i // 2}"), ("issue", "duplicates", "cell_id"), 30),
    (dict(v=lambda i, r: [NAN, *r["v"][1:]]), ("issue", "quality", "missing_features"), 1),
    (dict(v=lambda i, r: [INF if i < 2 else 1.0 * i, *r["v"][1:]]), ("issue", "quality", "infinite_values"), 2),
    (dict(v=lambda i, r: [0.0] * 3 + r["v"][3:]), ("issue", "quality", "zero_features"), 3),
    (dict(v=lambda i, r: [0.0, NAN if i % 2 else 0.0] + r["v"][2:]), ("warning", "quality", "zero_features"), 2),
    (dict(v=lambda i, r: [4.0, 4.0 if i % 2 else None] + r["v"][2:]), ("issue", "quality", "constant_features"), 2),
    (dict(v=lambda i, r: [4.0] + r["v"][1:]), ("warning", "quality", "constant_features"), 1),
    (dict(box_a=lambda i, r: None if i < 7 else 1), ("issue", "dual_coverage", "both"), 53),
    (dict(box_a=lambda i, r: None if i < 1 else 1, box_b=lambda i, r: None if i < 1 else 1), ("issue", "dual_coverage", "neither"), 1),
    (dict(y=lambda i, r: None), ("warning", "all_null", "well drift: y"), 1),
    (dict(y=lambda i, r: 1.0 if i < 29 else None), ("warning", "incomplete", "well drift"), 29),
    (dict(gene_id=lambda i, r: 5, gene=lambda i, r: "g1"), ("warning", "controls", "none"), 0),
    (dict(gene_id=lambda i, r: -1 if i < 13 else 5), ("warning", "controls", "many"), None),
    (dict(guide=lambda i, r: f"s{i % 7}"), ("issue", "library_size", "guides"), 7),
    (dict(gene=lambda i, r: "NTC" if i % 15 == 0 else f"g{i % 5}"), ("issue", "library_size", "genes"), 6),
])
def test_each_check_raises_its_row(spark, change, row, n):
    out = raised(altered(spark, put(**change)))
    assert row in out and (n is None or out[row][0] == n)


def test_rows_that_concern_the_schema(spark, clean):
    odd = clean.withColumn("network_a", F.lit(1.0)).withColumn("x", F.col("x").cast("string")).drop("guide", "y")
    assert set(raised(odd, expected={"x": "number", "none": "string"})) == {("issue", "missing_column", "none"), ("issue", "wrong_type", "x"), ("issue", "misplaced_columns", "network_a"), ("issue", "missing_column", "guide"), ("warning", "missing_column", "well drift: y")}
    assert raised(clean.drop("gene"), gene=None)[("warning", "missing_column", "gene")][0] == 1


def test_edges(spark, clean):
    assert raised(clean, genes=3) == {("issue", "library_size", "genes"): (5, 100 * 5 / 3)}
    few = altered(spark, put(gene_id=lambda i, r: 5, gene=lambda i, r: f"g{i % 4}"))
    many = few.crossJoin(spark.range(3)).withColumn("cell_id", F.concat("cell_id", F.lit("-"), "id")).drop("id").withColumn("gene_id", F.when(F.col("cell_id") == "c1-1", -1).otherwise(5))
    assert {k: v[0] for k, v in raised(many).items()} == {("warning", "controls", "few"): 1}
    assert raised(clean.limit(0)) == {("warning", "controls", "none"): (0, None)}
    holes = clean.withColumn("v", F.when(F.col("x") > 3, F.col("v")))  # rows without features say nothing about them
    assert raised(holes) == {}
    assert validate_table(clean, Checks("gene")).collect() == []
    assert all(r.pct is None or math.isfinite(r.pct) for r in validate_table(clean.limit(0), checks()).collect())


def test_verdicts_of_experiments(spark):
    present = spark.createDataFrame([("e1", lv) for lv in ("cell", "guide", "gene")] + [("e2", "cell"), ("e2", "gene")], "experiment string, level string")
    issues = spark.createDataFrame([("e1", "cell", "warning"), ("e2", "gene", "issue"), ("e2", "gene", "warning")], "experiment string, level string, severity string")
    out = {(r.experiment, r.level): (r.n_issues, r.n_warnings, r.passed) for r in experiment_verdicts(issues, present).collect()}
    assert out == {("e1", "cell"): (0, 1, True), ("e1", "guide"): (0, 0, True), ("e1", "gene"): (0, 0, True), ("e1", "all"): (0, 1, True), ("e2", "cell"): (0, 0, True), ("e2", "guide"): (1, 0, False), ("e2", "gene"): (1, 1, False), ("e2", "all"): (2, 1, False)}
    features = spark.createDataFrame([("f", "nucleus"), ("g", None)], "feature string, organelle string")
    assert [(r.check_name, r.n, r.pct) for r in unassigned_issues(features, "cell", "organelle").collect()] == [("unassigned_features", 1, 50.0)]
    assert unassigned_issues(features.where("organelle IS NOT NULL"), "cell", "organelle").collect() == []
