"""Every registered query against its reference SQL on the smallest tables, and the contract of the entry module."""

from collections import Counter

import pytest

from heddle.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    out = catalog.queries()[name](spark, SF)
    rows = out.collect()
    assert len(set(out.columns)) == len(out.columns)
    if name not in catalog.oracle_sql():
        assert rows
        return
    found = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in rows) == sorted(map(repr, found.fetchall()))


CHANNEL_QUERIES = ["feature_rename", "label_ladder", "channels_by_organelle", "bad_channels"]


@pytest.mark.parametrize("name", CHANNEL_QUERIES)
def test_channel_maps_are_made_of_all_parts(spark, tmp_path, name):
    """No part is left out, experiments beyond the first fifty rename features, and names beyond 9,999 experiments stay apart."""
    duckdb = pytest.importorskip("duckdb")
    con, n = duckdb.connect(), 30_400
    con.execute(f"COPY (SELECT range AS p_partkey, 'blue ' || range % 7 AS p_name, CASE range % 4 WHEN 0 THEN 'ECONOMY' ELSE 'PROMO' END AS p_type, 'Brand#' || range % 5 AS p_brand FROM range({n})) TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT range AS l_orderkey, range % 6 AS l_linenumber FROM range(3000)) TO '{tmp_path}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    out = catalog.queries()[name](spark, str(tmp_path))
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    rows = out.collect()
    assert sorted(repr(tuple(r[c] for c in names)) for r in rows) == sorted(map(repr, found.fetchall()))
    if name == "bad_channels":
        assert len(rows) == n and max(Counter(r.experiment for r in rows).values()) == 3
        assert {r.pos: r.bad for r in rows} == {i: (i % 4 == 0 and i % 3 == 1) or (i % 4 == 0 and i % 3 == 2) or (i in (7, 57, 107) and i % 3 == 1 and i % 10 < 9) or (i in (12, 62, 112) and i % 3 == 0 and i % 10 < 9) for i in range(n)}
    elif name == "feature_rename":
        assert any(r.experiment[3:7] >= "0050" and r.renamed != r.feature for r in rows)
    else:
        experiments = {r.experiment for r in rows}
        assert (name == "channels_by_organelle" or "ops9998" in experiments) and any(e.startswith("lot") for e in experiments) and len(experiments) > n / 20


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
