"""Sampling of positions on random plates, caches that survive damage, sub-tasks at any depth, scores with unknown values."""

import math
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from heddle.operators import jobs as J
from heddle.operators import spatial as G
from heddle.operators import summary as S
from heddle.sources import readers as R


def plate(rng):
    """Positions of wells of unequal size; names have leading zeros, prefixes or no digits."""
    out = []
    for well in rng.sample([f"{r}/{c}" for r in "AB" for c in (1, 2, 3, 10)], rng.randint(1, 7)):
        tiles = rng.sample(range(1000), rng.randint(1, 9))
        out += [(well, f"{well}/{rng.choice(['', 'pos', '00'])}{t}") for t in tiles]
        if rng.random() < 0.3:
            out.append((well, f"{well}/x"))
    return out


def by_well(positions):
    wells = {}
    for well, p in positions:
        digits = "".join(c for c in p.rpartition("/")[2] if c.isdigit())
        wells.setdefault(well, []).append((int(digits or 0), p))
    return {w: [p for _, p in sorted(wells[w])] for w in sorted(wells)}


def central(positions, total):
    """Shares around the middles, well after well, cut at the total."""
    wells, out = by_well(positions), []
    base = max(1, total // len(wells))
    for i, tiles in enumerate(wells.values()):
        k = min(len(tiles), base + (i < total - base * len(wells)))
        first = len(tiles) // 2 - k // 2
        out += tiles[first : first + k]
    return out[:total]


def discovered(positions, total):
    """One tile after another, nearest to the middle first, until a well's part or the total is met."""
    wells = by_well(positions)
    names = list(wells)
    if total < len(names):
        first = max(0, len(names) // 2 - total // 2)
        names = names[first : first + total]
    part, out = max(1, math.ceil(total / len(names))), []
    for name in names:
        tiles = wells[name]
        near = sorted(range(len(tiles)), key=lambda i, m=len(tiles) // 2: (abs(i - m), i > m))
        out += [tiles[i] for i in near[: min(part, total - len(out))]]
    return out


def test_samples_on_random_plates(spark):
    rng = random.Random(8)
    for _ in range(6):
        rows = plate(rng)
        df = spark.createDataFrame(rows, "well string, position string")
        for total in rng.sample(range(1, 30), 2):
            assert sorted(r.position for r in G.sample_positions(df, "well", "position", total).collect()) == sorted(central(rows, total))
            assert sorted(r.position for r in G.discover_positions(df, "well", "position", total).collect()) == sorted(discovered(rows, total))
    assert G.sample_positions(df, "well", "position", 0).count() == len(rows) and G.discover_positions(df, "well", "position", 0).count() == 0
    assert G.sample_positions(df.limit(0), "well", "position", 5).count() == 0 and G.discover_positions(df.limit(0), "well", "position", 5).count() == 0


@pytest.mark.parametrize(("n", "k", "want"), [(4, 1, [2]), (6, 3, [2, 3, 4]), (8, 5, [2, 3, 4, 5, 6]), (3, 9, [0, 1, 2]), (5, 2, [1, 2])])
def test_middle_blocks(spark, n, k, want):
    df = spark.range(n).withColumn("g", F.lit("g"))
    assert sorted(r.id for r in G.balanced_sample(df, "g", "id", k).collect()) == want


def test_damaged_snapshots_are_built_again(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(10 * len(calls))
    get = lambda: R.cached(spark, f"file://{tmp_path}/cache", "n", "k", build).count()
    folder = tmp_path / "cache" / "n" / "k.parquet"

    def parts():
        return [f for s in folder.glob("snapshot-*") for f in s.glob("part-*.parquet")]

    assert get() == 10 and get() == 10 and len(calls) == 1
    for f in parts():  # same length, no footer
        f.write_bytes(b"x" * f.stat().st_size)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert get() == 20
    newest = max(folder.glob("snapshot-*"), key=os.path.getmtime)
    for f in newest.glob("part-*.parquet"):
        f.unlink()
    assert get() == 30
    (folder / "current").write_text("{}")
    (folder / ".current.crc").unlink(missing_ok=True)
    with pytest.raises(KeyError):
        get()  # a pointer that was never written by this library is an error, not a silent rebuild


def test_failed_builds_keep_the_last_snapshot(spark, tmp_path):
    at, source = f"file://{tmp_path}/cache", tmp_path / "source"
    source.write_text("1")
    assert R.cached(spark, at, "n", "k", lambda: spark.range(3), f"file://{source}").count() == 3
    held = R.cached(spark, at, "n", "k", lambda: spark.range(9))  # a reader of the first snapshot
    later = os.path.getmtime(tmp_path / "cache" / "n" / "k.parquet" / "current") + 5
    os.utime(source, (later, later))

    def broken():
        return spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))

    out = R.cached(spark, at, "n", "k", broken, f"file://{source}")  # cannot be written: what was built is given back
    with pytest.raises(Exception, match="no"):
        out.collect()
    assert R.cached(spark, at, "n", "k", lambda: None).count() == 3
    assert R.cached(spark, at, "n", "k", lambda: spark.range(4), f"file://{source}").count() == 4
    assert held.count() == 3


def test_readers_never_see_half_a_table(spark, tmp_path):
    at, seen, stop = f"file://{tmp_path}/cache", [], threading.Event()
    R.cached(spark, at, "n", "k", lambda: spark.range(100))
    reader = threading.Thread(target=lambda: [seen.append(R.cached(spark, at, "n", "k", lambda: None).count()) for _ in iter(stop.is_set, True)])
    reader.start()
    store = R._Snapshots(spark, f"{at}/n/k.parquet")
    for n in (200, 300):
        store.publish(spark.range(n))
    stop.set()
    reader.join()
    assert set(seen) <= {100, 200, 300}


def test_tables_that_cannot_be_written_are_returned(spark, tmp_path):
    (tmp_path / "cache").write_text("a file where the folder should be")
    assert R.cached(spark, f"file://{tmp_path}/cache", "n", "k", lambda: spark.range(7)).count() == 7


def test_subtasks_at_any_depth(spark):
    log = [("a_b", "9 seconds", "h"), ("a_b_c", "1.5 seconds", "h1"), ("a_b_c_d", "2 seconds", ""), ("a_b__e", "4", None), ("a_bc_d", "8 seconds", "h2"), ("a_b_f", "about 3 seconds", "h1"), (None, "1 seconds", "h"), ("a_b_c", None, "h0")]
    df = spark.createDataFrame(log, "log_key string, duration string, hostname string").withColumn("gpu_power_avg_w", F.length("log_key") * 1.04)
    out = {r.parent: r for r in J.subtask_rollup(df, spark.createDataFrame([("a_b",), ("a",), ("a_b",), ("zz",), (None,)], "log_key string")).collect()}
    keys = [k for k, *_ in log if k]
    assert {p: r.n for p, r in out.items()} == {p: sum(k.startswith(p + "_") for k in keys) for p in ("a_b", "a")}
    r = out["a_b"]
    assert (r.n, r.total_s, r.mean_s, r.min_s, r.max_s, r.hosts, r.gpu_power_mean) == (5, 7.5, 2.5, 1.5, 4.0, "h0,h1", 5.8)
    assert "gpu_models" not in J.subtask_rollup(df, df).columns
    assert {tuple(r.k) for r in spark.createDataFrame([("_x",), ("x",), ("",), ("a__b",)], "s string").select(J.parent_keys(F.col("s")).alias("k")).collect()} == {("",), (), ("a", "a_")}


def test_scores_leave_out_what_is_unknown(spark):
    for odd in (None, float("nan")):
        g = spark.createDataFrame([(1.0, odd), (0.5, 0.1), (0.5, 0.1)], "s double, p double")
        assert math.isclose(S.weighted_score(g, "s", "p").first().auc_score, 0.5 / 6)
    g = spark.createDataFrame([(1.0, None)] * 3, "s double, p double")
    assert math.isnan(S.weighted_score(g, "s", "p").first().auc_score)


def test_sweeps_equal_counts_for_each_threshold(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, rng.random()]), rng.choice([None, 1.0, 0.0, 10 ** -rng.uniform(0, 8), float("nan")])) for _ in range(200)]
    grid = S.log_grid(spark)
    out = S.threshold_sweep(spark.createDataFrame(rows, "s double, p double"), "s", "p", grid).collect()
    assert len(out) == 100
    for r in out:
        below = [s for s, p in rows if p is not None and p < r.t]
        known = [s for s in below if s is not None]
        assert math.isclose(r.y, len(below) / 200 * (sum(known) / len(known) if known else 0.0), abs_tol=1e-12)
