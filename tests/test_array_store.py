"""Stored arrays: slices open only the chunks they meet, the sink leaves no torn files, other layouts and levels hold the same values, probes agree with full scans."""

import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.sources import arrays as Z
from tests import array_files


def cells_of(spark, values):
    axes = list(Z.AXES[-values.ndim :])
    rows = [(*map(int, at), float(values[at])) for at in zip(*np.nonzero(values), strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{a} int" for a in axes) + ", value double"), axes


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        at = tuple(r)[:-1]
        assert np.isnan(out[at])
        out[at] = r.value
    return out


def sparse(shape, seed, dtype="<i4", share=0.1):
    rng = np.random.default_rng(seed)
    return (rng.integers(1, 90, shape) * (rng.random(shape) < share)).astype(dtype)


@pytest.mark.parametrize(("chunks", "shards", "codec", "dtype"), [((3, 4), None, "gzip", "<i4"), ((2, 3), (6, 6), None, "<f8"), ((5, 2), (20, 40), "zstd", "<u2"), ((40, 40), None, "zlib", "<i8")])
def test_written_cells_are_read_back(spark, tmp_path, chunks, shards, codec, dtype):
    if codec == "zstd":
        pytest.importorskip("zstandard")
    values = sparse((13, 11), 1, dtype)
    cells, axes = cells_of(spark, values)
    path = f"file://{tmp_path}/a"
    Z.write_cells(cells, path, Z.layout(values.shape, chunks, dtype, shards, codec), axes)
    assert (dense(Z.read_cells(spark, path, 3), values.shape) == values).all()
    assert (dense(Z.pixels(Z.read_array(spark, path, 3)), values.shape) == values).all()
    assert not os.path.exists(tmp_path / "a" / ".work")
    with pytest.raises(Exception, match="holds an array already"):
        Z.write_cells(cells, path, Z.layout(values.shape, chunks, dtype), axes)


def test_odd_cells(spark, tmp_path):
    lay = Z.layout((4, 4), (2, 2), "<i4", fill=7)
    rows = spark.createDataFrame([(0, 0, 1, "a"), (0, 0, 5, "b"), (3, 3, None, "c")], "y int, x int, value int, tile string")
    Z.write_cells(rows, f"{tmp_path}/a", lay, ["y", "x"])
    want = np.full((4, 4), 7.0)
    want[0, 0] = 5  # the largest of equal places; a null value is the fill value
    assert (dense(Z.read_cells(spark, f"{tmp_path}/a"), (4, 4)) == want).all()
    Z.write_cells(rows.limit(0), f"{tmp_path}/none", lay, ["y", "x"])
    assert (dense(Z.read_cells(spark, f"{tmp_path}/none"), (4, 4)) == 7).all() and Z.read_blocks(spark, f"{tmp_path}/none").count() == 0
    for bad in ((4, 0), (-1, 0), (None, 0)):
        with pytest.raises(Exception, match="outside the shape"):
            Z.write_cells(spark.createDataFrame([(*bad, 1)], "y int, x int, value int"), f"{tmp_path}/bad{bad[0]}", lay, ["y", "x"])
        assert not os.path.exists(tmp_path / f"bad{bad[0]}" / "zarr.json")
        with pytest.raises(FileNotFoundError):
            Z.layout_of(f"{tmp_path}/bad{bad[0]}")
    with pytest.raises(ValueError, match="whole chunks"):
        Z.layout((4, 4), (2, 2), "<i4", (3, 4))


def test_a_lost_task_leaves_no_torn_file(tmp_path):
    """A task that ends in the middle leaves whole chunks or none; another attempt writes the same array; without a commit there is no array."""
    lay = Z.layout((6, 4), (2, 4), "<i4", codec=None)
    batch = lambda tile: pa.record_batch([pa.array([tile] * 8), pa.array(range(8)), pa.array(range(1, 9))], names=["tile", "at", "value"])
    sink = Z.ArraySink(f"file://{tmp_path}/a", lay)

    def lost():
        yield batch(0)
        yield batch(1)
        raise RuntimeError("the executor is gone")

    with pytest.raises(RuntimeError):
        sink.write(lost())
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "a") for f in names]
    assert [os.path.relpath(f, tmp_path / "a") for f in files] == ["c/0/0"] and os.path.getsize(files[0]) == 32
    with pytest.raises(FileNotFoundError):
        Z.layout_of(f"{tmp_path}/a")
    done = sink.write(iter([batch(0), batch(1), batch(2)]))
    assert (done.files, done.bytes) == (3, 96)
    sink.commit([done])
    array = Z.StoredArray(f"{tmp_path}/a")
    assert [array.stored((k, 0)).sum() for k in range(3)] == [36, 36, 36] and sorted(os.listdir(tmp_path / "a")) == ["c", "zarr.json"]


@pytest.mark.parametrize("shards", [None, (8, 8)])
def test_slices_open_only_what_they_meet(spark, tmp_path, shards):
    """Every chunk file outside the box is damaged, so a scan that opened one would fail."""
    values = sparse((3, 32, 24), 2) + 1
    cells, axes = cells_of(spark, values)
    path = f"{tmp_path}/a"
    lay = Z.layout(values.shape, (1, 4, 4), "<i4", shards and (1, *shards))
    Z.write_cells(cells, path, lay, axes)
    met = {(1, y, x) for y in range(9, 18) for x in (5, 6, 7)}
    files = {tuple(a // t for a, t in zip(at, lay.tile, strict=True)) for at in met}
    for tile in itertools.product(*map(range, lay.grid)):
        if tile not in files:
            (tmp_path / "a" / lay.name(tile)).write_bytes(b"damaged")
    box = (F.col("z") == 1) & (F.col("y") > 8) & (F.col("y") <= 17) & F.col("x").between(5, 7)
    got = {(r.z, r.y, r.x): r.value for r in Z.read_cells(spark, path).where(box).collect()}
    assert got == {at: float(values[at]) for at in met}
    odd = Z.read_cells(spark, path).where(box & F.col("x").isin(5, 7) & (F.col("value") > 1))
    assert {(r.z, r.y, r.x) for r in odd.collect()} == {at for at in met if at[2] != 6 and values[at] > 1}
    for nothing in (F.col("y") > 99, F.col("y") < 0, (F.col("y") > 5) & (F.col("y") < 6), F.col("x").isNull()):
        assert Z.read_cells(spark, path).where(nothing).collect() == []
    with pytest.raises(Exception, match="."):
        Z.read_cells(spark, path).where("z = 0").collect()


def test_chunks_opened_in_shards_are_counted(spark, tmp_path):
    values = sparse((16, 16), 4) + 1
    cells, axes = cells_of(spark, values)
    Z.write_cells(cells, f"{tmp_path}/a", Z.layout(values.shape, (4, 4), "<i4", (16, 16), None), axes)
    array = Z.StoredArray(f"{tmp_path}/a")
    assert list(array.chunks_of((0, 0), [3, 5], [5, 8])) == [(0, 1), (1, 1)]
    for chunk in array.chunks_of((0, 0), [3, 5], [5, 8]):
        array.stored(chunk)
    assert (array.opened, array.read_bytes) == (2, 128)


@pytest.mark.parametrize("shape", [(13, 11), (2, 9, 10)])
def test_resharding_reads_each_chunk_once(spark, tmp_path, shape):
    values = sparse(shape, 5, share=0.05)
    lead = (1,) * (len(shape) - 2)
    array_files.write_array(f"{tmp_path}/v2", values, (*lead, 2, shape[-1]), skip_empty=True)
    array_files.write_sharded(f"{tmp_path}/v3", values, (*lead, 8, 8), (*lead, 4, 2))
    for source in ("v2", "v3"):
        written = Z.read_blocks(spark, f"{tmp_path}/{source}")
        assert written.count() == written.select("chunk").distinct().count()
        for k, (chunks, shards) in enumerate((((3, 4), (6, 8)), ((5, 5), None), ((1, 40), (99, 40)))):
            target = f"{tmp_path}/{source}-{k}"
            lay = Z.reshard(spark, f"{tmp_path}/{source}", target, (*lead, *chunks), shards and (*lead, *shards))
            assert Z.layout_of(target) == lay
            assert (dense(Z.read_cells(spark, target), shape) == values).all()


def test_resharding_scans_its_source_once(spark, tmp_path, capsys):
    array_files.write_array(f"{tmp_path}/a", sparse((8, 8), 1), (2, 8))
    pieces = Z.read_blocks(spark, f"{tmp_path}/a")
    pieces.explain()
    assert capsys.readouterr().out.count("BatchScan") == 1


@pytest.mark.parametrize(("shape", "factor"), [((13, 11), 2), ((2, 3, 9, 5), 3), ((1, 40), 2)])
def test_levels_equal_means(spark, tmp_path, shape, factor):
    values = sparse(shape, 6, "<f8", 0.4)
    cells, axes = cells_of(spark, values)
    lead = (1,) * (len(shape) - 2)
    Z.write_cells(cells, f"{tmp_path}/g/0", Z.layout(shape, (*lead, 4, 5), "<f8"), axes)
    rows = Z.pyramid(spark, f"{tmp_path}/g/0", 4, factor).collect()
    for level in (1, 2, 3):
        small = Z.level_shape(shape, level, factor)
        want, n = np.zeros(small), np.zeros(small)
        for at in np.ndindex(*shape):
            to = (*at[:-2], *(min(a // factor**level, s - 1) for a, s in zip(at[-2:], small[-2:], strict=True)))
            want[to] += values[at]
            n[to] += 1
        got = np.zeros(small)
        for r in rows:
            if r.level == level:
                got[tuple(r)[1:-1]] = r.value
        assert np.allclose(got, want / n)
    Z.write_pyramid(spark, f"file://{tmp_path}/g", 3, (*lead, 2, 2), f"file://{tmp_path}/levels", factor)
    for level in (1, 2):
        held = {tuple(r)[1:-1]: r.value for r in rows if r.level == level}
        for r in Z.read_cells(spark, f"{tmp_path}/g/{level}").collect():
            assert abs(r.value - held.get(tuple(r)[:-1], 0.0)) < 1e-9
    scales = [d["coordinateTransformations"][0]["scale"] for d in Z.read_attributes(f"{tmp_path}/g")["ome"]["multiscales"][0]["datasets"]]
    assert [s[-1] for s in scales] == [1.0, factor, factor**2] and all(x == 1.0 for s in scales for x in s[:-2])


def test_fill_values_count_in_levels(spark, tmp_path):
    values = np.full((6, 6), 5.0)
    values[0, 0] = 9
    rows = spark.createDataFrame([(0, 0, 9.0)], "y int, x int, value double")
    Z.write_cells(rows, f"{tmp_path}/a", Z.layout((6, 6), (2, 2), "<f8", fill=5), ["y", "x"])
    assert {(r.level, r.y, r.x): r.value for r in Z.pyramid(spark, f"{tmp_path}/a", 3).collect()} == {(1, 0, 0): 6.0, (2, 0, 0): 5 + 4 / 36}


def test_probes_agree_with_full_scans(spark, tmp_path):
    """Planted values inside and outside the planned windows, in arrays of both versions; no more chunks are opened than the windows meet."""
    rng, paths, want = random.Random(4), [], {}
    for k in range(12):
        values = np.zeros((2, 3, 1, 60, 45), dtype="<i4")
        for _ in range(k % 5):
            values[rng.randrange(2), rng.randrange(3), 0, rng.randrange(60), rng.randrange(45)] = 1
        path = f"{tmp_path}/p{k}"
        (array_files.write_sharded(path, values, (1, 1, 1, 16, 16), (1, 1, 1, 8, 8)) if k % 2 else array_files.write_array(path, values, (1, 1, 1, 7, 9), skip_empty=True))
        paths.append((path, k % 3))
        for kind, over in (("grid", "c"), ("corner", "t"), ("centre", "c")):
            size = 6
            windows = Z.probe_windows(kind, 60, 45, size)
            assert len(windows) == {"grid": 25, "corner": 1, "centre": 1}[kind] and all(y1 - y0 <= size and x1 - x0 <= size for y0, y1, x0, x1 in windows)
            for place in range(3 if over == "c" else 2):
                plane = values[0, place, 0] if over == "c" else values[place, 0, 0]
                want[path, kind, place] = any(plane[a:b, c:d].any() for a, b, c, d in windows)
    arrays = spark.createDataFrame([*paths, (f"{tmp_path}/none", 0)], "path string, level int")
    assert any(want.values()) and not all(want.values())
    for kind, over in (("grid", "c"), ("corner", "t"), ("centre", "c")):
        got = Z.probe_arrays(arrays, kind, over, 6).collect()
        assert {(r.path, kind, r.place): r.has_data for r in got if r.found} == {k: v for k, v in want.items() if k[1] == kind}
        assert [(r.path, r.place, r.has_data) for r in got if not r.found] == [(f"{tmp_path}/none", None, False)]
        assert max(r.opened for r in got) <= {"grid": 100, "corner": 4, "centre": 4}[kind]
    assert {r.place for r in Z.probe_arrays(arrays, "corner", "t", skip=[0]).collect() if r.found} == {1}
    full = spark.createDataFrame([(f"{tmp_path}/full", 0)], "path string, level int")
    array_files.write_array(f"{tmp_path}/full", np.ones((1, 2, 1, 60, 45), dtype="<i4"), (1, 1, 1, 7, 9))
    assert [(r.has_data, r.opened) for r in Z.probe_arrays(full).collect()] == [(True, 1), (True, 1)]
    states = {r.path: r.state for r in Z.store_states(Z.probe_arrays(arrays.union(full), "grid", "c", 60)).collect()}
    assert states[f"{tmp_path}/none"] == "missing" and states[f"{tmp_path}/p0"] == "empty" and states[f"{tmp_path}/full"] == "complete"
    seen = {p: [np.any(dense_plane) for dense_plane in planes] for p, planes in ((p, [want[p, "grid", c] for c in range(3)]) for p, _ in paths)}
    assert set(states.values()) <= {"missing", "empty", "partial", "complete"} and len(seen) == 12


def test_tasks_of_a_scan_go_by_cells(spark, tmp_path):
    """Before, a task read eight chunks however small: 125 tasks here, 17,600 for nine million rows. Whole results come in few batches."""
    path = f"{tmp_path}/strips"
    Z.write_cells(spark.range(64_000).selectExpr("id AS y", "id % 8 AS x", "id % 90 + 1 AS value"), path, Z.layout((64_000, 8), (64, 8), "<i4"), ["y", "x"])
    cells = Z.read_cells(spark, path)
    assert cells.rdd.getNumPartitions() == 4 and Z.read_cells(spark, path, 8).rdd.getNumPartitions() == 125
    found = cells.where("value > 0").selectExpr("count(*)", "sum(value)", "sum(int(x = y % 8 AND value = y % 90 + 1))").first()
    assert tuple(found) == (64_000, sum(i % 90 + 1 for i in range(64_000)), 64_000) and cells.count() == 512_000
    batches = list(Z._CellReader({"path": path}).read(Z._CellReader({"path": path}).partitions()[0]))
    assert len(batches) == 8 and sum(b.num_rows for b in batches) == Z.TASK_CELLS
