"""Readers, caches, the array source and the streaming roll-up."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators.jobs import latest_per_key
from heddle.operators.spatial import label_boxes
from heddle.sources import arrays as Z
from heddle.sources import readers as R
from heddle.streaming.rollups import run_available, windowed_rollup
from tests import array_files


def test_csv_and_parts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Unnamed: 0,barcode,x\n0,ACGTACGTACGTA,1\n")
    (tmp_path / "b.csv").write_text("barcode,y\nTTTT,2.5\n")
    df = R.read_codebook(spark, str(tmp_path / "a.csv"), {"barcode": "sgRNA"}, offset=2)
    assert df.columns == ["sgRNA", "x"] and df.first().sgRNA == "GTACGTACGT"
    both = R.read_parts(spark, {"A/1": str(tmp_path / "a.csv"), "A/2": str(tmp_path / "b.csv")})
    assert {(r.well, r.x, r.y) for r in both.collect()} == {("A/1", 1, None), ("A/2", None, 2.5)}
    with pytest.raises(FileNotFoundError):
        R.read_parts(spark, {})


def test_tables_of_annotations(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("gene_name\tncbi_id\treactome_categories\nG1\t1\ta | |b\n \t2\tx\nG2\t3\t\n")
    assert {r.gene: r.categories for r in R.read_categories(spark, str(tmp_path / "c.tsv")).collect()} == {"G1": ["a", "b"], "G2": []}
    (tmp_path / "d.csv").write_text("Gene.name,p,q\nG1,Abc,\n,x,y\n")
    assert [(r.gene, r.text) for r in R.read_annotations(spark, str(tmp_path / "d.csv"), "`Gene.name`", ["p", "q"]).collect()] == [("G1", "abc ")]


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text("ops0001:\n- {channel_name: BF, label: Phase}\n- cell_painting: {enabled: true}\n")
    assert [tuple(r) for r in R.read_channel_map(spark, str(tmp_path / "m.yaml")).orderBy("pos").collect()] == [("ops0001", 0, "BF", "Phase"), ("ops0001", 1, None, None)]
    assert R.read_channel_map(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "e.yaml").write_text("date_cutoff: 20240101\nbad: [ops0001_20230101, 7, {name: ops2, reason: r}]\nbad_channels: [{name: ops3, channel: GFP}]\n")
    rules, channels, cutoff = R.read_exclusions(spark, str(tmp_path / "e.yaml"))
    assert cutoff == "20240101" and {(r.name, r.number) for r in rules.collect()} == {("ops0001_20230101", None), (None, 7), ("ops2", None)} and channels.count() == 1
    (tmp_path / "g.yaml").write_text("s1: {name: one, genes: [a, b]}\ns2: {components: [s1]}\n")
    genes, parts = R.read_gene_sets(spark, str(tmp_path / "g.yaml"))
    assert genes.count() == 2 and [tuple(r) for r in parts.collect()] == [("s2", "s1")]
    with pytest.raises(FileNotFoundError):
        R.read_gene_sets(spark, str(tmp_path / "none.yaml"))
    (tmp_path / "k.yaml").write_text("super_categories:\n  x: {pathway_keywords: [p], gene_patterns: ['^A']}\n  y: {chad_clusters: [s1]}\n")
    clusters, words, patterns = R.read_category_rules(spark, str(tmp_path / "k.yaml"))
    assert clusters.first().ordinal == 1 and words.first().keyword == "p" and patterns.first().pattern == "^A"
    (tmp_path / "l.yaml").write_text("default: {library: d}\noverrides: {ops1: {library: z}}\n")
    default, over = R.read_library_map(spark, str(tmp_path / "l.yaml"))
    assert default == {"library": "d"} and over.first().library == "z"


def test_listing_counts_and_accounting(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "t.parquet"))
    assert {r.name: r.n for r in R.count_rows(spark, {"t": str(tmp_path / "t.parquet"), "u": str(tmp_path / "none")}).collect()} == {"t": 7, "u": 0}
    assert R.list_files(spark, str(tmp_path), "*.parquet").count() >= 1
    (tmp_path / "acc").write_text("1|a|RUNNING\n1.0|b\n\n")
    assert [tuple(r) for r in R.read_accounting(spark, str(tmp_path / "acc"), ["id", "node", "state"]).collect()] == [("1", "a", "RUNNING"), ("1.0", "b", None)]
    assert R.first_existing(spark, [str(tmp_path / "none"), str(tmp_path)]) == str(tmp_path)


def test_cache_is_rebuilt_when_the_source_is_newer(spark, tmp_path):
    source, calls = tmp_path / "s", []
    source.write_text("1")
    build = lambda: calls.append(1) or spark.range(len(calls))
    get = lambda: R.cached(spark, f"file://{tmp_path}/cache", "n", "a/b: c", build, f"file://{source}").count()
    assert get() == 1 and get() == 1
    time.sleep(1.1)
    source.write_text("2")
    assert get() == 2
    source.unlink()
    assert get() == 2
    assert R.cached(spark, f"file://{tmp_path}/cache", "n", "none", lambda: None) is None


def test_log_keeps_the_last_entry_per_key(spark, tmp_path):
    for k, v in (("a", 1), ("b", 2), ("a", 3)):
        R.append_log(spark.createDataFrame([(k, v)], "log_key string, ord int"), str(tmp_path / "log"))
    assert {(r.log_key, r.ord) for r in latest_per_key(spark.read.parquet(str(tmp_path / "log")), "log_key", "ord").collect()} == {("a", 3), ("b", 2)}


@pytest.mark.parametrize("codec", ["zlib", "gzip", None])
def test_array_chunks(spark, tmp_path, codec):
    values = np.zeros((2, 9, 7), dtype="<i4")
    values[0, 1:3, 2:6], values[0, 8, 6] = 5, 9
    array_files.write_array(str(tmp_path / "img"), values, (1, 4, 4), codec)
    df = Z.read_array(spark, str(tmp_path / "img"), 3)
    assert df.count() == 12
    back = np.zeros_like(values)
    for r in df.collect():
        back[tuple(slice(a, a + n) for a, n in zip(r.start, r.shape, strict=True))] = np.array(r.values if not callable(r.values) else r["values"]).reshape(r.shape)
    assert (back == values).all()
    boxes = label_boxes(Z.pixels(df.where("start[0] = 0")).withColumn("g", F.lit(1)), ["g"], "value").collect()
    assert {(r.value, r.ymin, r.xmin, r.ymax, r.xmax, r.area) for r in boxes} == {(5.0, 1, 2, 3, 6, 8), (9.0, 8, 6, 9, 7, 1)}


def test_streaming_rollup(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(src, tmp_path / "in" / "events.parquet")
    events = spark.read.parquet(src)
    stream = windowed_rollup(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "value", "1 day", "0 seconds")
    run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.start, r.event_type): r.n for r in windowed_rollup(events, "ts", "event_type", "value", "1 day").collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_shards_and_missing_chunks(spark, tmp_path):
    values = np.zeros((10, 13), dtype="<i4")
    values[1:3, 2:6], values[9, 12] = 5, 9
    array_files.write_sharded(str(tmp_path / "s"), values, (8, 8), (4, 2))
    array_files.write_array(str(tmp_path / "e"), values, (4, 4), skip_empty=True)
    for name in ("s", "e"):
        got = {(r.y, r.x): r.value for r in Z.pixels(Z.read_array(spark, str(tmp_path / name), 5)).collect()}
        assert got == {(y, x): float(values[y, x]) for y in range(10) for x in range(13)}


def test_damaged_files_count_nothing(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "part-x.parquet").write_bytes(b"no parquet")
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.parquet").write_bytes(b"no parquet")
    assert {r.name: r.n for r in R.count_rows(spark, {"t": str(tmp_path / "t"), "u": str(tmp_path / "u")}).collect()} == {"t": 7, "u": 0}
