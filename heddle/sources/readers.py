"""Readers: delimited text with renames, partition columns, configuration files, listings, footer counts, caches, logs."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.names import parse_pipes, safe_key
from heddle.functions.units import nan_to_null

log = logging.getLogger(__name__)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, rename: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """Delimited text with a header. Columns named ``Unnamed:...`` or starting with ``_c`` are dropped, the others renamed by the map; without a schema types are inferred."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df = df.drop(*[c for c in df.columns if c.startswith("Unnamed:") or (c.startswith("_c") and c[2:].isdigit())])
    return df.withColumnsRenamed({k: v for k, v in (rename or {}).items() if k in df.columns})


def read_codebook(spark: SparkSession, path: str, rename: dict[str, str] | None = None, offset: int = 0, column: str = "sgRNA", length: int = 10) -> DataFrame:
    """Codebook with an optional cut of its barcode column: ``length`` characters from ``offset``, only if the offset is not zero and the column exists."""
    df = read_csv(spark, path, rename=rename)
    return df.withColumn(column, F.substring(column, offset + 1, length)) if offset and column in df.columns else df


def read_parts(spark: SparkSession, parts: dict[str, str], column: str = "well", sep: str = ",") -> DataFrame:
    """Several files with a literal column that names each; columns may differ. No file at all is an error."""
    if not parts:
        raise FileNotFoundError("no files to read")
    out = None
    for name, path in parts.items():
        df = read_csv(spark, path, sep=sep).withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_categories(spark: SparkSession, path: str, key: str = "gene_name", column: str = "reactome_categories") -> DataFrame:
    """(gene, categories) of a tab-separated file with a pipe list; blank keys are skipped."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    return df.where(F.trim(key) != "").select(F.col(key).alias("gene"), parse_pipes(column).alias("categories"))


def read_annotations(spark: SparkSession, path: str, key: str, texts: list[str]) -> DataFrame:
    """(gene, text): the text columns joined by a space in lower case, blank keys skipped."""
    df = spark.read.option("header", True).csv(path)
    return df.where(F.trim(key) != "").select(F.col(key).alias("gene"), F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in texts])).alias("text"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Only a local master goes without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _load_yaml(spark: SparkSession, path: str, required: bool) -> Any:
    """A configuration file (or a folder with its parts) in any file system Spark knows."""
    import yaml

    if first_existing(spark, [path]) is None:
        if required:
            raise FileNotFoundError(path)
        return None
    return yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def read_channel_map(spark: SparkSession, path: str) -> DataFrame:
    """(experiment, pos, channel_name, label) of a channel map; entries that are no channels keep NULLs, a missing file is empty."""
    rows = [(str(k), i, (e or {}).get("channel_name") if isinstance(e, dict) else None, (e or {}).get("label") if isinstance(e, dict) else None) for k, v in (_load_yaml(spark, path, False) or {}).items() for i, e in enumerate(v or [])]
    return spark.createDataFrame(rows, "experiment string, pos int, channel_name string, label string")


def read_exclusions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str | None]:
    """Rules (category, name, number, reason), bad channels (name, number, channel, marker, reason) and the cut-off date. An entry is a name, a number, or a mapping of either with a reason."""
    data = _load_yaml(spark, path, False) or {}
    rules, channels = [], []
    for category, entries in data.items():
        if category == "bad_channels":
            channels += [(str(e["name"]) if "name" in e else None, int(e["number"]) if "number" in e else None, e.get("channel"), e.get("marker"), e.get("reason")) for e in entries or []]
        elif isinstance(entries, list):
            for e in entries:
                e = e if isinstance(e, dict) else {"number": e} if isinstance(e, int) else {"name": e}
                rules.append((category, str(e["name"]) if e.get("name") is not None else None, int(e["number"]) if e.get("number") is not None else None, e.get("reason")))
    cutoff = data.get("date_cutoff")
    return spark.createDataFrame(rules, "category string, name string, number int, reason string"), spark.createDataFrame(channels, "name string, number int, channel string, marker string, reason string"), None if cutoff is None else str(cutoff)


def read_library_map(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """Defaults and the overrides by experiment."""
    data = _load_yaml(spark, path, False) or {}
    fields = ["project", "library", "codebook", "gene_index", "tag"]
    rows = [(str(k), *[None if v.get(f) is None else str(v[f]) for f in fields]) for k, v in (data.get("overrides") or {}).items()]
    return {k: str(v) for k, v in (data.get("default") or {}).items()}, spark.createDataFrame(rows, "experiment string, " + ", ".join(f"{f} string" for f in fields))


def read_gene_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(set_id, name, gene) and (set_id, component) of a hierarchy; the file must exist."""
    genes, parts = [], []
    for k, v in (_load_yaml(spark, path, True) or {}).items():
        genes += [(str(k), str(v.get("name", k)), str(g)) for g in v.get("genes") or []]
        parts += [(str(k), str(c)) for c in v.get("components") or []]
    return spark.createDataFrame(genes, "set_id string, name string, gene string"), spark.createDataFrame(parts, "set_id string, component string")


def read_category_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters (category, ordinal, set_id), keywords (category, ordinal, keyword) and patterns (category, ordinal, pattern) in the order of the file."""
    data = (_load_yaml(spark, path, True) or {}).get("super_categories") or {}
    out: tuple[list, list, list] = ([], [], [])
    for i, (name, v) in enumerate(data.items()):
        for rows, field in zip(out, ("chad_clusters", "pathway_keywords", "gene_patterns"), strict=True):
            rows += [(str(name), i, str(x)) for x in (v or {}).get(field) or []]
    return tuple(spark.createDataFrame(r, f"category string, ordinal int, {c} string") for r, c in zip(out, ("set_id", "keyword", "pattern"), strict=True))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of all files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", "length", F.col("modificationTime").alias("modified"))


def count_rows(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, n) of Parquet tables, counted in one job that reads no column. Damaged files count zero, as do tables that are missing or have no readable file; other errors are raised."""
    counts = None
    for name, path in paths.items():
        try:
            table = spark.read.option("ignoreCorruptFiles", True).parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            one = spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("n"))
        else:
            one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.union(one)
    return spark.createDataFrame([], "name string, n bigint") if counts is None else counts


def read_accounting(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Scheduler rows parted by pipes, all columns text; short lines are filled with NULL."""
    parts = F.split("value", r"\|")
    return spark.read.text(path).where("trim(value) <> ''").select(*[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(fields)])


def read_profiles(spark: SparkSession, path: str, meta: list[str], features: list[str] | None = None) -> DataFrame:
    """Wide Parquet profiles as metadata columns (those that exist) and one array of the feature columns, NaN as NULL."""
    df = spark.read.parquet(path)
    names = features or [f.name for f in df.schema if f.name not in meta and f.dataType.simpleString() in ("float", "double", "int", "bigint")]
    return df.select(*[c for c in meta if c in df.columns], F.array(*[nan_to_null(F.col(f"`{c}`")) for c in names]).alias("features"))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """First path that exists, in any file system Spark knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


class _Snapshots:
    """Snapshots of one cached table: folders of their own, and a file that names the current one and the lengths of its files."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark._jvm
        self.spark, self.folder, self.fs_of = spark, folder, jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.fs_of.Path(f"{self.folder}/{name}" if name else self.folder)

    def modified(self) -> int | None:
        """When the current snapshot was published; None if there is none."""
        return self.fs.getFileStatus(self.path("current")).getModificationTime() if self.fs.exists(self.path("current")) else None

    def _files(self, name: str) -> list[list]:
        return sorted([f.getPath().getName(), f.getLen()] for f in self.fs.listStatus(self.path(name)) if f.getPath().getName().startswith("part-"))

    def load(self) -> DataFrame:
        """The current snapshot. A file that is gone, has another length or cannot be opened raises an error."""
        current = json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/current").collect()))
        if self._files(current["snapshot"]) != current["files"]:
            raise ValueError("the snapshot's files have changed")
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/{current['snapshot']}")  # opens all footers

    def publish(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as a new snapshot, make it the current one by one rename, and remove those before the last."""
        name = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        out, rename = self.fs.create(self.path(f"new-{name}")), self.fs_of.Options.Rename
        out.write(bytearray(json.dumps({"snapshot": name, "files": self._files(name)}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        old = self.modified() is not None and json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/current").collect())).get("snapshot")
        self.fs_of.FileContext.getFileContext(self.path().toUri(), self.conf).rename(self.path(f"new-{name}"), self.path("current"), options)
        for f in self.fs.listStatus(self.path()):
            if f.getPath().getName().startswith("snapshot-") and f.getPath().getName() not in (name, old):
                self.fs.delete(f.getPath(), True)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def cached(spark: SparkSession, folder: str, namespace: str, key: str, build: Callable[[], DataFrame | None], source: str | None = None, where: str | None = None) -> DataFrame | None:
    """Cache of what ``build`` gives, as snapshots: fresh if it is not older than the source, or the source is gone. Nothing is cached for None; a filter is pushed to the scan.

    A new table is written in a folder of its own and published by one rename, so readers see the old one or the new one, and a failed build keeps the old one. One snapshot before the
    current one stays for those who still read it. A damaged snapshot counts as none. If a table cannot be written, it is returned as it was built.
    """
    name = spark.range(1).select(safe_key(F.lit(key)).alias("k")).first().k
    store = _Snapshots(spark, f"{folder.rstrip('/')}/{namespace}/{name}.parquet")
    at, out = store.modified(), None
    if at is not None and source is not None:
        src = store.fs_of.Path(source)
        sfs = src.getFileSystem(store.conf)
        at = at if not sfs.exists(src) or at >= sfs.getFileStatus(src).getModificationTime() else None
    if at is not None:
        try:
            out = store.load()
        except (Py4JJavaError, PySparkException, ValueError) as e:
            log.warning("cache of %s/%s cannot be read, it is built again: %s", namespace, key, str(e).partition("\n")[0])
    if out is None:
        out = build()
        if out is None:
            return None
        try:
            out = store.publish(out)
        except (Py4JJavaError, PySparkException) as e:
            log.warning("cache of %s/%s cannot be written: %s", namespace, key, str(e).partition("\n")[0])
    return out.where(where) if where else out


def write_csv(df: DataFrame, path: str) -> None:
    """One delimited file with a header, for results of a few rows per group."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append entries; ``operators.jobs.latest_per_key`` reads the log as last written, so no writer ever rewrites another's file."""
    df.write.mode("append").parquet(path)


def write_chunked(df: DataFrame, path: str, keys: list[str], order: list[str], partitions: int, rows_per_file: int = 0) -> None:
    """Layout for range reads: range-partitioned and sorted files of a bounded number of rows."""
    w = df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys, *order).write.mode("overwrite")
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(path)
