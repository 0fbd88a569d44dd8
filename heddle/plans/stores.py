"""Queries of stored arrays: each writes the driver's tables as an array through the sink, and reads it back by slice, file, level or probe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.sources import arrays as Z
from heddle.sources.readers import work_folder

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: Quantities by order and line: as long as the orders are many.
_CELLS = """
h AS (SELECT max(l_orderkey) + 1 AS h FROM lineitem), s AS (SELECT l_orderkey AS y, l_linenumber AS x, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2),
a AS (SELECT r.y::INT AS y, c.x::INT AS x, coalesce(n, 0)::DOUBLE AS value FROM (SELECT unnest(range(0, h)) AS y FROM h) r CROSS JOIN range(8) c(x) LEFT JOIN s ON s.y = r.y AND s.x = c.x)
"""


def _quantities(spark, sf_dir) -> tuple[DataFrame, tuple[int, int]]:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = rows.groupBy(F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x")).agg(F.sum("l_quantity").alias("value"))
    return cells, (rows.agg(F.max("l_orderkey")).first()[0] + 1, 8)


def _stored(spark, sf_dir, chunks, shards=None, codec="gzip") -> str:
    cells, shape = _quantities(spark, sf_dir)
    path = work_folder(spark, "array")
    Z.write_cells(cells, path, Z.layout(shape, chunks, "<i4", shards, codec), ["y", "x"])
    return path


@query(f"WITH {_CELLS} SELECT * FROM a")
def array_scan(spark, sf_dir):
    """An array written by tasks, one file per chunk, and scanned by chunk; chunks that are not written hold the fill value."""
    return Z.pixels(Z.read_array(spark, _stored(spark, sf_dir, (256, 4))))


@query(f"WITH {_CELLS} SELECT * FROM a")
def sharded_array_scan(spark, sf_dir):
    """The same with one file per shard of 1024 x 8 and inner chunks of 128 x 4, by cell."""
    return Z.read_cells(spark, _stored(spark, sf_dir, (128, 4), (1024, 8)))


@query(f"WITH {_CELLS} SELECT a.* FROM a, h WHERE y >= h // 4 AND y < h // 2 AND x IN (2, 3, 6)")
def array_slice(spark, sf_dir):
    """A box of the array: the scan opens the chunks that meet it."""
    path = _stored(spark, sf_dir, (256, 2))
    h = Z.layout_of(path).shape[0]
    return Z.read_cells(spark, path).where((F.col("y") >= h // 4) & (F.col("y") < h // 2) & F.col("x").isin(2, 3, 6))


@query(f"WITH {_CELLS} SELECT unnest(['shards', 'chunks', 'strips']) AS layout, a.* FROM a")
def array_reshard(spark, sf_dir):
    """Row strips to shards, shards to single chunks that do not fit them, and back to strips."""
    last, out = _stored(spark, sf_dir, (64, 8)), []
    for name, chunks, shards in (("shards", (128, 4), (512, 8)), ("chunks", (300, 3), None), ("strips", (64, 8), None)):
        target = work_folder(spark, name)
        Z.reshard(spark, last, target, chunks, shards)
        out.append(Z.read_cells(spark, target).select(F.lit(name).alias("layout"), "y", "x", "value"))
        last = target
    return reduce(DataFrame.unionByName, out)


@query(f"""WITH {_CELLS}, l AS (SELECT unnest([1, 2, 3]) AS level, unnest([2, 4, 8]) AS f),
p AS (SELECT level, least(y // f, greatest(1, h // f) - 1)::INT AS y, least(x // f, 8 // f - 1)::INT AS x, value FROM a, l, h)
SELECT level, y, x, round(avg(value), 6) + 0.0 AS value FROM p GROUP BY ALL""")
def array_pyramid(spark, sf_dir):
    """Three smaller levels of the array in one pass."""
    levels = Z.pyramid(spark, _stored(spark, sf_dir, (1000, 8)), 4)
    return levels.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(f"WITH {_CELLS}, p AS (SELECT least(y // 2, greatest(1, h // 2) - 1)::INT AS y, (x // 2)::INT AS x, value FROM a, h), q AS (SELECT y, x, floor(avg(value) + 0.5)::DOUBLE AS value FROM p GROUP BY ALL) SELECT 'level' AS part, y, x, value FROM q UNION ALL SELECT 'scale', level::INT, axis::INT, (2 ** level)::DOUBLE FROM range(2) l(level), range(2) x(axis)")
def array_levels(spark, sf_dir):
    """A pyramid stored beside its array: the cells of level 1, whole numbers again, and the scales of the group's metadata."""
    cells, shape = _quantities(spark, sf_dir)
    folder = work_folder(spark, "group")
    Z.write_cells(cells, f"{folder}/0", Z.layout(shape, (1000, 8), "<i4"), ["y", "x"])
    Z.write_pyramid(spark, folder, 2, (500, 4), work_folder(spark, "levels"))
    found = Z.read_attributes(folder)["ome"]["multiscales"][0]["datasets"]
    scales = [("scale", k, axis, s) for k, d in enumerate(found) for axis, s in enumerate(d["coordinateTransformations"][0]["scale"])]
    return Z.read_cells(spark, f"{folder}/1").select(F.lit("level").alias("part"), "y", "x", "value").union(spark.createDataFrame(scales, "part string, y int, x int, value double"))


def _channels(spark, sf_dir) -> dict[str, str]:
    """Customers as points of an array with a channel for each nation; one that was made and not filled; one that is not there."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    points = customer.select(F.lit(0).alias("t"), F.col("c_nationkey").alias("c"), F.lit(0).alias("z"), F.col("c_custkey").alias("y"), (F.col("c_custkey") % 7).alias("x"), F.lit(1).alias("value"))
    shape = (1, 25, 1, customer.agg(F.max("c_custkey")).first()[0] + 1, 8)
    lay, paths = Z.layout(shape, (1, 1, 1, 128, 8), "<u1"), {n: work_folder(spark, n) for n in ("filled", "created", "missing")}
    Z.write_cells(points, paths["filled"], lay, list("tczyx"))
    Z.write_cells(points.limit(0), paths["created"], lay, list("tczyx"))
    return paths


_PROBES = """
WITH h AS (SELECT max(c_custkey) + 1 AS h FROM customer), w AS (SELECT greatest(0, floor(h * (i + 0.5::DOUBLE) / 5)::BIGINT - 4) AS low, h FROM h, range(5) r(i)),
c AS (SELECT n.n::INT AS place, count(y.c_custkey) > 0 AS has_data FROM range(25) n(n) LEFT JOIN (SELECT c_nationkey, c_custkey FROM customer, w WHERE c_custkey >= low AND c_custkey < least(h, low + 8)) y ON y.c_nationkey = n.n GROUP BY 1),
p AS (SELECT 'filled' AS name, true AS found, place, has_data FROM c UNION ALL SELECT 'created', true, place, false FROM c UNION ALL SELECT 'missing', false, NULL, false)
"""


def _probed(spark, sf_dir) -> tuple[dict[str, str], DataFrame]:
    paths = _channels(spark, sf_dir)
    return paths, Z.probe_arrays(spark.createDataFrame([(p, 0) for p in paths.values()], "path string, level int"))


def _named(rows: DataFrame, paths: dict[str, str]) -> DataFrame:
    name = F.coalesce(*(F.when(F.col("path") == p, F.lit(n)) for n, p in paths.items()))
    return rows.withColumn("name", name).drop("path")


@query(_PROBES + "SELECT * FROM p")
def array_probes(spark, sf_dir):
    """Which channels hold data, by planned windows that stop at the first value."""
    paths, probes = _probed(spark, sf_dir)
    return _named(probes.drop("opened"), paths)


@query(_PROBES + "SELECT name, CASE WHEN NOT bool_and(found) THEN 'missing' WHEN bool_and(has_data) THEN 'complete' WHEN bool_or(has_data) THEN 'partial' ELSE 'empty' END AS state FROM p GROUP BY name")
def array_states(spark, sf_dir):
    paths, probes = _probed(spark, sf_dir)
    return _named(Z.store_states(probes), paths)
