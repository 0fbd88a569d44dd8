"""Label images, tiles and sampling of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.sources.readers import work_folder


def label_boxes(pixels: DataFrame, group: list[str], label: str = "label", y: str = "y", x: str = "x") -> DataFrame:
    """Half-open box and area of each label; zero is background. One hash aggregate, combined before the shuffle."""
    return pixels.where(F.col(label) != 0).groupBy(*group, label).agg(F.min(y).alias("ymin"), F.min(x).alias("xmin"), (F.max(y) + 1).alias("ymax"), (F.max(x) + 1).alias("xmax"), F.count("*").alias("area"))


def boxes_for_cells(cells: DataFrame, boxes: DataFrame, keys: list[str], half: int = 64, y: str = "y", x: str = "x") -> DataFrame:
    """Boxes joined to cells; a cell without one gets a square around its position."""
    out = cells.join(boxes, keys, "left")
    around = {"ymin": F.col(y) - half, "xmin": F.col(x) - half, "ymax": F.col(y) + half, "xmax": F.col(x) + half}
    return out.select(*cells.columns, *[F.coalesce(F.col(c), v.cast("int")).alias(c) for c, v in around.items()])


def inside_edges(cells: DataFrame, half: int, y: str = "y", x: str = "x") -> DataFrame:
    """Cells whose patch of twice ``half`` lies strictly inside the extent of all cells."""
    e = cells.agg(*[f(c).alias(f"_{n}{c}") for c in (y, x) for n, f in (("lo", F.min), ("hi", F.max))])
    keep = None
    for c in (y, x):
        k = (F.col(c) > F.col(f"_lo{c}") + half) & (F.col(c) < F.col(f"_hi{c}") - half)
        keep = k if keep is None else keep & k
    return cells.crossJoin(F.broadcast(e)).where(keep).select(*cells.columns)


def tiles_by_stride(images: DataFrame, grid: int, overlap: int) -> DataFrame:
    """Tiles of size // grid that advance by size - overlap; the last one ends short of the edge."""
    h, w = F.floor(F.col("height") / grid).cast("int"), F.floor(F.col("width") / grid).cast("int")
    cells = images.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    y, x = F.col("row") * (h - overlap), F.col("col") * (w - overlap)
    return cells.select(*images.columns, "row", "col", y.alias("y0"), (y + h).alias("y1"), x.alias("x0"), (x + w).alias("x1"))


def tiles_with_overlap(images: DataFrame, grid: int, blend: int) -> DataFrame:
    """Tiles that cover the image, each grown by the blend on all sides and clamped to the image."""
    cells = images.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    out = []
    for axis, size, k in (("y", "height", "row"), ("x", "width", "col")):
        step = F.floor(F.col(size) / grid).cast("int")
        lo, hi = F.col(k) * step, F.when(F.col(k) == grid - 1, F.col(size)).otherwise((F.col(k) + 1) * step)
        out += [F.greatest(F.lit(0), lo - blend).alias(f"{axis}0"), F.least(F.col(size), hi + blend).alias(f"{axis}1")]
    return cells.select(*images.columns, "row", "col", *out)


def central_roi(height: Column, width: Column, size: int) -> Column:
    """Centred square, clipped to the image."""
    y, x = F.greatest(F.lit(0), F.floor((height - size) / 2)).cast("int"), F.greatest(F.lit(0), F.floor((width - size) / 2)).cast("int")
    return F.struct(y.alias("y0"), F.least(height, y + size).alias("y1"), x.alias("x0"), F.least(width, x + size).alias("x1"))


def three_rois(height: Column, width: Column, size: int = 500, edge_distance: int = 7000) -> Column:
    """array<struct<place, y, x, y0, y1, x0, x1>>: squares at the centre, half of the smaller half-side above it, and ``edge_distance`` below the top of the centred square; each is clipped to the image."""
    cy, cx = F.floor(height / 2).cast("int"), F.floor(width / 2).cast("int")
    radius = F.least(cy, cx)
    low = lambda c: F.greatest(F.lit(0), c - size // 2)
    out = []
    for place, y in (("center", cy), ("mid", cy - F.floor(radius / 2).cast("int")), ("edge", cy - (radius - edge_distance))):
        out.append(F.struct(F.lit(place).alias("place"), y.alias("y"), cx.alias("x"), low(y).alias("y0"), F.least(height, low(y) + size).alias("y1"), low(cx).alias("x0"), F.least(width, low(cx) + size).alias("x1")))
    return F.array(*out)


def subtile_grid(n: Column, height: Column, width: Column) -> Column:
    """Side of a square grid of ``n`` parts of an image; anything but a square number whose root divides both sides raises an error."""
    side = F.round(F.sqrt(n)).cast("int")
    odd = F.when(side * side != n, F.concat(n.cast("string"), F.lit(" is not a square number"))).when((height % side != 0) | (width % side != 0), F.concat(F.lit("a grid of "), side.cast("string"), F.lit(" does not divide the image")))
    return F.when(odd.isNotNull(), F.raise_error(odd).cast("int")).otherwise(side)


def units(positions: DataFrame) -> DataFrame:
    """One row per position, time and channel."""
    return positions.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n_t") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_c") - 1))).drop("n_t", "n_c")


def balanced_sample(positions: DataFrame, group: str, order: str, n: Column | int) -> DataFrame:
    """Up to ``n`` positions of each group around its middle one (by order): the block starts half of ``n``, rounded down, before it. The window is over one group's positions."""
    n = F.lit(n) if isinstance(n, int) else n
    w = Window.partitionBy(group).orderBy(order)
    rows = positions.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    k = F.least(n, F.col("_n"))
    start = F.floor(F.col("_n") / 2) - F.floor(k / 2)
    return rows.where((F.col("_r") > start) & (F.col("_r") <= start + k)).drop("_r", "_n")


def shares(groups: DataFrame, total: int, order: str) -> DataFrame:
    """How many of ``total`` each group gives: equal parts of at least one, the remainder to the first ones. The window is over the groups."""
    k, n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)), F.count("*").over(Window.partitionBy(F.lit(0)))
    base = F.greatest(F.lit(1), F.floor(F.lit(total) / n))
    return groups.withColumn("n", base + F.when(k <= F.lit(total) - base * n, 1).otherwise(0))


def _tile_order(position: str) -> Column:
    """Number of a position's last part, which orders the tiles of a well; zero without digits."""
    digits = F.regexp_replace(F.substring_index(position, "/", -1), r"\D", "")
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def _ranked(positions: DataFrame, well: str, position: str) -> DataFrame:
    """Positions with ``_r`` (from zero, in the order of their well's tiles) and ``_n`` of their well; the windows are over one well."""
    w = Window.partitionBy(well)
    return positions.withColumn("_r", F.row_number().over(w.orderBy(_tile_order(position), position)) - 1).withColumn("_n", F.count("*").over(w))


def sample_positions(positions: DataFrame, well: str, position: str, total: int) -> DataFrame:
    """``total`` positions in central blocks: each well gives its share (see ``shares``) or all it has, and the first wells fill the total where shares of one exceed it. Nothing asked for (``total`` below one) means all."""
    if total < 1:
        return positions
    given = shares(positions.select(well).distinct(), total, well)
    rows = _ranked(positions, well, position).join(F.broadcast(given.withColumnRenamed("n", "_k")), well)
    k = F.least("_k", "_n")
    start = F.floor(F.col("_n") / 2) - F.floor(k / 2)
    chosen = rows.where((F.col("_r") >= start) & (F.col("_r") < start + k))
    before = chosen.groupBy(well).agg(F.count("*").alias("_c")).select(well, (F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy(well)) - F.col("_c")).alias("_b"))
    place = F.col("_b") + F.col("_r") - start
    return chosen.join(F.broadcast(before), well).where(place < total).drop("_r", "_n", "_k", "_b")


def discover_positions(positions: DataFrame, well: str, position: str, total: int) -> DataFrame:
    """``total`` positions of a central block of as many wells: each gives up to ``ceil(total / wells)``, spreading from its middle tile (the lower side first), and wells are filled in order until the total is met.

    Wells without so many tiles leave room that later wells use only up to their own part, so fewer than ``total`` may come back. Windows are over one well, and over one row per well.
    """
    if total < 1:
        return positions.limit(0)
    one = Window.partitionBy(F.lit(0))
    wells = positions.groupBy(well).agg(F.count("*").alias("_n"))
    wells = wells.withColumn("_w", F.row_number().over(one.orderBy(well)) - 1).withColumn("_all", F.count("*").over(one))
    start = F.when(F.lit(total) >= F.col("_all"), 0).otherwise(F.floor(F.col("_all") / 2) - F.lit(total // 2))
    wells = wells.where((F.col("_w") >= start) & (F.col("_w") < start + total)).withColumn("_all", F.count("*").over(one))
    gives = wells.withColumn("_g", F.least(F.col("_n"), F.ceil(F.lit(total) / F.col("_all"))))
    gives = gives.withColumn("_b", F.sum("_g").over(one.orderBy(well)) - F.col("_g")).withColumn("_g", F.greatest(F.lit(0), F.least(F.col("_g"), F.lit(total) - F.col("_b"))))
    rows = _ranked(positions, well, position).join(F.broadcast(gives.select(well, "_g")), well)
    off = F.col("_r") - F.floor(F.col("_n") / 2)
    spread = F.row_number().over(Window.partitionBy(well).orderBy(F.abs(off), off))
    return rows.withColumn("_s", spread).where(F.col("_s") <= F.col("_g")).drop("_r", "_n", "_g", "_s")


def last_position(positions: DataFrame, group: str, position: str) -> DataFrame:
    """Position with the largest number in its name; malformed names rank lowest."""
    number = F.coalesce(F.regexp_replace(position, r"\D", "").try_cast("int"), F.lit(-1))
    return positions.groupBy(group).agg(F.max_by(position, F.struct(number, position)).alias(position))


def sorted_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``_p``, the number of their range in this order; written to the shared folder, so that the ranges stay."""
    folder = work_folder(rows.sparkSession, "sorted")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Place of each row, from one, in a total order. Rows are sorted by range; only the number of rows of each range crosses to one task."""
    done = sorted_parts(rows, order)
    before = done.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n")).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return done.withColumn("_i", inside).join(F.broadcast(before), "_p").withColumn(name, F.col("_n") + F.col("_i")).drop("_p", "_n", "_i")


def label_codes(rows: DataFrame, name: str, control: str = "NTC") -> DataFrame:
    """(name, code): dense numbers of the sorted distinct names, NULL standing for the control."""
    d = rows.select(F.coalesce(name, F.lit(control)).alias(name)).distinct()
    return numbered(d, [name], "code").withColumn("code", (F.col("code") - 1).cast("int"))


def has_data(tiles: DataFrame, group: list[str], values: str) -> DataFrame:
    """Whether any value of a group's tiles is not zero; within a tile the search stops at the first."""
    return tiles.groupBy(*group).agg(F.bool_or(F.exists(values, lambda v: v != 0)).alias("has_data"))


def flip(tile: Column, vertical: bool = False) -> Column:
    """Mirror of a tile held as array of rows."""
    return F.reverse(tile) if vertical else F.transform(tile, F.reverse)


def rotate(tile: Column) -> Column:
    """Quarter turn against the clock of a tile held as array of rows."""
    n = F.size(tile[0])
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(tile, lambda r: F.get(r, n - 1 - i)))
