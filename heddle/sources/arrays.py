"""Chunked n-dimensional arrays in the Zarr layout (versions 2 and 3, one level of shards): scans, slice reads, a sink, resharding, pyramids, probes.

Three data sources over one reader of stored chunks, each in any file system that pyarrow opens by URI (local and mounted folders, hdfs, viewfs, s3, gs):

* ``zarr_cells``: one row per cell, (axes..., value). Ranges on the axes are pushed into the scan and become a list of chunks: others are not opened.
* ``zarr_blocks``: one row per written chunk, (chunk, start, extent, data); as a sink it takes blocks or cells that are dealt by tile (a chunk or a
  whole shard, the unit of a file) and writes a file per tile.
* ``zarr_chunks``: one row per chunk with its values as doubles; chunks that are not written have rows of the fill value.

A sink's task writes each file under a name of its own attempt and renames it, and the array's metadata come last, from the driver: a lost task leaves no
torn chunk, a failed job no array. Codecs: none, zlib and gzip, and zstd where the library is there.

Defined cases: an array of no cells has rows of the fill value only; cells outside the shape, or without a place, raise an error; of cells with the same place the
largest value is stored; null values store the fill value.
"""

from __future__ import annotations

import gzip
import itertools
import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

CHUNK_SCHEMA = "array string, chunk array<int>, start array<int>, shape array<int>, dtype string, values array<double>"
BLOCK_SCHEMA = "chunk array<int>, start array<int>, extent array<int>, data binary"
#: Names of the last axes of an array, the last one last.
AXES = "tczyx"
_NONE = (1 << 64) - 1
#: Cells that a task of a scan reads, at least (whole files, though), and rows of a batch that it gives, at least. The smaller the chunks, the more of them.
TASK_CELLS, BATCH_CELLS = 1 << 17, 1 << 14


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return fs, base.rstrip("/")


def _read(fs: pafs.FileSystem, path: str) -> bytes | None:
    """Whole bytes of a file, None if there is none."""
    try:
        with fs.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


@dataclass(frozen=True)
class Layout:
    """Shape, chunks and coding of an array. ``shard`` is the shape of a file's chunks together, None if each has a file of its own."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codec: str | None = None
    shard: tuple[int, ...] | None = None
    fill: float = 0
    prefix: str = "c/"
    sep: str = "/"
    order: str = "C"
    index_first: bool = False
    index_check: int = 0

    @property
    def tile(self) -> tuple[int, ...]:
        """Extent of one file."""
        return self.shard or self.chunks

    @property
    def grid(self) -> tuple[int, ...]:
        """Files along each axis."""
        return tuple(-(-s // t) for s, t in zip(self.shape, self.tile, strict=True))

    @property
    def inner(self) -> tuple[int, ...]:
        """Chunks of a file along each axis."""
        return tuple(t // c for t, c in zip(self.tile, self.chunks, strict=True))

    def name(self, tile: Sequence[int]) -> str:
        return self.prefix + self.sep.join(map(str, tile))

    def metadata(self) -> dict:
        """The version 3 document of this layout."""
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}]
        if self.codec:
            codecs.append({"name": self.codec, "configuration": {"level": 1} | ({"checksum": False} if self.codec == "zstd" else {})})
        if self.shard:
            codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(self.chunks), "codecs": codecs, "index_codecs": codecs[:1], "index_location": "end"}}]
        kind = np.dtype(self.dtype)
        return {"zarr_format": 3, "node_type": "array", "shape": list(self.shape), "data_type": kind.name, "fill_value": kind.type(self.fill).item(), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(self.tile)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": codecs, "attributes": {}}

    def decode(self, raw: bytes) -> np.ndarray:
        if self.codec in ("zlib", "gzip"):
            raw = zlib.decompress(raw) if self.codec == "zlib" else gzip.decompress(raw)
        elif self.codec == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31)
        return np.frombuffer(raw, dtype=self.dtype).reshape(self.chunks, order=self.order)

    def encode(self, block: np.ndarray) -> bytes:
        raw = np.ascontiguousarray(block, dtype=self.dtype).tobytes()
        if self.codec == "zstd":
            import zstandard

            return zstandard.ZstdCompressor(level=1).compress(raw)
        return zlib.compress(raw, 1) if self.codec == "zlib" else gzip.compress(raw, 1, mtime=0) if self.codec == "gzip" else raw

    def file(self, values: np.ndarray) -> bytes | None:
        """Bytes of the file of a tile, None if it holds the fill value only."""
        if (values == self.fill).all():
            return None
        if self.shard is None:
            return self.encode(values)
        body, index = [], []
        at = 0
        for k in np.ndindex(*self.inner):
            block = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(k, self.chunks, strict=True))]
            raw = b"" if (block == self.fill).all() else self.encode(block)
            index += [at, len(raw)] if raw else [_NONE, _NONE]
            body.append(raw)
            at += len(raw)
        return b"".join([*body, np.array(index, dtype="<u8").tobytes()])


def layout_of(path: str) -> Layout:
    """Layout of a stored array of either version."""
    fs, base = _folder(path)
    if (raw := _read(fs, f"{base}/.zarray")) is not None:
        m = json.loads(raw)
        codec = (m.get("compressor") or {}).get("id")
        out = Layout(tuple(m["shape"]), tuple(m["chunks"]), m["dtype"], codec, None, m.get("fill_value") or 0, "", m.get("dimension_separator", "."), m.get("order", "C"))
    else:
        if (raw := _read(fs, f"{base}/zarr.json")) is None:
            raise FileNotFoundError(f"{path} holds no array")
        m = json.loads(raw)
        codecs, chunks, shard, first, check = m.get("codecs", []), m["chunk_grid"]["configuration"]["chunk_shape"], None, False, 0
        if codecs and codecs[0]["name"] == "sharding_indexed":
            inside, shard = codecs[0]["configuration"], tuple(chunks)
            check = 4 if any(c["name"] == "crc32c" for c in inside.get("index_codecs", [])) else 0
            first, codecs, chunks = inside.get("index_location", "end") == "start", inside.get("codecs", []), inside["chunk_shape"]
        names = [c["name"] for c in codecs]
        endian = next((c.get("configuration", {}).get("endian", "little") for c in codecs if c["name"] == "bytes"), "little")
        sep = m.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
        coded = [c for c in names if c != "bytes"]
        if len(coded) > 1:
            raise ValueError(f"{path}: codecs {coded} are not read")
        out = Layout(tuple(m["shape"]), tuple(chunks), np.dtype(m["data_type"]).newbyteorder("<" if endian == "little" else ">").str, next(iter(coded), None), shard, m.get("fill_value") or 0, "c" + sep, sep, "C", first, check)
    if out.codec not in (None, "zlib", "gzip", "zstd"):
        raise ValueError(f"{path}: codec {out.codec} is not read")
    return out


def read_attributes(path: str) -> dict:
    """User attributes of an array or group of either version; empty if there are none."""
    fs, base = _folder(path)
    if (raw := _read(fs, f"{base}/.zattrs")) is not None:
        return json.loads(raw)
    raw = _read(fs, f"{base}/zarr.json")
    return {} if raw is None else json.loads(raw).get("attributes", {})


class StoredArray:
    """Chunks of one array on demand; ``opened`` counts those that were read, ``read_bytes`` their bytes. The index of the last shard is kept."""

    def __init__(self, path: str):
        self.layout, (self.fs, self.base) = layout_of(path), _folder(path)
        self.opened, self.read_bytes, self._tile, self._index, self._file = 0, 0, None, None, None

    def _shard(self, tile: tuple[int, ...]) -> None:
        if tile == self._tile:
            return
        size, lay = 16 * int(np.prod(self.layout.inner)), self.layout
        self._tile, self._file, self._index = tile, None, None
        try:
            self._file = self.fs.open_input_file(f"{self.base}/{lay.name(tile)}")
        except FileNotFoundError:
            return
        self._file.seek(0 if lay.index_first else self._file.size() - size - lay.index_check)
        self._index = np.frombuffer(self._file.read(size), dtype="<u8").reshape(-1, 2)

    def stored(self, chunk: tuple[int, ...]) -> np.ndarray | None:
        """Values of a chunk, padding included; None if it is not written."""
        lay = self.layout
        if lay.shard is None:
            raw = _read(self.fs, f"{self.base}/{lay.name(chunk)}")
        else:
            self._shard(tuple(i // n for i, n in zip(chunk, lay.inner, strict=True)))
            if self._index is None:
                return None
            at, n = self._index[int(np.ravel_multi_index([i % n for i, n in zip(chunk, lay.inner, strict=True)], lay.inner))].tolist()
            if at == n == _NONE:
                return None
            self._file.seek(at)
            raw = self._file.read(n)
        if raw is None:
            return None
        self.opened += 1
        self.read_bytes += len(raw)
        return lay.decode(raw)

    def extent(self, chunk: Sequence[int]) -> tuple[list[int], list[int]]:
        """Origin of a chunk and its extent inside the array."""
        start = [i * c for i, c in zip(chunk, self.layout.chunks, strict=True)]
        return start, [min(c, s - a) for a, c, s in zip(start, self.layout.chunks, self.layout.shape, strict=True)]

    def chunks_of(self, tile: Sequence[int], low: Sequence[int], high: Sequence[int]) -> Iterator[tuple[int, ...]]:
        """Chunks of a file that meet the box from ``low`` up to ``high`` (not included)."""
        lay = self.layout
        ranges = []
        for i, n, c, s, a, b in zip(tile, lay.inner, lay.chunks, lay.shape, low, high, strict=True):
            ranges.append(range(max(i * n, a // c), min((i + 1) * n, -(-min(b, s) // c))))
        return itertools.product(*ranges)

    def any_in(self, low: Sequence[int], high: Sequence[int], known: dict) -> bool:
        """Whether any value of a box is not zero. Chunks are opened in order and only until one is met; ``known`` keeps the last ones."""
        for chunk in itertools.product(*(range(a // c, -(-b // c)) for a, b, c in zip(low, high, self.layout.chunks, strict=True))):
            if chunk not in known:
                if len(known) >= 32:
                    known.pop(next(iter(known)))
                known[chunk] = self.stored(chunk)
            block, start = known[chunk], [i * c for i, c in zip(chunk, self.layout.chunks, strict=True)]
            if block is None:
                if self.layout.fill:
                    return True
            elif block[tuple(slice(max(a - s, 0), b - s) for a, b, s in zip(low, high, start, strict=True))].any():
                return True
        return False


# readers -----------------------------------------------------------------------------------------------


class _Tiles(InputPartition):
    """A run of files of the sub-grid that meets the box."""

    def __init__(self, first: tuple[int, ...], counts: tuple[int, ...], start: int, n: int):
        self.first, self.counts, self.start, self.n = first, counts, start, n

    def tiles(self) -> Iterator[tuple[int, ...]]:
        for k in range(self.start, self.start + self.n):
            yield tuple(int(i) + f for i, f in zip(np.unravel_index(k, self.counts), self.first, strict=True))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, lay = options["path"], layout_of(options["path"])
        self.per_task = int(options.get("chunks_per_task", max(8, TASK_CELLS // int(np.prod(lay.chunks)))))
        self.low, self.high, self.axes = [0] * len(lay.shape), list(lay.shape), AXES[-len(lay.shape) :]

    def partitions(self):
        lay = layout_of(self.path)
        if any(a >= b for a, b in zip(self.low, self.high, strict=True)):
            return [_Tiles((), (), 0, 0)]
        first = tuple(a // t for a, t in zip(self.low, lay.tile, strict=True))
        counts = tuple(-(-b // t) - f for b, t, f in zip(self.high, lay.tile, first, strict=True))
        total, step = int(np.prod(counts)), max(1, self.per_task // int(np.prod(lay.inner)))
        return [_Tiles(first, counts, k, min(step, total - k)) for k in range(0, total, step)]

    def _chunks(self, partition: _Tiles) -> Iterator[tuple[StoredArray, tuple[int, ...]]]:
        if partition.n:
            array = StoredArray(self.path)
            for tile in partition.tiles():
                for chunk in array.chunks_of(tile, self.low, self.high):
                    yield array, chunk


class _ChunkReader(_Reader):
    def read(self, partition) -> Iterator[tuple]:
        name = _folder(self.path)[1].rpartition("/")[2]
        for array, chunk in self._chunks(partition):
            block, (start, extent) = array.stored(chunk), array.extent(chunk)
            if block is None:
                block = np.full(array.layout.chunks, array.layout.fill, dtype=array.layout.dtype)
            yield (name, list(chunk), start, extent, array.layout.dtype, block[tuple(slice(0, e) for e in extent)].astype(float).ravel().tolist())


class _BlockReader(_Reader):
    def read(self, partition) -> Iterator[tuple]:
        for array, chunk in self._chunks(partition):
            if (block := array.stored(chunk)) is not None:
                start, extent = array.extent(chunk)
                yield (list(chunk), start, extent, np.ascontiguousarray(block[tuple(slice(0, e) for e in extent)]).tobytes())


class _CellReader(_Reader):
    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name, value = f.attribute[0] if hasattr(f, "attribute") else "", getattr(f, "value", None)
            if name not in self.axes:
                yield f
                continue
            k, whole = self.axes.index(name), isinstance(value, int)
            if isinstance(f, IsNotNull):
                continue
            if isinstance(f, IsNull):
                self._cut(k, 0, 0)
                continue
            if isinstance(f, In) and all(isinstance(v, int) for v in f.value):
                self._cut(k, min(f.value, default=0), max(f.value, default=-1) + 1)
                yield f  # the rest of the list is told apart by rows
            elif isinstance(f, EqualTo) and whole:
                self._cut(k, value, value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and whole:
                self._cut(k, value + isinstance(f, GreaterThan), self.high[k])
            elif isinstance(f, (LessThan, LessThanOrEqual)) and whole:
                self._cut(k, self.low[k], value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def _cut(self, axis: int, low: int, high: int) -> None:
        self.low[axis], self.high[axis] = max(self.low[axis], low), min(self.high[axis], high)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        names, held, n = [*self.axes, "value"], [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

        for array, chunk in self._chunks(partition):
            start, extent = array.extent(chunk)
            low = [max(a, s) for a, s in zip(self.low, start, strict=True)]
            size = [min(b, s + e) - a for a, b, s, e in zip(low, self.high, start, extent, strict=True)]
            block = array.stored(chunk)
            inside = tuple(slice(a - s, a - s + n) for a, s, n in zip(low, start, size, strict=True))
            values = np.full(size, array.layout.fill, dtype=float) if block is None else block[inside].astype(float)
            places = [np.broadcast_to((np.arange(n, dtype=np.int32) + np.int32(a)).reshape([-1 if j == k else 1 for j in range(len(size))]), size) for k, (a, n) in enumerate(zip(low, size, strict=True))]
            held.append([*(p.ravel() for p in places), values.ravel()])
            n += values.size
            if n >= BATCH_CELLS:
                yield batch()
                held, n = [], 0
        if held:
            yield batch()


# sink --------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class ArraySink(DataSourceArrowWriter):
    """Writes tiles: rows (tile, start, extent, data) or (tile, at, value), all rows of a tile one after another."""

    def __init__(self, path: str, layout: Layout):
        self.path, self.layout = path, layout
        fs, base = _folder(path)
        if any(i.type != pafs.FileType.NotFound for i in fs.get_file_info([f"{base}/zarr.json", f"{base}/.zarray"])):
            raise FileExistsError(f"{path} holds an array already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _folder(self.path)
        lay, done, now, values = self.layout, Written(0, 0), None, None
        work = f"{base}/.work/{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        fs.create_dir(work, recursive=True)

        def flush() -> None:
            if now is None or (raw := lay.file(values)) is None:
                return
            name = f"{base}/{lay.name(np.unravel_index(now, lay.grid))}"
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(f"{work}/{now}") as f:
                f.write(raw)
            fs.move(f"{work}/{now}", name)
            done.files, done.bytes = done.files + 1, done.bytes + len(raw)

        for batch in iterator:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            tile = column["tile"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else []
            for a, b in zip(edges, [*edges[1:], len(tile)], strict=True):
                if now != int(tile[a]):
                    flush()
                    now, values = int(tile[a]), np.full(lay.tile, lay.fill, dtype=lay.dtype)
                if "at" in column:
                    values.reshape(-1)[column["at"].slice(a, b - a).to_numpy()] = column["value"].slice(a, b - a).to_numpy()
                else:
                    for k in range(a, b):
                        start, extent = column["start"][k].as_py(), column["extent"][k].as_py()
                        values[tuple(slice(s, s + e) for s, e in zip(start, extent, strict=True))] = np.frombuffer(column["data"][k].as_buffer(), dtype=lay.dtype).reshape(extent)
        flush()
        return done

    def commit(self, messages) -> None:
        """Publish the array: its metadata are the last file."""
        fs, base = _folder(self.path)
        fs.create_dir(f"{base}/.work", recursive=True)
        with fs.open_output_stream(f"{base}/.work/zarr.json") as f:
            f.write(json.dumps(self.layout.metadata()).encode())
        fs.move(f"{base}/.work/zarr.json", f"{base}/zarr.json")
        fs.delete_dir(f"{base}/.work")

    def abort(self, messages) -> None:
        fs, base = _folder(self.path)
        fs.delete_dir_contents(f"{base}/.work", missing_dir_ok=True)


class _Source(DataSource):
    def __init__(self, options):
        super().__init__(options)
        self.options = dict(options)


class ZarrChunks(_Source):
    @classmethod
    def name(cls) -> str:
        return "zarr_chunks"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> _Reader:
        return _ChunkReader(self.options)


class ZarrBlocks(_Source):
    @classmethod
    def name(cls) -> str:
        return "zarr_blocks"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> _Reader:
        return _BlockReader(self.options)

    def writer(self, schema, overwrite) -> ArraySink:
        spec = json.loads(self.options["layout"])
        return ArraySink(self.options["path"], Layout(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()}))


class ZarrCells(_Source):
    @classmethod
    def name(cls) -> str:
        return "zarr_cells"

    def schema(self) -> str:
        return ", ".join(f"{a} int" for a in AXES[-len(layout_of(self.options["path"]).shape) :]) + ", value double"

    def reader(self, schema) -> _Reader:
        return _CellReader(self.options)


def _load(spark: SparkSession, source: type[DataSource], path: str, chunks_per_task: int | None) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    return (reader if chunks_per_task is None else reader.option("chunks_per_task", chunks_per_task)).load(path)


def read_array(spark: SparkSession, path: str, chunks_per_task: int | None = None) -> DataFrame:
    """One row per chunk with its values."""
    return _load(spark, ZarrChunks, path, chunks_per_task)


def read_blocks(spark: SparkSession, path: str, chunks_per_task: int | None = None) -> DataFrame:
    """One row per written chunk with its bytes, padding cut off."""
    return _load(spark, ZarrBlocks, path, chunks_per_task)


def read_cells(spark: SparkSession, path: str, chunks_per_task: int | None = None) -> DataFrame:
    """One row per cell. Comparisons of an axis with a number are answered by the list of chunks to open (this turns on ``spark.sql.python.filterPushdown.enabled`` in the session)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return _load(spark, ZarrCells, path, chunks_per_task)


def pixels(chunks: DataFrame) -> DataFrame:
    """(y, x, value) of the last two axes of each chunk's first plane."""
    n = F.size("shape")
    h, w = F.element_at("shape", n - 1), F.element_at("shape", n)
    flat = chunks.select("start", n.alias("n"), w.alias("w"), (h * w).alias("hw"), F.posexplode("values").alias("i", "value")).where("i < hw")
    return flat.select((F.element_at("start", F.col("n") - 1) + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), (F.element_at("start", F.col("n")) + F.col("i") % F.col("w")).cast("int").alias("x"), "value")


def layout(shape: Sequence[int], chunks: Sequence[int], dtype: str, shards: Sequence[int] | None = None, codec: str | None = "gzip", fill: float = 0) -> Layout:
    """Layout of a new array; shards hold whole chunks and are no longer than the array needs."""
    if shards is not None:
        if any(s % c for s, c in zip(shards, chunks, strict=True)):
            raise ValueError("a shard must hold whole chunks")
        shards = tuple(min(s, -(-n // c) * c) for s, n, c in zip(shards, shape, chunks, strict=True))
    return Layout(tuple(shape), tuple(chunks), np.dtype(dtype).str, codec, shards, fill)


def _deal(rows: DataFrame, tiles: int, *order: str) -> DataFrame:
    """Rows of a tile in one partition and one after another. A tile is a file, so it is bounded."""
    n = min(tiles, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.repartition(n, "tile").sortWithinPartitions("tile", *order)


def _save(rows: DataFrame, path: str, lay: Layout) -> None:
    rows.sparkSession.dataSource.register(ZarrBlocks)
    rows.write.format("zarr_blocks").option("layout", json.dumps(asdict(lay))).mode("append").save(path)


def _linear(places: list[Column], sizes: Sequence[int]) -> Column:
    """Number of a place in row-major order."""
    out = F.lit(0).cast("long")
    for p, n in zip(places, sizes, strict=True):
        out = out * n + p.cast("long")
    return out


def write_cells(cells: DataFrame, path: str, lay: Layout, axes: Sequence[str], value: str = "value") -> None:
    """Write an array of the rows (axes..., value). Rows are shuffled once, to whole files; places that no row names hold the fill value."""
    at = [F.col(a).cast("long") for a in axes]
    inside = F.lit(True)
    for p, n in zip(at, lay.shape, strict=True):
        inside = inside & p.isNotNull() & (p >= 0) & (p < n)
    tile = _linear([F.floor(p / t) for p, t in zip(at, lay.tile, strict=True)], lay.grid)
    checked = F.when(inside, tile).otherwise(F.raise_error(F.lit(f"cell outside the shape {list(lay.shape)}")).cast("long"))
    kind = "double" if np.dtype(lay.dtype).kind == "f" else "long"
    stored = F.coalesce(F.col(value).cast(kind), F.lit(lay.fill).cast(kind))
    rows = cells.select(checked.alias("tile"), _linear([p % t for p, t in zip(at, lay.tile, strict=True)], lay.tile).alias("at"), stored.alias("value"))
    _save(_deal(rows, int(np.prod(lay.grid)), "at", "value"), path, lay)


def reshard(spark: SparkSession, source: str, target: str, chunks: Sequence[int] | None = None, shards: Sequence[int] | None = None, codec: str | None = "gzip") -> Layout:
    """Copy an array to other chunks and shards. Each written source chunk is read once, cut along the target's files, and each file is put together from its pieces."""
    old = layout_of(source)
    new = layout(old.shape, chunks or old.chunks, np.dtype(old.dtype).newbyteorder("<").str, shards, codec, old.fill)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for start, extent, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = np.frombuffer(data.as_buffer(), dtype=old.dtype).reshape(extent)
                for tile in itertools.product(*(range(s // t, -(-(s + e) // t)) for s, e, t in zip(start, extent, new.tile, strict=True))):
                    low = [max(s, i * t) for s, i, t in zip(start, tile, new.tile, strict=True)]
                    high = [min(s + e, (i + 1) * t) for s, e, i, t in zip(start, extent, tile, new.tile, strict=True)]
                    piece = block[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, start, strict=True))]
                    found = int(np.ravel_multi_index(tile, new.grid)), [a - i * t for a, i, t in zip(low, tile, new.tile, strict=True)], list(piece.shape), np.ascontiguousarray(piece, dtype=new.dtype).tobytes()
                    for column, x in zip(rows, found, strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.int32())), pa.array(rows[2], pa.list_(pa.int32())), pa.array(rows[3], pa.binary())], names=["tile", "start", "extent", "data"])

    pieces = read_blocks(spark, source).select("start", "extent", "data").mapInArrow(cut, "tile long, start array<int>, extent array<int>, data binary")
    _save(_deal(pieces, int(np.prod(new.grid))), target, new)
    return new


# pyramids ----------------------------------------------------------------------------------------------


def level_shape(shape: Sequence[int], level: int, factor: int = 2) -> tuple[int, ...]:
    """Shape of a level: the last two axes shrink, none below one."""
    return tuple(s if k < len(shape) - 2 else max(1, s // factor**level) for k, s in enumerate(shape))


def pyramid(spark: SparkSession, path: str, levels: int, factor: int = 2) -> DataFrame:
    """(level, axes..., value) of levels 1 to ``levels - 1``: means of the cells of level 0 that fall on a cell; what an uneven edge leaves over belongs to the last cell.

    One pass: each block is summed for all levels where it lies, and only sums that cross blocks meet in the shuffle. A cell's number of
    sources is known from the shape, so chunks that are not written need no rows; cells made of such chunks only have no row and the fill value.
    """
    lay = layout_of(path)
    axes, n = AXES[-len(lay.shape) :], len(lay.shape)
    shapes = {k: level_shape(lay.shape, k, factor) for k in range(1, levels)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, extent, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = np.frombuffer(data.as_buffer(), dtype=lay.dtype).reshape(extent).astype(float) - lay.fill
                for level, shape in shapes.items():
                    part, low = block, list(start)
                    for axis in (n - 2, n - 1):
                        place = np.minimum((np.arange(extent[axis]) + start[axis]) // factor**level, shape[axis] - 1)
                        low[axis] = int(place[0])
                        part = np.add.reduceat(part, np.flatnonzero(np.diff(place, prepend=-1)), axis=axis)
                    at = [(np.indices(part.shape)[k] + low[k]).ravel().astype(np.int32) for k in range(n)]
                    yield pa.record_batch([pa.array(np.full(part.size, level, np.int32)), *map(pa.array, at), pa.array(part.ravel())], names=["level", *axes, "value"])

    spec = "level int, " + ", ".join(f"{a} int" for a in axes) + ", value double"
    parts = read_blocks(spark, path).select("start", "extent", "data").mapInArrow(sums, spec)
    count = F.lit(1)
    for axis in (n - 2, n - 1):
        along = F.lit(0)
        for level, shape in shapes.items():
            full = factor**level if shape[axis] > 1 else 0
            here = F.when(F.col(axes[axis]) < shape[axis] - 1, full).otherwise(lay.shape[axis] - full * (shape[axis] - 1))
            along = F.when(F.col("level") == level, here).otherwise(along)
        count = count * along
    return parts.groupBy("level", *axes).agg(F.sum("value").alias("value")).withColumn("value", F.col("value") / count + F.lit(float(lay.fill)))


def write_pyramid(spark: SparkSession, folder: str, levels: int, chunks: Sequence[int], work: str, factor: int = 2, codec: str | None = "gzip") -> None:
    """Write the levels below level 0 of ``folder`` (its array ``0``) and register all in the group's metadata with their scales. The levels are computed once, into ``work``."""
    base = layout_of(f"{folder}/0")
    pyramid(spark, f"{folder}/0", levels, factor).write.partitionBy("level").parquet(work)
    held = spark.read.parquet(work)
    axes, scales = AXES[-len(base.shape) :], []
    for level in range(1, levels):
        values = held.where(F.col("level") == level)
        values = values if np.dtype(base.dtype).kind == "f" else values.withColumn("value", F.round("value"))
        write_cells(values, f"{folder}/{level}", layout(level_shape(base.shape, level, factor), chunks, base.dtype, None, codec, base.fill), list(axes))
    for level in range(levels):
        scale = [1.0 if k < len(base.shape) - 2 else float(factor**level) for k in range(len(base.shape))]
        scales.append({"path": str(level), "coordinateTransformations": [{"type": "scale", "scale": scale}]})
    group = {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"multiscales": [{"axes": [{"name": a} for a in axes], "datasets": scales}]}}}
    fs, root = _folder(folder)
    with fs.open_output_stream(f"{root}/zarr.json.new") as f:
        f.write(json.dumps(group).encode())
    fs.move(f"{root}/zarr.json.new", f"{root}/zarr.json")


# presence ----------------------------------------------------------------------------------------------


#: Fixed numbers of the probes: side of the grid, and extent of a window in the full array and in smaller levels.
PROBE_GRID, PROBE_FULL, PROBE_LEVEL = 5, 64, 128


def probe_windows(kind: str, height: int, width: int, size: int) -> list[tuple[int, int, int, int]]:
    """(y0, y1, x0, x1) of the planned windows: the ``corner``, the ``centre``, or a ``grid`` over the plane."""
    size = min(size, height, width)
    if kind == "corner":
        return [(0, size, 0, size)]
    n = 1 if kind == "centre" else PROBE_GRID
    middle = [[int(s * (k + 0.5) / n) for k in range(n)] for s in (height, width)]
    low = [[max(0, m - size // 2) for m in ms] for ms in middle]
    return [(y, min(height, y + size), x, min(width, x + size)) for y in low[0] for x in low[1]]


def probe_arrays(arrays: DataFrame, kind: str = "grid", over: str = "c", size: int | None = None, skip: Sequence[int] = ()) -> DataFrame:
    """(path, found, place, has_data, opened) of each array of the table (path, level): for every place along axis ``over`` (the others at 0) whether any planned window holds a value that is not zero.

    Windows are read one after another until one has data, so an array is never scanned; ``opened`` counts the chunks that were opened for a place. An array that is not there
    has one row, found false. Places in ``skip`` are left out (time points that may be empty). Arrays are dealt out one by one.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, level in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    array = StoredArray(path)
                except FileNotFoundError:
                    rows.append((path, False, None, False, 0))
                else:
                    shape = array.layout.shape
                    axes = AXES[-len(shape) :]
                    windows = probe_windows(kind, *shape[-2:], size or (PROBE_LEVEL if level else PROBE_FULL))
                    for place in range(shape[axes.index(over)] if over in axes[:-2] else 1):
                        if place in skip:
                            continue
                        lead, known, before = [place if a == over else 0 for a in axes[:-2]], {}, array.opened
                        hit = any(array.any_in([*lead, y0, x0], [*(i + 1 for i in lead), y1, x1], known) for y0, y1, x0, x1 in windows)
                        rows.append((path, True, place, hit, array.opened - before))
                names = ["path", "found", "place", "has_data", "opened"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)) if rows else [[]] * 5, (pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.int64()), strict=True)], names=names)

    n = max(1, int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return arrays.select("path", F.col("level").cast("int").alias("level")).repartition(n).mapInArrow(look, "path string, found boolean, place int, has_data boolean, opened long")


def store_states(probes: DataFrame) -> DataFrame:
    """(path, state): ``missing`` without an array, ``empty`` if no probe met data (created, not filled), ``partial`` if some places did, ``complete`` if all did."""
    some, every = F.bool_or("has_data"), F.bool_and("has_data")
    return probes.groupBy("path").agg(F.when(~F.bool_and("found"), "missing").when(every, "complete").when(some, "partial").otherwise("empty").alias("state"))
