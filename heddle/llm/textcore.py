"""Vectorised word scanning and hashing over Arrow string batches, and the shared folder.

Everything here works on the UTF-8 bytes of a whole Arrow column at once, so a task's cost is a few
NumPy passes per byte and not a Python loop per document. Memory is bounded by ``BLOCK`` (bytes
hashed at once) plus 24 bytes per word of one slice of documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the operators (one longer document makes a slice of its own).
SLICE = 4 << 20
#: Bytes hashed at once inside a slice.
BLOCK = 1 << 20

_U = np.uint64
#: Fixed odd multipliers of the finalising mixer.
_MIX1 = _U(0xBF58476D1CE4E5B9)
_MIX2 = _U(0x94D049BB133111EB)
#: Bytes of a span hashed by weights; longer spans (rare) are hashed by BLAKE2.
WEIGHED = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _MIX1
        x = (x ^ (x >> _U(27))) * _MIX2
        return x ^ (x >> _U(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Every byte counts as a number from 1 to 256, so a NUL is not the same as nothing.
_BYTE_CODE = np.arange(1, 257, dtype=np.uint64)
_BYTE_CODE_FOLDED = _BYTE_CODE[_FOLD]
#: ASCII white space is the only separator of words: space and 0x09 to 0x0D.
IS_WORD_BYTE = np.ones(256, dtype=bool)
IS_WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def _weights(seed: int, n: int) -> np.ndarray:
    """``n`` independent odd 64-bit weights."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(n, dtype=np.uint64) + _U(seed << 32)) + _U(0xA0761D6478BD642F)) | _U(1)


_SPAN_WEIGHTS = _weights(1, WEIGHED), _weights(2, WEIGHED)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the document offsets in them (a null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``text``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def spans(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray = IS_WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (maximal runs of ``keep`` bytes inside a document), and the first word of each document."""
    inside = keep[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(len(buf), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(buf), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, which ascend, do not overlap and are not empty; ``fold`` lower-cases A-Z.

    A hash is the sum of the bytes times independent weights of their places (no power of one number, so
    no pattern of letters cancels): two different spans agree with a probability below 2**-55. ``which`` (0
    or 1) names one of two independent hashes; together they have twice as many bits.
    """
    code, weight = _BYTE_CODE_FOLDED if fold else _BYTE_CODE, _SPAN_WEIGHTS[which]
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            lo = int(starts[at])
            to = max(int(np.searchsorted(ends, lo + BLOCK, side="right")), at + 1)
            hi = min(int(ends[to - 1]), lo + max(BLOCK, WEIGHED))  # a longer span is hashed below
            s, e = starts[at:to] - lo, np.minimum(ends[at:to], hi) - lo
            place = np.arange(hi - lo) - np.repeat(s, np.diff(np.append(s, hi - lo)))
            value = code[buf[lo:hi]] * weight.take(place, mode="clip")
            edges = np.empty(2 * len(s), dtype=np.int64)
            edges[0::2], edges[1::2] = s, e
            out[at:to] = np.add.reduceat(value, edges[:-1])[0::2]
            at = to
    out = mix(out)
    for k in np.flatnonzero(ends - starts > WEIGHED).tolist():
        data = buf[starts[k] : ends[k]]
        digest = hashlib.blake2b((_FOLD[data] if fold else data).tobytes(), digest_size=16).digest()
        out[k] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
    return out


def window_hashes(words: np.ndarray, n: int, at: np.ndarray | None = None, which: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes, or of those that start at ``at``; the caller drops runs that cross documents. Independent weights, as for spans."""
    m = len(words) - n + 1 if at is None else len(at)
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    weight, out = _weights(3 + which, n), np.empty(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, m, BLOCK):
            hi, total = min(m, lo + BLOCK), np.zeros(min(m, lo + BLOCK) - lo, dtype=np.uint64)
            for k in range(n):
                total += (words[lo + k : hi + k] if at is None else words[at[lo:hi] + k]) * weight[k]
            out[lo:hi] = total
    return mix(out)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges ``start .. start + count - 1``."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


def pack_texts(column: pa.Array) -> pa.Array:
    """Each text as a zstd frame: a shuffle moves two fifths of the bytes. Nulls stay null."""
    codec = pa.Codec("zstd", compression_level=1)
    return pa.array([None if t is None else codec.compress(t.encode("utf-8", "surrogatepass"), asbytes=True) for t in column.to_pylist()], pa.binary())


def unpack_texts(column: pa.Array, sizes: pa.Array) -> pa.Array:
    """Texts of ``pack_texts``, given their sizes in bytes."""
    codec = pa.Codec("zstd")
    return pa.array([None if z is None else codec.decompress(z, n, asbytes=True) if n else b"" for z, n in zip(column.to_pylist(), sizes.to_pylist(), strict=True)], pa.binary()).cast(pa.string())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a local one serves a local master (tests, one machine); a cluster without it is an error, as its machines share no local folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet to the shared folder and read it back. A lost executor then costs no stage before it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what ``materialize`` has written, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Rows and bytes of an Arrow batch: documents have kilobytes, some megabytes, and a batch is held by the JVM and the Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def documents_per_batch(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes (or one row), if they are larger."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def partitions_for(df, floor: int = 1) -> int:
    """Shuffle partitions of the session, as a lower bound for explicit repartitions."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows of one key that a task gets at most, in a spread join of rows without texts.
SPREAD_ROWS = 1000


def spread_limit(total: int, rows: int = SPREAD_ROWS) -> int:
    """Rows from which a key counts as hot among ``total`` rows: at most 50,000 keys can be, so a table of them may be broadcast."""
    return max(rows, total // 50_000)


def spread_join(rows: DataFrame, low: DataFrame, key: str, limit: int) -> DataFrame:
    """Inner join of ``rows`` with ``low``, which has one row for each key with its number ``n`` of rows. Keys of more than ``limit`` rows (see ``spread_limit``) are dealt in parts, so no task gets all rows of one key."""
    parts = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    hot = low.where(F.col("n") > limit).select(key, parts.alias("_parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")), F.lit(0)).cast("int")
    dealt = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_parts").join(dealt, [key, "_salt"]).drop("_salt")
