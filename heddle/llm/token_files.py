"""Token-ID output: Arrow IPC files of fixed-size-list batches.

Documents are range-partitioned and sorted by id, each range is encoded by one task and written as
one shard: ``NNNNN.tokens.arrow`` holds ``ids: fixed_size_list<uint16|uint32>[L]`` and
``mask: fixed_size_list<bool>[L]`` (false only on the padding that fills the shard's last
sequence), ``NNNNN.docs.arrow`` the documents' place in it. Fixed-size lists are one flat buffer, so
sequence ``k`` of a memory-mapped shard is a zero-copy view (``SequenceFile.sequence``).

A task writes under a name of its own attempt and renames at the end, so a lost executor leaves no
half shard behind; a retried task writes the same bytes again.

Defined cases: null text is encoded as the empty text and has only the end id; null ids sort first;
rows with the same id, or without one, are ordered by a hash of their text and may lie in several shards;
repeated rows are encoded as often as they stand in the table; an empty table gives no shards and no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.piece_cache import PieceCache
from heddle.llm.textcore import documents_per_batch, partitions_for, shared_folder, slices, spans, utf8

#: Ids of one sequence of the files.
SEQUENCE = 2048
#: Sequences of one record batch.
ROWS = 512
#: Bytes of text of one shard, at most about; there are as many shards as the session has shuffle partitions, or more.
SHARD_BYTES = 256 << 20

_FLAGS = np.zeros(256, dtype=np.uint8)
_LETTER, _MARK, _TICK = 1, 2, 4
for _c in range(33, 127):
    _FLAGS[_c] = _LETTER if chr(_c).isalnum() else _MARK | (_TICK if chr(_c) == "'" else 0)


class WordEncoder:
    """Encodes texts with a tokenizers file whose pre-tokenizer drops white space and parts letters and digits from marks, so that such pieces can be encoded on their own.

    A text is cut where no pre-token can cross and no normalisation can look across: at ASCII white space, between
    an ASCII letter or digit and an ASCII mark behind it, and between an ASCII mark and an ASCII letter or
    digit behind it, unless the mark is an apostrophe (contractions). A run without white space that holds
    ``<|`` is not cut further (special tokens are matched as written), and nothing is cut beside a character above ASCII.
    A piece of ASCII characters without ``<|`` is lower-cased, as the tokenizer would do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cache = PieceCache(lambda pieces: [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        buf, offs = utf8(texts)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        flags = _FLAGS[buf]
        left, right = flags[:-1], flags[1:]
        cut = ((left == _LETTER) & (right & _MARK > 0)) | ((left == _MARK) & (right == _LETTER))
        special = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))
        special = special[~np.isin(special + 1, offs)]
        lo, hi, _ = spans(buf, offs)
        whole = np.unique(np.searchsorted(lo, special, side="right") - 1)  # runs with a special token's start
        for a, b in zip(lo[whole].tolist(), hi[whole].tolist(), strict=True):
            cut[a : b - 1] = False
        starts, ends, _ = spans(buf, np.union1d(offs, np.flatnonzero(cut) + 1))
        edges = np.empty(2 * len(starts), dtype=np.int64)
        edges[0::2], edges[1::2] = starts, ends
        as_is = np.maximum.reduceat(buf, edges[:-1])[0::2] >= 128 if len(starts) else np.zeros(0, bool)
        as_is[np.searchsorted(starts, special, side="right") - 1] = True
        low = buf | (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
        for k in np.flatnonzero(as_is).tolist():
            low[starts[k] : ends[k]] = buf[starts[k] : ends[k]]
        ids, counts = self.cache.ids(low, starts, ends)
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(before[np.searchsorted(starts, offs)])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, built once per Python worker and kept for its later tasks."""
    return WordEncoder(path)


class SequenceFile:
    """Random access to the sequences and masks of one shard, without copying."""

    def __init__(self, source):
        self.reader = ipc.open_file(source)
        rows = [self.reader.get_batch(i).num_rows for i in range(self.reader.num_record_batches)]
        self.first = np.concatenate([[0], np.cumsum(rows)]).astype(np.int64)
        self.length = self.reader.schema.field("ids").type.list_size

    def __len__(self) -> int:
        return int(self.first[-1])

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file's bytes) and mask of sequence ``k``."""
        b = int(np.searchsorted(self.first, k, side="right")) - 1
        batch, at = self.reader.get_batch(b), int(k - self.first[b])
        ids = batch.column(0)
        return ids.values.slice((ids.offset + at) * self.length, self.length).to_numpy(zero_copy_only=True), batch.column(1)[at].values

    def tokens(self) -> Iterator[np.ndarray]:
        """The ids of each batch in order, without padding."""
        for i in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(i)
            ids, mask = batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten()
            yield ids if mask.true_count == len(mask) else ids[mask.to_numpy(zero_copy_only=False)]


def _schema(dtype: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", dtype, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])


class _Writer:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.dtype, self.length, self.schema = dtype, length, _schema(pa.from_numpy_dtype(dtype), length)
        self.out, self.rest, self.total = ipc.new_file(sink, self.schema), np.zeros(0, dtype), 0

    def _batch(self, ids: np.ndarray, filled: int) -> None:
        for at in range(0, len(ids), self.length * ROWS):
            part = ids[at : at + self.length * ROWS]
            mask = np.arange(at, at + len(part)) < filled
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((part, mask), self.schema, strict=True)]
            self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(self.dtype)])
        whole = len(self.rest) // (self.length * ROWS) * (self.length * ROWS)
        if whole:
            self._batch(self.rest[:whole], whole)
            self.rest = self.rest[whole:].copy()

    def close(self) -> None:
        if n := len(self.rest):
            self._batch(np.concatenate([self.rest, np.zeros(-n % self.length, self.dtype)]), n)
        self.out.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE) -> list[tuple[int, int, int]]:
    """Write the shards under ``folder`` (a URI); returns (shard, documents, ids) of each shard in order of the document ids. The driver gets one row per shard and no more."""
    documents_per_batch(docs.sparkSession)
    wide = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer)
        dtype = np.dtype(np.uint16 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32)
        fs, base = pafs.FileSystem.from_uri(folder)
        own = f".{TaskContext.get().taskAttemptId()}.tmp"
        writer, index, n = None, None, 0
        for batch in slices(batches, "text"):
            if writer is None:
                fs.create_dir(base, recursive=True)
                tokens, places = fs.open_output_stream(f"{base}/{k:05d}.tokens.arrow{own}"), fs.open_output_stream(f"{base}/{k:05d}.docs.arrow{own}")
                writer = _Writer(tokens, dtype, length)
                index = ipc.new_file(places, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
            ids, counts = encoder.encode(batch.column(1))
            stop = np.cumsum(counts)
            start = writer.total + stop - counts + np.arange(len(counts))
            writer.add(np.insert(ids, stop, end_id))
            index.write_batch(pa.record_batch([batch.column(0), pa.array(start), pa.array(counts + 1)], schema=index_schema))
            n += len(counts)
        if writer is not None:
            writer.close()
            index.close()
            tokens.close()
            places.close()
            for kind in ("tokens", "docs"):
                fs.move(f"{base}/{k:05d}.{kind}.arrow{own}", f"{base}/{k:05d}.{kind}.arrow")
            yield pa.record_batch([pa.array([k]), pa.array([n]), pa.array([writer.total])], names=["shard", "n_docs", "n_ids"])

    index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    # shards of about SHARD_BYTES of text; rows without an id, or with one that many rows have, are dealt further by a hash of their text
    total = wide.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = wide.repartitionByRange(partitions_for(docs, -(-total // SHARD_BYTES)), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = ordered.mapInArrow(shard, "shard long, n_docs long, n_ids long").collect()
    return sorted((r.shard, r.n_docs, r.n_ids) for r in done)


def read_token_files(spark, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """Documents found in the shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32 of the ids as little-endian 32-bit integers, shard, n_sequences."""
    before, rows = 0, []
    for k, _, n in shards:
        rows.append((k, before))
        before += n
    out = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, shard_sequences long"
    if not rows:
        return spark.createDataFrame([], out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for k, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, held, at = ipc.open_file(fs.open_input_file(f"{base}/{k:05d}.docs.arrow")), np.zeros(0, np.uint32), 0
                source = SequenceFile(fs.open_input_file(f"{base}/{k:05d}.tokens.arrow"))
                stream = source.tokens()
                for i in range(places.num_record_batches):
                    docs = places.get_batch(i)
                    firsts, counts = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crcs = np.empty(len(counts), dtype=np.int64)
                    for j, (a, n) in enumerate(zip(firsts.tolist(), counts.tolist(), strict=True)):
                        while at + len(held) < a + n:
                            held, at = np.concatenate([held[a - at :], next(stream).astype("<u4")]), a
                        crcs[j] = zlib.crc32(held[a - at : a - at + n].tobytes())
                    same = pa.array(np.full(len(counts), k)), pa.array(np.full(len(counts), len(source)))
                    yield pa.record_batch([docs.column(0), pa.array(firsts + start), docs.column(2), pa.array(crcs), *same], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_sequences"])

    listed = spark.createDataFrame(rows, "shard long, start long")
    return listed.repartitionByRange(len(rows), "shard").mapInArrow(read, out)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **columns) -> DataFrame:
    """Write the token files of ``docs`` and read them back (see ``read_token_files``)."""
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer, end_id, **columns))
