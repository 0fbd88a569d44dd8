"""SentencePiece models on the tokenizers library.

The model file is a protocol buffer; ``read_model`` parses the few fields needed from its wire
format. ``build_tokenizer`` rebuilds the pipeline: the compiled normaliser map when there is one, the
white-space marker with its dummy prefix, the unigram scores (or, for a BPE model, the merges in
order of the scores) and the byte fallback.

``PieceCodec`` hands texts to the library, a slice of a batch in one call, which uses as many
threads as TOKENIZERS_PARALLELISM and RAYON_NUM_THREADS allow. Where no piece of a BPE model holds a marker behind another
character, no merge can cross the start of a run of markers: ``encode_flat`` cuts texts there and hands each
distinct part to the library once (``PartCache``). Other models get whole texts. Whole texts are decoded by the library's
decoder. ``encode_pieces`` compares the ids of every row with those of the sentencepiece library for the whole text
and the decoded text with the original.

Defined cases: null is encoded as the empty text, which has no ids and decodes to the empty text; a text that
holds the marker U+2581 itself decodes to a space there, in either library, so its ``round_trip`` is false;
repeated rows are encoded each by itself; null ids pass through; an empty table gives an empty result; columns other
than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.piece_cache import PieceCache
from heddle.llm.textcore import documents_per_batch, slices, utf8

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text handed to the library at once.
SLICE_BYTES = 1 << 20
#: Distinct parts, and ids of them, held by one Python worker before the cache is emptied.
CACHE_PARTS, CACHE_IDS = 1_000_000, 8_000_000
#: New parts handed to the library as one text: a text of its own costs it more than the letters of a short part.
JOINED = 50


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one message of the wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield number, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {wire} is not part of the model format")


def read_model(path: str) -> Model:
    model = Model()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:  # a piece: 1 text, 2 score, 3 kind
            piece = dict(_fields(value))
            model.pieces.append(piece.get(1, b"").decode("utf-8"))
            model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            model.kinds.append(piece.get(3, NORMAL))
        elif number == 2:  # trainer: 3 model kind, 35 byte fallback
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:  # normaliser: 2 compiled map, 3 dummy prefix, 4 squeeze spaces, 5 escape spaces
            normal = dict(_fields(value))
            model.charsmap = normal.get(2, b"")
            model.dummy_prefix, model.squeeze_spaces, model.escape_spaces = (bool(normal.get(k, 1)) for k in (3, 4, 5))
    return model


def build_tokenizer(model: Model):
    """A tokenizers.Tokenizer equal to the model."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, p in enumerate(model.pieces)}
    unk = model.kinds.index(UNKNOWN) if UNKNOWN in model.kinds else None
    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unk, model.byte_fallback)
    elif model.kind == BPE:
        rank = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] in (NORMAL, USER_DEFINED)}
        merges = []
        for piece, i in rank.items():
            pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
            merges += [(-model.scores[i], i, rank[a], rank[b], a, b) for a, b in pairs]
        core = models.BPE(vocab, [m[-2:] for m in sorted(merges)], unk_token=None if unk is None else model.pieces[unk], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        from tokenizers import Regex

        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " ")]  # one replacement in the whole text, not one per token
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return tokenizer


class PieceCodec:
    """Encodes and decodes whole texts with a model file."""

    def __init__(self, path: str):
        self.model = read_model(path)
        self.tokenizer = build_tokenizer(self.model)
        self.is_byte = np.array([k == BYTE for k in self.model.kinds])

    @cached_property
    def parts(self) -> PartCache | None:
        """Made when first used: callers of ``encode`` alone do not need it."""
        return PartCache(self.model) if self._has_parts() else None

    def _has_parts(self) -> bool:
        """Whether a text may be cut before each run of markers: no piece goes on across that place, and no unknown character or normalisation does."""
        m = self.model
        plain = m.kind == BPE and m.escape_spaces and not m.squeeze_spaces and not m.charsmap and m.byte_fallback and m.kinds.count(BYTE) == 256
        return plain and MARK in m.pieces and not any(MARK in p.lstrip(MARK) for p in m.pieces)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``encode`` one after another and their number per text."""
        if self.parts is None:
            return flat_ids(self.encode(texts))
        prefix = " " if self.model.dummy_prefix else ""
        buf, offs = utf8(pa.array([prefix + t if t else "" for t in texts], pa.string()))
        space, cut = buf == 32, np.zeros(len(buf) + 1, dtype=bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)) + 3] = False  # behind a marker in the text itself
        cut[offs] = True
        edges = np.flatnonzero(cut)
        ids, counts = self.parts.ids(buf, edges[:-1], edges[1:])
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(edges, offs)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the empty text has none."""
        return [e.ids if t else [] for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


class PartCache(PieceCache):
    """Ids of the parts of texts between the starts of runs of markers."""

    def __init__(self, model: Model, limit: int = CACHE_PARTS, most_ids: int = CACHE_IDS):
        from tokenizers import normalizers

        tokenizer = build_tokenizer(model)
        tokenizer.normalizer = normalizers.Sequence([])  # parts come with their markers, and the first one of a text with its prefix
        super().__init__(lambda parts: [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)], limit)
        self.most_ids = most_ids
        self.sizes = np.array([1 if k == BYTE else len(p.encode("utf-8")) for p, k in zip(model.pieces, model.kinds, strict=True)])

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > self.most_ids:
            self._clear()
        return super().ids(buf, starts, ends)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts that start, but do not end, with a marker are joined; the sizes of the tokens tell where each part ends."""
        parts, runs = [p.replace(" ", MARK) for p in pieces], [[]]
        for p in parts:
            if p[0] != MARK or p[-1] == MARK:
                runs += [[p], []]
            elif len(runs[-1]) < JOINED:
                runs[-1].append(p)
            else:
                runs.append([p])
        flat, _ = flat_ids(self.encode(["".join(r) for r in runs if r]))
        stop = np.cumsum([len(p.encode("utf-8")) for p in parts])
        return flat, np.diff(np.searchsorted(np.cumsum(self.sizes[flat]), stop) + 1, prepend=0).astype(np.int32)


def flat_ids(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after another and their number per text."""
    counts = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(counts.sum())), counts


@lru_cache(maxsize=2)
def codec_of(path: str) -> PieceCodec:
    """The codec of a model file, built once per Python worker and kept for its later tasks."""
    return PieceCodec(path)


@lru_cache(maxsize=2)
def reference_of(path: str):
    """The other library's processor of a model file, to compare with."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, compare: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    One row per document row: doc_id, n_tokens, n_byte_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), round_trip (the decoded text is the original), parity (ids equal to the
    sentencepiece library's; null unless ``compare``) and, with ``keep_ids``, token_ids.
    """
    documents_per_batch(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, other = codec_of(model), reference_of(model) if compare else None
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = batch.column(1).fill_null("").to_pylist()
            ids, counts = codec.encode_flat(texts)
            stop = np.concatenate([[0], np.cumsum(counts)])
            rows = np.split(ids, stop[1:-1])
            same = [a == b for a, b in zip(texts, codec.decode([r.tolist() for r in rows]), strict=True)]
            parity = [np.array_equal(a, b) for a, b in zip(rows, other.encode(texts, num_threads=1, out_type="numpy"), strict=True)] if compare else [None] * len(rows)
            bytes_n = np.diff(np.searchsorted(np.flatnonzero(codec.is_byte[ids]), stop))
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(counts), "n_byte_tokens": pa.array(bytes_n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same, pa.bool_()), "parity": pa.array(parity, pa.bool_())}
            if keep_ids:
                out["token_ids"] = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch(list(out.values()), names=list(out))

    kind = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean, parity boolean"
    return read.mapInArrow(code, kind + (", token_ids array<int>" if keep_ids else ""))
