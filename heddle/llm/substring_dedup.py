"""Removal of passages that stand more than once, with difference-cover anchors.

A window of ``WINDOW`` words is repeated if its word sequence starts anywhere else, in another
document or in the same one. Two equal windows at word positions i and j share, for some shift below
``PERIOD``, positions i+s and j+s whose remainders modulo ``PERIOD`` both lie in ``COVER`` (each
remainder is a difference of two elements of the cover). So only anchors of ``ANCHOR`` words at cover
positions are hashed and shuffled, 5 of 21 positions, and an anchor that stands twice marks the up to
21 windows that contain it as candidates. Candidates are extended to whole windows by a 128-bit hash
of all their words, and those are compared in the same way, so no pair of occurrences is ever formed.

Equal texts: rows are named by two hashes of the text, and a hash that only copies of one text share does not
count as repeated. Copies are counted apart; of a text that stands twice all words are repeated. So copies add
nothing to the candidates, and a slice scans each text once.

Hot passages: a task combines the equal hashes of a slice of documents before the shuffle. It sends
one marker for them, and the positions themselves travel as ranges under keys of their own. A task sends the marker of a hash once, however many of its slices hold it (as long as it
remembers ``TOLD`` of them), so a passage that a third of all documents hold adds one row per task to the task that counts it. The joins with
the texts deal the copies of a text in parts when there are many. Both read one shuffle of
the texts, which travel compressed.

Defined cases: null text has no words; repeated rows and exact copies are repeated passages, all
copies lose them; documents of fewer than ``WINDOW`` words lose nothing; an empty table gives an empty
result; other columns are not read unless ``documents`` asks for the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.textcore import SLICE, documents_per_batch, materialize, mix, pack_texts, slices, span_hashes, spans, spread_limit, unpack_texts, utf8, window_hashes

#: Words of a window.
WINDOW = 35
#: Markers that a task remembers (8 bytes each).
TOLD = 2_000_000
#: A perfect difference set: every remainder modulo 21 is a difference of two of its elements.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)

_ONE, _MARKER, _RANGE = 0, 1, 2
#: Columns of the packed texts with what is known of them: t, u, part, text, size, no_text, rest, ranges.
_TEXT, _SIZE, _RANGES = 3, 4, 7
_LOW = (1 << 31) - 1
#: Rows of a scan: text (two hashes), hash (of windows also a second one), packed place. The text comes first and the place last so that rows of one text compress well.
_ANCHORS, _WINDOWS = "t long, u long, r long, p long", "t long, u long, r long, q long, p long"


class _Words:
    """Word hashes of a slice, with each word's document and place in it."""

    def __init__(self, texts: pa.Array):
        self.buf, self.offs = utf8(texts)
        self.starts, self.ends, self.first = spans(self.buf, self.offs)
        self.n = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.n)

    def windows(self, n: int, at: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the ``n`` words from each of these places on."""
        return window_hashes(span_hashes(self.buf, self.starts, self.ends, which=which), n, at, which)


def _pack(kind: int, a: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    """One long: kind, places more, first place."""
    return np.int64(kind << 62 if kind < 2 else (kind << 62) - (1 << 64)) | (np.asarray(more, dtype=np.int64) << 31) | a.astype(np.int64)


class _Told:
    """Hashes whose marker a task has sent already, as single numbers in order; emptied when there are too many."""

    def __init__(self):
        self.sent = np.zeros(0, np.uint64)

    def known(self, h: list[np.ndarray]) -> np.ndarray:
        k = _joint(h)
        at = np.searchsorted(self.sent, k)
        return self.sent[np.minimum(at, len(self.sent) - 1)] == k if len(self.sent) else np.zeros(len(k), bool)

    def add(self, h: list[np.ndarray]) -> None:
        self.sent = np.union1d(self.sent, _joint(h)) if len(self.sent) + len(h[0]) <= TOLD else np.unique(_joint(h))


def _joint(h: list[np.ndarray]) -> np.ndarray:
    """One number of all hashes of a place."""
    with np.errstate(over="ignore"):
        return h[0].view(np.uint64) if len(h) == 1 else mix(h[0].view(np.uint64) + mix(h[1].view(np.uint64)))


def _emit(h: list[np.ndarray], owner: np.ndarray, place: np.ndarray, t: np.ndarray, u: np.ndarray, told: _Told) -> pa.RecordBatch:
    """Rows of a slice: single hashes as they are; hashes that stand more than once in it, or that the task has told before, as one marker for the task, and their places as ranges under random keys."""
    frame = pd.DataFrame(dict(enumerate(h)))
    before = told.known(h)
    many = frame.duplicated(keep=False).to_numpy() | before
    one, at = np.flatnonzero(~many), np.flatnonzero(many)
    mark = at[~frame.iloc[at].duplicated().to_numpy() & ~before[at]]
    told.add([x[mark] for x in h])
    nothing = np.zeros(len(mark), np.int64)
    parts = [(t[owner[one]], u[owner[one]], *(x[one] for x in h), _pack(_ONE, place[one])), (nothing, nothing, *(x[mark] for x in h), _pack(_MARKER, nothing))]
    if len(at):
        # a range goes on while the next hash of the slice is repeated too and belongs to the same document, without a gap above the period
        new = np.concatenate([[True], (owner[at[1:]] != owner[at[:-1]]) | (np.diff(at) > 1) | (place[at[1:]] - place[at[:-1]] > PERIOD)])
        lo = at[new]
        hi = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        key = t[owner[lo]]
        with np.errstate(over="ignore"):
            spread = mix(key.view(np.uint64) + place[lo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        parts.append((key, u[owner[lo]], *([spread] * len(h)), _pack(_RANGE, place[lo], place[hi] - place[lo])))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return pa.record_batch([pa.array(x.view(np.int64)) for x in columns], names=["t", "u", "r", "q", "p"] if len(h) == 2 else ["t", "u", "r", "p"])


def _repeated(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(t, u, set of (a, b)) of the places whose hash stands at least twice, copies of one text counting once. Places of one text only are gathered, never those of one hash, and copies in other slices add none. ``also`` adds (t, u, a, b)."""
    hashes = [c for c in ("r", "q") if c in rows.columns]
    w = Window.partitionBy(*hashes)
    # only the rows as they are cross the shuffle: the window reads plain columns, the rest is worked out above it
    ends = [f(c).over(w).alias(f"{c}{k}") for c in ("t", "u", "p") for k, f in enumerate((F.min, F.max))]
    seen = rows.select("t", "u", *hashes, "p", *ends)
    kind = F.shiftrightunsigned("p", 62)
    found = seen.where((kind == _RANGE) | ((kind == _ONE) & F.expr("t0 <> t1 OR u0 <> u1 OR p0 <> p1")))
    a = F.col("p").bitwiseAND(F.lit(_LOW)).cast("int")
    found = found.select("t", "u", a.alias("a"), (a + F.shiftright("p", 31).bitwiseAND(F.lit((1 << 30) - 1)).cast("int")).alias("b"))
    if also is not None:
        found = found.union(also)
    return found.groupBy("t", "u").agg(F.collect_set(F.struct("a", "b")).alias("at"))


def packed_text(texts: pd.Series) -> pd.Series:
    """``pack_texts`` as a scalar function: unlike a map over batches, Spark recognises its shuffle when it comes a second time."""
    return pd.Series(pack_texts(pa.array(texts, pa.string())).to_pylist())


def packed_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches so that their texts unpack to at most ``SLICE`` bytes, or one row."""
    for batch in batches:
        total, at = np.concatenate([[0], np.cumsum(batch.column(_SIZE).to_numpy())]), 0
        while at < batch.num_rows:
            to = min(max(int(np.searchsorted(total, total[at] + SLICE, side="right")) - 1, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def _first_of_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The slice with each text once."""
    again = pd.DataFrame({k: batch.column(k).to_numpy() for k in (0, 1)}).duplicated().to_numpy()
    return batch.filter(pa.array(~again)) if again.any() else batch


def _ranges(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner row, a and b of all ranges of a slice."""
    lists = batch.column(column)
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    return np.repeat(np.arange(len(n)), n), flat.field(0).to_numpy(), flat.field(1).to_numpy()


def _cover(size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Flags of the places in any half-open range [lo, hi)."""
    return np.cumsum(np.bincount(lo, minlength=size + 1) - np.bincount(hi, minlength=size + 1))[:size] > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, documents: bool = False, chars_col: str = "n_chars") -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) or, with ``documents``, the rows of ``docs`` with their texts cut (removed words go with the white space behind them) and ``chars_col`` counted again where a text was."""
    documents_per_batch(docs.sparkSession)
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"a window needs at least {PERIOD} words")
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True
    text = F.col(text_col).cast("string")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest") if documents else F.struct(F.col(id_col).cast("long").alias(id_col)).alias("rest")
    name = [F.coalesce(F.xxhash64(text), F.lit(0)).alias("t"), F.coalesce(F.xxhash64(text, F.lit(1)), F.lit(0)).alias("u")]
    base = docs.select(*name, F.coalesce(text, F.lit("")).alias("text"), text.isNull().alias("no_text"), rest)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _Told()
        for batch in map(_first_of_text, slices(batches, "text")):
            w = _Words(batch.column(2))
            n = w.n[w.owner]
            at = np.flatnonzero(cover[w.place % PERIOD] & (w.place + anchor <= n) & (n >= window))
            yield _emit([w.windows(anchor, at)], w.owner[at], w.place[at], batch.column(0).to_numpy(), batch.column(1).to_numpy(), told)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _Told()
        for batch in map(_first_of_text, packed_slices(batches)):
            w = _Words(unpack_texts(batch.column(_TEXT), batch.column(_SIZE)))
            owner, a, b = _ranges(batch, _RANGES)
            base_at, last = w.first[:-1][owner], w.n[owner] - window
            good = last >= 0
            base_at, last, a, b = base_at[good], last[good], a[good], b[good]
            at = np.flatnonzero(_cover(len(w.place), base_at + np.maximum(a - PERIOD + 1, 0), base_at + np.minimum(b, last) + 1))
            yield _emit([w.windows(window, at, k) for k in (0, 1)], w.owner[at], w.place[at], batch.column(0).to_numpy(), batch.column(1).to_numpy(), told)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packed_slices(batches):
            buf, offs = utf8(unpack_texts(batch.column(_TEXT), batch.column(_SIZE)))
            starts, ends, first = spans(buf, offs)
            owner, a, b = _ranges(batch, _RANGES)
            n = np.diff(first)[owner]
            good = n >= window
            owner, a, b = owner[good], a[good].astype(np.int64), np.minimum(b[good], n[good] - window)
            gone = _cover(len(starts), first[:-1][owner] + a, first[:-1][owner] + b + window)
            raw = buf.tobytes()
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            digests, cut_texts = [], []
            for i, n in enumerate(removed.tolist()):
                data = raw[offs[i] : offs[i + 1]]
                words = data.split()
                if n:
                    flags = gone[first[i] : first[i + 1]]
                    words = [x for x, g in zip(words, flags.tolist(), strict=True) if not g]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if documents and n:
                    s = starts[first[i] : first[i + 1]] - offs[i]
                    upto = np.append(s[1:], len(data))
                    data = np.frombuffer(data, dtype=np.uint8)[~_cover(len(data), s[flags], upto[flags])].tobytes()
                if documents:
                    cut_texts.append(None if batch.column(_SIZE + 1)[i].as_py() else data.decode("utf-8"))
            columns = [batch.column(_SIZE + 2), pa.array(np.diff(first)), pa.array(removed), pa.array(digests)]
            names = ["rest", "n_words", "n_removed", "kept_sha256"]
            yield pa.record_batch(columns + [pa.array(cut_texts, pa.string())], names=[*names, "text"]) if documents else pa.record_batch(columns, names=names)

    # texts that stand more than once; the copies of those that stand very often are dealt in parts, and what is known of the text goes to each part
    copies = materialize(docs.where(text.isNotNull()).select(*name).groupBy("t", "u").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    limit = spread_limit(copies.agg(F.sum("n")).first()[0] or 0)
    hot = F.broadcast(copies.where(F.col("n") > limit).select("t", "u", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("parts")))
    spread = lambda df: df.join(hot, ["t", "u"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    first = _repeated(base.select("t", "u", "text").mapInArrow(anchors, _ANCHORS))
    # both joins read all columns of the packed texts, so that Spark shuffles them once
    part = F.coalesce(F.pmod(F.xxhash64(F.col(f"rest.`{id_col}`").cast("string")), F.col("parts")), F.lit(0)).cast("int")
    packed = base.select("t", "u", F.pandas_udf(packed_text, "binary")("text").alias("z"), F.octet_length("text").alias("size"), "no_text", "rest")
    packed = packed.join(hot, ["t", "u"], "left").select("t", "u", part.alias("part"), "z", "size", "no_text", "rest")
    candidates = packed.join(spread(first), ["t", "u", "part"]).mapInArrow(extend, _WINDOWS)
    second = _repeated(candidates, copies.select("t", "u", F.lit(0).alias("a"), F.lit(_LOW).alias("b")))
    kind = base.schema["rest"].dataType.simpleString()
    out = f"rest {kind}, n_words long, n_removed long, kept_sha256 string" + (", text string" if documents else "")
    done = packed.join(spread(second), ["t", "u", "part"], "left").mapInArrow(cut, out)
    if documents:
        column = {c: F.col("text") if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns}
        if chars_col in column:
            column[chars_col] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(column[chars_col]).cast(docs.schema[chars_col].dataType)
        return done.select(*[v.alias(c) for c, v in column.items()])
    return done.select(F.col(f"rest.{id_col}").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
