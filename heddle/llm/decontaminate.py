"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are lower-cased (A-Z) and reduced to words of ASCII letters, digits and non-ASCII
characters, and words to their numbers in the items' vocabulary. Every run of ``WINDOW`` consecutive words of an
item is a window (an item of fewer words is one window). The automaton holds a node for each item word at most: its patterns are the
short items and, of the others, the aligned blocks of half a window, one of which lies inside every window. Each
document is scanned once; where a block is met, the document's windows around it are looked up among the items'
windows (by two independent hashes). Hits are mapped back to the words and to character offsets of the original text.

A worker builds the automaton once. It takes about 25 bytes a byte of item text, so a benchmark of up to ``BLOCK_BYTES``
is one automaton; of a larger one each part is a pass of its own, written to the shared folder in between.

Defined cases: null or wordless texts have no words and no hits; null or wordless items and items
with a null id are no items; items with the same id count once; repeated rows give repeated rows;
an empty benchmark hits nothing; extra columns are kept out of the scan.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.textcore import documents_per_batch, materialize, mix, ragged, slices, window_hashes

#: Words of a window.
WINDOW = 10
#: Bytes of item text in one automaton.
BLOCK_BYTES = 32 << 20

#: ASCII other than letters and digits becomes a space, A-Z lower case; other bytes stay.
_NORMAL = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: The same words in the original text, where A-Z are still upper case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


class Matcher:
    """The automaton over word numbers and the sorted window hashes of a list of (id, text) items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        self.window, self.part = window, (window + 1) // 2
        self.names = sorted({k for k, _ in items})
        place = {k: i for i, k in enumerate(self.names)}
        numbers: dict[bytes, int] = {}
        short: dict[tuple[int, ...], set[int]] = {}
        blocks: set[tuple[int, ...]] = set()
        flat, owner, at = array("q"), array("q"), array("q")
        for name, text in items:
            words = [numbers.setdefault(w, len(numbers) + 1) for w in normal_words(text)]
            if len(words) >= window:
                at.extend(range(len(flat), len(flat) + len(words) - window + 1))
                owner.extend([place[name]] * (len(words) - window + 1))
                flat.extend(words)
                blocks.update(tuple(words[i : i + self.part]) for i in range(0, len(words) - self.part + 1, self.part))
            elif words:
                short.setdefault(tuple(words), set()).add(place[name])
        self.numbers, self.automaton = numbers, None
        if short or blocks:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for p in blocks:
                self.automaton.add_word(p, (0, ()))  # a part of a window
            for p, who in short.items():  # (words of a whole item, who has it), perhaps a part of a window as well
                self.automaton.add_word(p, (len(p) if p not in blocks else -len(p), tuple(sorted(who))))
            self.automaton.make_automaton()
        first, second = self._hashes(np.frombuffer(flat, dtype=np.int64), np.frombuffer(at, dtype=np.int64))
        found = pd.DataFrame({"h": first, "g": second, "o": np.frombuffer(owner, dtype=np.int64)}).drop_duplicates().sort_values(["h", "g", "o"])
        self.first, self.second, self.owner = (found[c].to_numpy() for c in ("h", "g", "o"))

    def _hashes(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(window_hashes(mix(words.astype(np.uint64) + np.uint64(k << 60)), self.window, at, k) for k in (0, 1))

    def hits(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[int]]:
        """Words of a text, merged hit ranges of words [from, to), item indexes."""
        words = text.translate(_NORMAL).split()
        if self.automaton is None or not words:
            return len(words), [], []
        get = self.numbers.get
        line = tuple([get(w, 0) for w in words])
        ranges, who, around = [], set(), set()
        for end, (n, items) in self.automaton.iter(line):
            if n:
                ranges.append((end + 1 - abs(n), end + 1))
                who.update(items)
            if n <= 0:
                around.update(range(max(0, end + 1 - self.window), min(end + 2 - self.part, len(words) - self.window + 1)))
        if around:
            at = np.array(sorted(around), dtype=np.int64)
            h, g = self._hashes(np.array(line, dtype=np.int64), at)
            lo, hi = np.searchsorted(self.first, h, side="left"), np.searchsorted(self.first, h, side="right")
            row = ragged(lo, hi - lo)
            k = np.repeat(np.arange(len(at)), hi - lo)
            same = self.second[row] == g[k]
            ranges += [(a, a + self.window) for a in np.unique(at[k[same]]).tolist()]
            who.update(np.unique(self.owner[row[same]]).tolist())
        return len(words), merge(ranges), sorted(who)


_built: dict[str, Matcher] = {}


def matcher_of(key: str, items: list[tuple[str, str]], window: int) -> Matcher:
    """The matcher of a block of items, built once per Python worker; only the last one is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, window)
    return _built[key]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, sorted."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about ``block_bytes`` of text, at least one; the driver holds two blocks at a time."""
    block, size, some = [], 0, False
    for r in items.toLocalIterator():
        block.append((r.item, r.text))
        size += len(r.text)
        if size >= block_bytes:
            yield block
            block, size, some = [], 0, True
    if block or not some:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, documents: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted ids with occurring windows), hit_words and hit_chars (flat from/to pairs; the latter are offsets into the original text). With ``documents``, the rows of ``docs`` without a hit, as they are."""
    documents_per_batch(docs.sparkSession)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]) if documents else F.struct(F.col(id_col).cast("long").alias("doc_id"))
    read = docs.select(rest.alias("rest"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    state = read.select("rest", "text", F.lit(None).cast("array<long>").alias("hit_words"), F.array().cast("array<string>").alias("items"))
    kind = f"rest {read.schema['rest'].dataType.simpleString()}, text string, hit_words array<long>, items array<string>"

    def scan(shared, key: str, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                matcher = matcher_of(key, shared.value, window)
                texts, n_words, where, who, chars = batch.column(1).to_pylist(), [], [], [], []
                for text, flat, names in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    n, ranges, ids = matcher.hits((text or "").encode("utf-8", "replace"))
                    ranges = merge(ranges + list(zip(flat[0::2], flat[1::2], strict=True))) if flat else ranges
                    n_words.append(n)
                    where.append(ranges)
                    who.append(sorted({*names, *(matcher.names[k] for k in ids)}))
                    at = [m.span() for m in _WORD.finditer(text)] if last and ranges else []
                    chars.append([x for a, b in ranges for x in (at[a][0], at[b - 1][1])] if at else [])
                columns = {"rest": batch.column(0), "text": batch.column(1), "hit_words": pa.array([[y for r in x for y in r] for x in where], pa.list_(pa.int64())), "items": pa.array(who, pa.list_(pa.string()))}
                if last:
                    columns |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array([sum(b - a for a, b in x) for x in where], pa.int64()), "hit_chars": pa.array(chars, pa.list_(pa.int64()))}
                    if not documents:
                        del columns["text"]
                yield pa.record_batch(list(columns.values()), names=list(columns))

        return run

    parts = _blocks(items, block_bytes)
    block = next(parts)
    while block is not None:
        after = next(parts, None)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        if after is None:
            out = state.mapInArrow(scan(shared, uuid.uuid4().hex, True), (kind if documents else kind.replace(", text string", "")) + ", n_words long, n_hit long, hit_chars array<long>")
        else:
            state = materialize(state.mapInArrow(scan(shared, uuid.uuid4().hex, False), kind), "hits")
        block = after
    if documents:
        return out.where("n_hit = 0").select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
    return out.select("rest.doc_id", "n_words", "n_hit", "items", "hit_words", "hit_chars")
