"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

1. A document's set holds its distinct word shingles, each as two independent 64-bit hashes. Documents with equal sets form
   one class; only one document of a class goes on.
2. A signature has ``SLOTS`` slots of ``BITS`` bits, each the scrambled minimum of the set under one hash
   function. Slots of two sets agree with the probability of their Jaccard similarity, so the distance
   (slots that differ) of a pair at the threshold is binomial; ``max_distance`` is the least radius
   that misses such a pair with a probability of at most ``MISS``.
3. The Hamming join finds *all* pairs within that radius r: the slots are split into m chunks with
   allowed errors t_i where sum(t_i + 1) > r, so by the pigeonhole principle such a pair differs in at
   most t_i slots of some chunk i. With t_i = 1 the allowed errors are enumerated by leaving out each
   slot of the chunk in turn: two chunks within one error share one of these keys. Keys that only one
   class has are dropped before the signatures are attached.
4. Within a key, classes are compared by signature block by block (``BLOCK`` classes at once), and only a
   spanning forest of the pairs within r leaves a block, never all pairs. The forest's components hold
   every candidate pair together.
5. Inside such a component all pairs are confirmed on their full sets, again in blocks and again as
   spanning forests, and the components of the confirmed links are the result.

A large group is split into blocks, and pairs of blocks are tasks of their own: a group of G classes
sends G * ceil(G / BLOCK) rows, holds at most two blocks in memory, and no task gets the whole group.

Defined cases: null and empty texts have an empty set and link with nothing; repeated ids count as one
document, linked through its rows; a null id links with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.components import components
from heddle.llm.textcore import BLOCK as BLOCK_BYTES
from heddle.llm.textcore import documents_per_batch, materialize, mix, partitions_for, slices, span_hashes, spans, spread_join, spread_limit, utf8, window_hashes

SLOTS, BITS = 64, 16
#: Probability with which a pair exactly at the threshold may lie beyond the radius.
MISS = 1e-4
#: Classes compared at once; a task holds the signatures or sets of two blocks.
BLOCK = 512

with np.errstate(over="ignore"):
    _A = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    _B = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xAF251AF3B0F025B5))


def max_distance(similarity: float, slots: int = SLOTS, miss: float = MISS) -> int:
    """Least radius r with P(Binomial(slots, 1 - similarity) > r) <= miss."""
    p, tail = 1 - similarity, 1.0
    for r in range(slots + 1):
        tail -= comb(slots, r) * p**r * (1 - p) ** (slots - r)
        if tail <= miss:
            return r
    return slots


def chunks(slots: int, radius: int) -> list[tuple[int, int]]:
    """Slot ranges [from, to) of chunks with one allowed error each: m chunks with 2 * m > radius."""
    m = radius // 2 + 1
    edge = [slots * i // m for i in range(m + 1)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def shingles(texts: pa.Array, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two independent hashes of each shingle of each text, as often as it stands; a text of fewer words is one shingle, a text without words has none."""
    buf, offs = utf8(texts)
    starts, ends, first = spans(buf, offs)
    words = [span_hashes(buf, starts, ends, fold=True, which=k) for k in (0, 1)]
    windows = [window_hashes(words[k], size, which=k) for k in (0, 1)]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(tuple(w[a : b - size + 1] for w in windows))
        elif b > a:
            out.append(tuple(window_hashes(words[k][a:b], b - a, which=k) ^ np.uint64(b - a) for k in (0, 1)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    return out


def shingle_set(both: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The distinct shingles as two rows of hashes, ascending."""
    first, second = both
    order = np.argsort(first, kind="stable")
    first, second = first[order], second[order]
    same = first[1:] == first[:-1]
    if (same & (second[1:] != second[:-1])).any():  # different shingles that agree in the first hash
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    return np.stack([first, second])[:, np.append(True, ~same)] if len(first) else np.zeros((2, 0), np.uint64)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """uint16 signatures of the sets that are not empty."""
    out = np.zeros((len(sets), slots), dtype=np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        with np.errstate(over="ignore"):
            for k in range(slots):
                low = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), at).astype(np.uint32)
                out[full, k] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """Keys of each signature: for each chunk, the chunk without one of its slots."""
    wide, keys = sig.astype(np.uint64), []
    with np.errstate(over="ignore"):
        code = mix(wide + (np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(20)))
        for c, (lo, hi) in enumerate(parts):
            whole = code[:, lo:hi].sum(axis=1, dtype=np.uint64)
            for k in range(lo, hi):  # sums of scrambled slots; leaving one out names which
                keys.append(mix(whole - code[:, k] + np.uint64((c << 32) + (k << 8) + 1)))
    return np.stack(keys, axis=1)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Spanning forest of the edges (i, j) over n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def close_signatures(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose signatures differ in at most ``radius`` slots."""
    differ = np.zeros((len(left), len(right)), dtype=np.uint8)
    for k in range(left.shape[1]):
        differ += left[:, k, None] != right[None, :, k]
    return np.nonzero(differ <= radius)


def close_sets(left: list[np.ndarray], right: list[np.ndarray], ratio: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with intersection / union of at least ``ratio``, counted through an index of the right sets' elements. Elements are found by their first hash and compared by the second."""
    flat, second = np.concatenate(right, axis=1)
    owner = np.repeat(np.arange(len(right)), [s.shape[1] for s in right])
    order = np.argsort(flat, kind="stable")
    flat, second, owner = flat[order], second[order], owner[order]
    sizes = np.array([s.shape[1] for s in right])
    i, j = [], []
    for a, (s, z) in enumerate(left):
        lo, hi = np.searchsorted(flat, s, side="left"), np.searchsorted(flat, s, side="right")
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        both = np.bincount(owner[at[second[at] == np.repeat(z, n)]], minlength=len(right))
        good = np.flatnonzero((both * ratio.denominator >= ratio.numerator * (len(s) + sizes - both)) & (both > 0))
        i.append(np.full(len(good), a))
        j.append(good)
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, int), np.zeros(0, int))


def _block_pairs(rows: DataFrame, group: str, values: DataFrame, value: str) -> DataFrame:
    """Rows (g, x, y, side, node, value) dealt by pairs of blocks of each group, sorted so that a task meets each pair of blocks in one run.

    A group of up to ``BLOCK`` rows is one block. The nodes of a larger one fall into blocks by a hash,
    which needs no order within the group, and each block meets every other block once. Groups are counted by partial
    aggregation, and the join with their counts is spread, so no task gets the whole of a large group.
    """
    counts = materialize(rows.groupBy(group).agg(F.count("*").alias("n")).where("n > 1"), "counts")
    limit = spread_limit(counts.agg(F.sum("n")).first()[0] or 0, 4 * BLOCK)
    sized = spread_join(rows, counts, group, limit).select(group, "node", F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil(F.col("n") / F.lit(BLOCK * 3 // 4))).cast("int").alias("k"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int")).join(values.select("node", value), "node")
    spread = sized.select(group, "node", value, "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    spread = spread.select(F.col(group).alias("g"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("side"), "node", value)
    return spread.repartition(partitions_for(rows), "g", "x", "y").sortWithinPartitions("g", "x", "y", "side", "node")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """(whether one block is compared with itself, rows) of each pair of blocks of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in range(3)]
        new = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(c)[0].as_py() != part.column(c)[0].as_py() for c in range(3)):
                t = pa.Table.from_batches(held)
                yield t.column(1)[0].as_py() == t.column(2)[0].as_py(), t
                held = []
            held.append(part)
    if held:
        t = pa.Table.from_batches(held)
        yield t.column(1)[0].as_py() == t.column(2)[0].as_py(), t


def _links(pairs: DataFrame, close, read) -> DataFrame:
    """Spanning forests (a, b) of the close pairs of each pair of blocks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same, t in _runs(batches):
            nodes, side = t.column("node").to_numpy(), t.column("side").to_numpy()
            values = read(t.column(5).combine_chunks())
            left, right = np.flatnonzero(~side), np.flatnonzero(side)
            if same:
                right = left
            if not len(left) or not len(right) or len(nodes) < 2:
                continue
            pick = (lambda v, at: v[at]) if isinstance(values, np.ndarray) else (lambda v, at: [v[k] for k in at])
            i, j = close(pick(values, left), pick(values, right))
            i, j = left[i], right[j]
            keep = i < j if same else np.ones(len(i), bool)
            found = forest(i[keep], j[keep], len(nodes))
            if found:
                a, b = np.array(found).T
                yield pa.record_batch([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def _fixed(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: Fraction = Fraction(85, 100)) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least ``similarity``, itself included), kept."""
    documents_per_batch(docs.sparkSession)
    radius = max_distance(float(similarity))
    parts = chunks(SLOTS, radius)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 * BLOCK_BYTES):
            found = [(np.unique(a), np.unique(b)) for a, b in shingles(batch.column(1), shingle)]
            digests = [hashlib.blake2b(a.tobytes() + b.tobytes(), digest_size=16).digest() if len(a) else None for a, b in found]
            sizes = [max(len(a), len(b)) for a, b in found]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in signatures([a for a, _ in found])], pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                k = chunk_keys(_fixed(part.column(1), "<u2", SLOTS), parts)
                yield pa.record_batch([pa.array(k.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), k.shape[1]))], names=["key", "node"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 * BLOCK_BYTES):
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(s).tobytes() for s in shingles(batch.column(1), shingle)], pa.binary())], names=["node", "value"])

    # classes of equal sets, named by their smallest id
    signed = materialize(read.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, signature binary"), "signed")
    full = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    limit = spread_limit(signed.count())
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("signature").alias("value"), F.count("*").alias("n")), "classes")
    member = spread_join(full.select("doc_id", "digest"), classes.select("digest", "node", "n"), "digest", limit).drop("n")
    again = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).where("n > 1 AND a <> z")
    tied = member.join(again, "doc_id").select(F.col("a"), F.col("node").alias("b"))

    # candidates: pairs within the radius share a key
    keyed = classes.select("node", "value").where("value IS NOT NULL").mapInArrow(keys, "key long, node long")
    near = _links(_block_pairs(keyed, "key", classes, "value"), lambda a, b: close_signatures(a, b, radius), lambda c: _fixed(c, "<u2", SLOTS))
    groups = materialize(components(near), "groups")

    # confirmation on full sets
    texts = read.join(groups.select(F.col("node").alias("doc_id")), "doc_id").select("doc_id", "text")
    sets = materialize(texts.mapInArrow(sets_of, "node long, value binary"), "sets")
    pairs = _block_pairs(groups.select(F.col("component").alias("g"), "node"), "g", sets, "value")
    linked = _links(pairs, lambda a, b: close_sets(a, b, similarity), lambda c: [np.frombuffer(x, dtype=np.uint64).reshape(2, -1) for x in c.to_pylist()])
    found = components(linked.union(tied))

    named = classes.select("digest", "node", "n").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"), "n")
    out = ["doc_id", "n_shingles", "component_id"]
    grouped = spread_join(full.select("doc_id", "n_shingles", "digest"), named, "digest", limit).select(*out)
    alone = signed.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept: one document of each group, and all that link with nothing."""
    gone = near_duplicates(docs, id_col, **options).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
