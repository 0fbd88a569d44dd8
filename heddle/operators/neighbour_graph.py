"""Approximate neighbour graph: random-projection trees, neighbours of neighbours, smooth weights.

* Trees: each tree cuts space by random directions, one per level, at medians that are estimated from a bounded sample (``SAMPLE`` rows); every row
  then falls into one leaf of each tree, and rows of a leaf are compared with each other. Leaves that hold more rows than meant are dealt in parts.
* Rounds: the neighbours found of a row, and a bounded number of rows that found it, are compared with each other; what is closer than the farthest neighbour known so far takes
  its place.
* Weights: distances beyond the nearest one decay so that the weights of a row add up to log2(k), and both directions of an edge are joined as a + b - ab.

Work is rows x trees x leaf and rows x k squared, not rows squared; vectors are shuffled once per tree and once per neighbour and round.

Recall is not assumed: about ``CHECKED`` rows are searched exactly (rows x ``CHECKED``), and after the trees and each round the share of their neighbours that was found is counted. Rounds end at ``ENOUGH``. Where vectors
have so little structure that trees find less than ``HOPELESS``, or that the rounds do not reach ``ENOUGH``, no index of this kind holds their neighbours, and all rows are searched exactly instead (``retrieval.nearest``): rows squared, in
single precision mostly.

Defined cases: NaN in a vector counts as zero, rows without a vector are left out, vectors of different lengths raise an error; rows with the same id are not compared with each other; a single row has no neighbours; rows with fewer than k neighbours keep
those; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.corpus_blocks import Block, _run_tables
from heddle.operators.retrieval import Constraints, _prepared, _size, nearest, similarity_matrix
from heddle.operators.retrieval import written as _written

#: Rows of the sample from which the trees are made, at most about; least sample rows of a leaf.
SAMPLE, SAMPLE_LEAF = 50_000, 4
TREES, LEAF, ROUNDS, SEED = 8, 64, 2, 11
#: Rows whose recall is measured, the recall at which rounds end (0.9 is promised; the measure strays by about 0.01), and that of the trees below which no rounds are tried.
CHECKED, ENOUGH, HOPELESS = 512, 0.94, 0.2


class Trees:
    """Directions (trees, levels, d) and medians (trees, nodes) of complete binary trees; node n has the children 2n and 2n + 1."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, seed: int):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(trees, levels, sample.shape[1]))
        self.medians = np.zeros((trees, 1 << levels))
        for t in range(trees):
            node = np.ones(len(sample), dtype=np.int64)
            for level in range(levels):
                at = sample @ self.directions[t, level]
                order = np.lexsort((at, node))
                edge = np.flatnonzero(np.diff(node[order], prepend=-1))
                count = np.diff(np.append(edge, len(order)))
                self.medians[t, node[order][edge]] = at[order][edge + count // 2]
                node = 2 * node + (at >= self.medians[t, node])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, (n, trees)."""
        out = np.empty((len(vectors), len(self.directions)), dtype=np.int64)
        for t, directions in enumerate(self.directions):
            node = np.ones(len(vectors), dtype=np.int64)
            for d in directions:
                node = 2 * node + (vectors @ d >= self.medians[t, node])
            out[:, t] = node
        return out


def _closest(ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row id, neighbour id, similarity) of the ``k`` best of each row among all of them; with ``least`` only what is more similar than that."""
    s = similarity_matrix(vectors, vectors, metric)
    s[ids[:, None] == ids[None, :]] = -np.inf
    if least is not None:
        s[s <= least[:, None]] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
    best = np.take_along_axis(s, order, axis=1)
    row, col = np.nonzero(np.isfinite(best))
    return ids[row], ids[order[row, col]], best[row, col]


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(id, near): the ``k`` best different neighbours of each row, best first. A row has a bounded number of candidates: ``k`` per tree or group that it is in."""
    one = found.groupBy("id", "nb").agg(F.max("s").alias("s"))
    near = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "nb")))
    return one.groupBy("id").agg(F.slice(near, 1, k).alias("near"))


_FOUND = "id long, nb long, s double"


def approximate_neighbours(profiles: DataFrame, id_col: str, features: str, k: int = 15, metric: str = "cosine", trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, seed: int = SEED, sample: int = SAMPLE) -> DataFrame:
    """(id, neighbour, rank, similarity) of about the ``k`` closest rows, ties to the smaller id."""
    base = _prepared(profiles, id_col, features, Constraints(), []).where("_v IS NOT NULL").select("_id", "_v", "_k")
    base = _written(base, "vectors")
    n = _size(base)[1]
    spark, parts = base.sparkSession, max(1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, rank int, similarity double")
    share = min(1.0, sample / n)
    some = base.where(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("_id", "_v", "_k").toArrow()
    drawn = Block(some).vectors if some.num_rows else np.zeros((0, 0))
    levels = max(0, min(math.ceil(math.log2(max(1, n / leaf))), int(math.log2(max(1, len(drawn) / SAMPLE_LEAF))))) if len(drawn) else 0
    unit = (lambda v: v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)) if metric == "cosine" else (lambda v: v)
    forest = Trees(unit(drawn), trees, levels, seed) if levels else None

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Block(batch)
            at = forest.leaves(unit(rows.vectors)) if forest else np.ones((len(rows.ids), 1), np.int64)
            key = at + (np.arange(at.shape[1], dtype=np.int64) << 40)
            take = pa.array(np.repeat(np.arange(len(rows.ids)), at.shape[1]))
            yield pa.record_batch([pa.array(key.ravel()), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)], names=["leaf", "_id", "_v", "_k"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _run_tables(batches, "g"):
            rows = Block(table)
            least = np.asarray(table.column("worst")) if "worst" in table.schema.names else None
            yield pa.record_batch([pa.array(x) for x in _closest(rows.ids, rows.vectors, k, metric, least)], names=["id", "nb", "s"])

    rows = base.mapInArrow(leaves, "leaf long, _id long, _v array<double>, _k array<bigint>")
    # a leaf of more rows than meant (few sample rows, equal vectors) is dealt in parts
    count = rows.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") > 4 * leaf)
    crowded = count.select("leaf", F.ceil(F.col("c") / F.lit(2 * leaf)).cast("long").alias("m"))
    dealt = rows.join(crowded, "leaf", "left").withColumn("g", F.xxhash64("leaf", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("m")), F.lit(0))))
    found = dealt.select("g", "_id", "_v", "_k").repartition(parts, "g").sortWithinPartitions("g", "_id").mapInArrow(compare, _FOUND)
    near = _written(_merged(found, k), "near")
    checked = base.where(F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(1 << 20)) < math.ceil(min(1.0, CHECKED / n) * (1 << 20)))
    truth = _written(nearest(base, "_id", "_v", k, metric, queries=checked).select("id", F.col("neighbour").alias("nb")), "truth")

    def recall() -> float:
        held = near.join(F.broadcast(truth.select("id").distinct()), "id", "left_semi").select("id", F.explode("near").alias("x")).select("id", F.col("x.nb").alias("nb"), F.lit(1).alias("hit"))
        n_true, n_hit = truth.join(held, ["id", "nb"], "left").agg(F.count("*"), F.count("hit")).first()
        return n_hit / n_true if n_true else 1.0

    reached = recall()
    for _ in range(rounds):
        if reached >= ENOUGH or reached < HOPELESS:
            break
        out = near.select("id", F.explode("near").alias("x")).select("id", F.col("x.nb").alias("nb"))
        # of the rows that found a row, about 2k
        popular = out.groupBy("nb").agg(F.count("*").alias("c")).where(F.col("c") > 2 * k)
        share = F.coalesce(F.lit(2.0 * k) / F.col("c"), F.lit(1.0))
        back = out.join(popular, "nb", "left").where(F.pmod(F.xxhash64("id", "nb"), F.lit(1 << 20)) < share * (1 << 20)).select(F.col("nb").alias("g"), F.col("id").alias("_id"))
        meet = out.select(F.col("id").alias("g"), F.col("nb").alias("_id")).union(back).union(near.select(F.col("id").alias("g"), F.col("id").alias("_id"))).distinct()
        worst = near.select(F.col("id").alias("_id"), F.when(F.size("near") >= k, -F.element_at("near", -1)["s"]).otherwise(F.lit(-math.inf)).alias("worst"))
        met = meet.join(base.join(worst, "_id", "left").withColumn("worst", F.coalesce("worst", F.lit(-math.inf))), "_id")
        more = met.select("g", "_id", "_v", "_k", "worst").repartition(parts, "g").sortWithinPartitions("g", "_id").mapInArrow(compare, _FOUND)
        known = near.select("id", F.explode("near").alias("x")).select("id", F.col("x.nb").alias("nb"), (-F.col("x.s")).alias("s"))
        near = _written(_merged(known.union(more), k), "near")
        reached = recall()
    if reached < ENOUGH:
        return nearest(base, "_id", "_v", k, metric)
    ranked = near.select("id", F.posexplode("near").alias("rank", "x"))
    return ranked.select("id", F.col("x.nb").alias("neighbour"), (F.col("rank") + 1).alias("rank"), (-F.col("x.s")).alias("similarity"))


def smooth_weights(distances: np.ndarray, k: int, steps: int = 64) -> np.ndarray:
    """Weights of rows of ascending distances (NaN where there is none): 1 up to the nearest distance above zero, then an exponential decay whose scale makes them add up to log2(k)."""
    d = np.where(np.isnan(distances), np.inf, distances)
    near = np.min(np.where(d > 0, d, np.inf), axis=1, keepdims=True)
    beyond = np.maximum(d - np.where(np.isfinite(near), near, 0.0), 0.0)
    low, high = np.zeros((len(d), 1)), np.full((len(d), 1), np.inf)
    scale, target = np.ones((len(d), 1)), math.log2(k)
    with np.errstate(invalid="ignore", over="ignore"):
        for _ in range(steps):
            much = np.exp(-beyond / scale).sum(axis=1, keepdims=True) > target
            high, low = np.where(much, scale, high), np.where(much, low, scale)
            scale = np.where(np.isinf(high), scale * 2, (low + high) / 2)
        finite = np.where(np.isfinite(d), d, np.nan)
        floor = 1e-3 * np.nanmean(np.where(np.isnan(finite).all(axis=1, keepdims=True), 0.0, finite), axis=1, keepdims=True)
        weights = np.exp(-beyond / np.maximum(scale, np.maximum(floor, 1e-300)))
    return np.where(np.isnan(distances), np.nan, weights)


def graph_weights(neighbours: DataFrame, k: int = 15, metric: str = "cosine") -> DataFrame:
    """(a, b, weight), a < b, from (id, neighbour, rank, similarity): the smooth weights of both directions as one probability that either holds."""
    far = F.lit(1.0) - F.col("similarity") if metric == "cosine" else -F.col("similarity")
    rows = neighbours.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", F.greatest(far, F.lit(0.0)).alias("d")))).alias("n"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            d = np.full((len(ids), int(size.max(initial=1))), np.nan)
            at = np.arange(d.shape[1])[None, :] < size[:, None]
            d[at] = flat.field(2).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(np.repeat(ids, size)), flat.field(1), pa.array(smooth_weights(d, k)[at])], names=["a", "b", "w"])

    edges = rows.mapInArrow(weigh, "a long, b long, w double")
    one = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") < F.col("b")).alias("up"), "w")
    up, down = (F.coalesce(F.max(F.when(F.col("up") == side, F.col("w"))), F.lit(0.0)) for side in (True, False))
    return one.groupBy("a", "b").agg(up.alias("_u"), down.alias("_d")).select("a", "b", (F.col("_u") + F.col("_d") - F.col("_u") * F.col("_d")).alias("weight"))


def neighbour_graph(profiles: DataFrame, id_col: str, features: str, k: int = 15, metric: str = "cosine", **options) -> DataFrame:
    """Weighted edges (a, b, weight) of the approximate neighbours."""
    return graph_weights(approximate_neighbours(profiles, id_col, features, k, metric, **options), k, metric)
