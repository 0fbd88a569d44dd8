"""How filters of documents interact: every order of application, step by step, with Shapley shares.

Each document fails some of the filters; its failures are a bit mask, so all that any order needs are the counts of each
(part, mask): 2**k cells for k filters (``filter_cells``). The k! orders are then visited by adjacent transpositions
(``swaps``): one swap changes only what the two swapped steps remove, and of these only one is added up from the cells, as
both together remove the same documents as before. Shapley sums grow along the walk. All parts of a batch walk at once.

Defined cases: null text is the empty text (no words, no characters); a null source is the part ``''``; documents without
an id cannot have a smaller one beside them, so they never fail the copy filter, and nothing of theirs is labelled; rows with the same id and text are
copies of each other only if a smaller id has the text too; labels given twice count if any of them says so; an empty table has no parts and gives no rows;
very long texts are measured whole; other columns are not read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.textcore import partitions_for

#: Fixed letters and limits of the five filters.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
WORDS, MARKS, NO_CAPITALS = r"[^\x20\x09-\x0D]+", r"[#$%&*|]", "[^A-Z]+"
#: Parts that one step of the walk handles at once.
PARTS = 64


def text_failures(text: Column) -> list[Column]:
    """Failures of the filters that look at one text: few words, few distinct words, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    capitals = F.char_length(F.regexp_replace(text, NO_CAPITALS, ""))
    return [
        F.size(words) < LEAST_WORDS,
        F.size(F.array_distinct(words)) * 100 < LEAST_DISTINCT_PERCENT * F.size(words),
        capitals * 100 > MOST_CAPITALS_PERCENT * F.char_length(text),
        text.rlike(MARKS),
    ]


def filter_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail (bit 0 is the first), with those labelled good and toxic.

    Texts are met once, where they lie; from there on rows hold a digest. Rows are matched by digest and id together, so a text that very many
    documents share meets its least id in parts of all sizes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("x")).where("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.coalesce(F.bool_or("g"), F.lit(False)).cast("int").alias("good"), F.coalesce(F.bool_or("x"), F.lit(False)).cast("int").alias("toxic"))
    same = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = same.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    told = same.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copy, F.lit(1 << 4)).otherwise(F.lit(0)))
    told = told.join(known, "doc_id", "left")
    return told.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places whose item changes with the next one's, in turn, so that all orders of ``n`` items are met once each: the last item sweeps through the orders of the others."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    for _ in range(factorial(n - 1)):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the last item stands in front of the others, or behind them
        down = not down


def audit(cells: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """All steps of all orders of each part. ``cells`` is (3, parts, masks): documents, good ones, toxic ones. Values are (orders, steps, parts), ``order`` (orders, steps)."""
    k, masks = len(filters), np.arange(cells.shape[2])
    fails = np.stack([cells[0][:, masks >> f & 1 == 1].sum(axis=1) for f in range(k)])

    def met(step: int) -> np.ndarray:
        """What the filter at ``step`` removes now, added up from the cells."""
        before = sum(1 << f for f in order[:step])
        return cells[:, :, (masks >> order[step] & 1 == 1) & (masks & before == 0)].sum(axis=2)

    order = list(range(k))
    removed = [met(i) for i in range(k)]
    shapley = np.zeros_like(fails)
    orders, steps = [], []
    for at in [None, *swaps(k)]:
        if at is not None:
            both = removed[at] + removed[at + 1]
            order[at], order[at + 1] = order[at + 1], order[at]
            removed[at] = met(at)
            removed[at + 1] = both - removed[at]
        orders.append(list(order))
        steps.append(np.stack(removed))
        shapley[order] += steps[-1][:, 0]
    at, gone = np.asarray(orders), np.stack(steps)
    alone = np.stack([cells[0][:, 1 << f] for f in range(k)])
    return {
        "order": at,
        "kept": cells[0].sum(axis=1) - np.cumsum(gone[:, :, 0], axis=1),
        "removed": gone[:, :, 0],
        "redundant": fails[at] - gone[:, :, 0],
        "unique_fails": alone[at],
        "good_lost": gone[:, :, 1],
        "toxic_lost": gone[:, :, 2],
        "shapley": shapley[at],
    }


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step (see ``audit``) from the rows of ``filter_cells``: the removed, redundant and lost documents of the step, and its filter's unique failures and Shapley sum over all orders."""
    k = len(filters)
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2**k cells at most

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS):
                names, lists = batch.column(0).slice(lo, PARTS), batch.column(1).slice(lo, PARTS).to_pylist()
                table = np.zeros((3, len(names), 1 << k), dtype=np.int64)
                for p, found in enumerate(lists):
                    for c in found:
                        table[:, p, c["mask"]] = c["n"], c["good"], c["toxic"]
                out = audit(table, filters)
                orders, rows = len(out["order"]), len(names)
                label = np.array(["".join(filters[f] for f in o) for o in out["order"].tolist()], dtype=object)
                columns = [names.take(pa.array(np.repeat(np.arange(rows), orders * k))), pa.array(np.tile(np.repeat(label, k), rows), pa.string()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows * orders))]
                columns += [pa.array(out[c].transpose(2, 0, 1).ravel()) for c in counts]
                yield pa.record_batch(columns, names=["part", "filter_order", "step", *counts])

    parts = held.repartition(partitions_for(cells), "part")
    return parts.mapInArrow(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the five filters over whole tables."""
    return interactions(filter_cells(docs, labels))
