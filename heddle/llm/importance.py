"""Importance resampling towards a target distribution of n-grams.

Texts are laid out as a table of positions: ``posexplode`` numbers the words of each document, ``lead`` over the document's window joins
the words that follow for each order, and each n-gram becomes a bucket by its hash (``positions``). Buckets are counted over all documents and over
the target, a bucket's gain is the log ratio of both shares, and gains are joined to the positions and averaged over a document. Documents
are then drawn without replacement: a Gumbel number from the hash of the id is added to the weight and the highest scores are taken.

Documents are dealt out by row before their words are parted, so that the windows need no second shuffle and words never travel. Only the table of gains is broadcast: it has
one row per bucket, whatever the data.

Defined cases: null and empty texts, and texts without words, have no n-grams, weight 0, and are not drawn; very long texts are whole (one window
each); rows with the same id have the same Gumbel number and each its own weight and rank; null ids use the empty string in the hash and stand last among equal scores; an
empty table gives an empty result; an empty target counts nothing (t = T = 0); other columns are not read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.textcore import discard, materialize, partitions_for
from heddle.operators.spatial import numbered

#: Fixed values of the scheme: runs that are words (after lower-casing A-Z), buckets, longest n-gram, least words of a document that may be drawn, share drawn, seed.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII take the fast function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def positions(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word with the buckets ``b1`` to ``b<orders>`` of the n-grams that start there (null where the document ends first), under ``row`` and ``doc_id``; a document without words has one row of nulls."""
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = read.repartition(partitions_for(docs), "row")
    words = dealt.select("row", "doc_id", F.posexplode_outer(F.regexp_extract_all(_folded(F.col("text")), F.lit(WORDS), F.lit(0))).alias("pos", "w1"))
    document, found = Window.partitionBy("row").orderBy("pos"), words
    for k in range(2, orders + 1):
        found = found.withColumn(f"w{k}", F.lead("w1", k - 1).over(document))
    gram, hashed = F.col("w1"), []
    for k in range(1, orders + 1):
        gram = gram if k == 1 else F.concat(gram, F.lit(" "), F.col(f"w{k}"))  # null where a word is missing
        hashed.append((F.crc32(gram.cast("binary")) % buckets).cast("int").alias(f"b{k}"))
    return found.select("row", "doc_id", *hashed)


def bucket_counts(table: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, n) of all n-grams of a table of positions, summed before the shuffle."""
    grams = table.select(F.explode(F.array(*(f"b{k}" for k in range(1, orders + 1)))).alias("bucket")).where("bucket IS NOT NULL")
    return grams.groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor of 1000 times the log ratio of its smoothed shares in the target and in the corpus, from the counts of both."""
    grid = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = grid.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = materialize(both, "bucket-counts")
    s, t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(t + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weights(table: DataFrame, gains: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight): weight is the floor of the mean gain over a document's n-grams, 0 without any."""
    total, n, joined = F.lit(0).cast("long"), F.lit(0).cast("long"), table
    for k in range(1, orders + 1):
        joined = joined.join(F.broadcast(gains.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")
        total, n = total + F.coalesce(F.sum(f"g{k}"), F.lit(0)), n + F.count(f"b{k}")
    summed = joined.groupBy("row", "doc_id").agg(F.count("b1").alias("n_words"), n.alias("n_features"), total.alias("total"))
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    return summed.select("row", "doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Floor of 1000 times a Gumbel number that depends on the seed and the id only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document row; rank is null for those that are not drawn. Both tables have ``doc_id``/``text`` and ``text``."""
    table = materialize(positions(docs, orders, buckets), "positions")
    goal = positions(target.select(F.lit(0).alias("doc_id"), "text"), orders, buckets)
    gains = bucket_gains(bucket_counts(table, orders), bucket_counts(goal, orders), buckets)
    scored = weights(table, gains, orders).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored.withColumns({"out": F.col("n_words") < least_words, "down": -F.col("score"), "no_id": F.col("doc_id").isNull()}), "scores")
    discard(table)
    drawn = percent * scored.where("NOT out").count() // 100
    placed = numbered(scored, ["out", "down", "no_id", "doc_id", "row"], "place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
