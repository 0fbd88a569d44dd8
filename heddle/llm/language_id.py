"""Language identification as inference of a mixture.

Training counts byte trigrams of letter runs (words) per language over a bounded, documented sample of the
labelled documents; a word's likelihood under a language is the product of its trigrams'. A document is
a mixture: each word comes from one of the document's languages, whose proportions
expectation-maximisation estimates. Which languages take part is chosen by penalised likelihood:
starting from the best single language, the language with the steepest gain is added while the
log-likelihood grows by more than ``PENALTY * log(words)``. The largest proportion names the document.

All documents of a slice are fitted together: the likelihoods of each document's distinct words form one matrix and every step
is a segmented, weighted sum, so there is no loop over documents. Slices are smaller when there are more languages, and likelihoods
are gathered ``GATHER`` numbers at a time, so memory follows the distinct words of one document at most.

Defined cases: null texts and texts without a letter (by Unicode) are ``und`` with score 0; without any training row
everything is ``und``; repeated rows are judged each by itself; ties between languages go to the one
that sorts first; an empty table gives an empty result; any number of languages is learnt (128 KB each); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.textcore import BLOCK, documents_per_batch, mix, ragged, slices, span_hashes, spans, utf8

#: Buckets of trigrams, expected number of training documents, numbers gathered at once.
BUCKETS, TRAIN_DOCS, GATHER = 1 << 15, 20_000, 1 << 22
#: Additive smoothing, penalty of a language, steps of EM.
SMOOTHING, PENALTY, STEPS = 0.5, 6.0, 12

_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True
_CODE = np.full(256, 32, dtype=np.uint32)
_CODE[_IS_LETTER] = np.arange(256, dtype=np.uint32)[_IS_LETTER]
_CODE[65:91] += 32


def trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte, starts and ends of the words, first word of each document."""
    starts, ends, first = spans(buf, offs, _IS_LETTER)
    code = np.full(len(buf) + 2, 32, dtype=np.uint32)
    code[1:-1] = _CODE[buf]
    left, right = code[:-2].copy(), code[2:].copy()
    inner = offs[(offs > 0) & (offs < len(buf))]
    left[inner], right[inner - 1] = 32, 32
    with np.errstate(over="ignore"):
        h = (left << np.uint32(16) | code[1:-1] << np.uint32(8) | right) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), starts, ends, first


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of each trigram bucket under each; the counts are summed by Spark, the driver gets one row per language and bucket."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    n = rows.select("lang").count()
    if n > size:  # a hash of the text, so that the sample is the same in every run
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_003)) < int(1_000_003 * size / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                part = batch.column(0).filter(pa.array(langs == lang))
                bucket, starts, ends, _ = trigrams(*utf8(part))
                inside = np.zeros(len(bucket) + 1, dtype=np.int64)
                inside[starts] += 1
                inside[ends] -= 1
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held[lang] += np.bincount(bucket[np.cumsum(inside)[:-1] > 0], minlength=BUCKETS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.full((BUCKETS, len(langs)), SMOOTHING)
    place = {k: i for i, k in enumerate(langs)}
    np.add.at(counts, (table.column("bucket").to_numpy(), np.array([place[x] for x in table.column("lang").to_pylist()], dtype=np.int64)), table.column("n").to_numpy())
    return langs, np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)


def _segments(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each document; ``first`` are its offsets, no document is empty."""
    return np.add.reduceat(x, first[:-1], axis=0)


def mixtures(logp: np.ndarray, first: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Proportions of the languages in each document, from the log-likelihoods of its distinct words and how often each stands. Every document has a word."""
    docs, k = len(first) - 1, logp.shape[1]
    w = weight.astype(np.float64)[:, None]
    n = _segments(w, first)[:, 0]
    owner = np.repeat(np.arange(docs), np.diff(first))
    base = logp.max(axis=1, keepdims=True)
    like = np.exp(logp - base)
    total = _segments(w * logp, first)
    chosen = np.zeros((docs, k), dtype=bool)
    chosen[np.arange(docs), total.argmax(axis=1)] = True
    theta = chosen.astype(np.float64)
    level = (total - _segments(w * base, first))[chosen]
    active = np.arange(docs) if k > 1 else np.zeros(0, int)
    while len(active):
        rows = np.flatnonzero(np.isin(owner, active)) if len(active) < docs else np.arange(len(owner))
        part, own, times = like[rows], np.searchsorted(active, owner[rows]), w[rows]
        at = np.concatenate([[0], np.cumsum(np.diff(first)[active])])
        mixed = np.maximum((part * theta[active][own]).sum(axis=1), 1e-300)
        gain = _segments(times * np.minimum(part / mixed[:, None], 1e6), at)  # slope of the likelihood towards each language
        gain[chosen[active]] = -np.inf
        new = gain.argmax(axis=1)
        trial = chosen[active].copy()
        trial[np.arange(len(active)), new] = True
        t = trial / trial.sum(axis=1, keepdims=True)
        for _ in range(STEPS):
            r = part * t[own]
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            t = _segments(times * r, at) / n[active][:, None]
        after = _segments(times[:, 0] * np.log(np.maximum((part * t[own]).sum(axis=1), 1e-300)), at)
        better = after - level[active] > PENALTY * np.log(n[active] + 1)
        won = active[better]
        chosen[won], theta[won], level[won] = trial[better], t[better], after[better]
        active = won[chosen[won].sum(axis=1) < k]
    return theta


def word_likelihoods(bucket: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word under each language: the sum over its trigrams."""
    out, n = np.empty((len(starts), table.shape[1])), ends - starts
    step = max(1, GATHER // table.shape[1])
    total = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(total, total[at] + step, side="right")) - 1, at + 1)
        if n[at] > step:  # one very long word
            out[at] = sum(table[bucket[lo : min(lo + step, ends[at])]].sum(axis=0, dtype=np.float64) for lo in range(starts[at], ends[at], step))
        else:
            out[at:to] = np.add.reduceat(table[bucket[ragged(starts[at:to], n[at:to])]], total[at:to] - total[at], axis=0)
        at = to
    return out


def identify(docs: DataFrame, languages: list[str], logp: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document row: doc_id, the carried columns, lang_pred, score (its proportion), n_languages, mixture (all languages of the document with their shares, the largest first)."""
    carry = carry or {}
    documents_per_batch(docs.sparkSession)
    read = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(n) for n, c in carry.items()]).alias("rest"))
    shared = docs.sparkSession.sparkContext.broadcast((languages, logp))  # 128 KB a language
    kinds = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in slices(batches, "text", 8 * BLOCK // max(8, len(names))):
            buf, offs = utf8(batch.column(0))
            bucket, starts, ends, first = trigrams(buf, offs)
            pred, score, found = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            full = np.flatnonzero(np.diff(first) > 0)
            ascii_letters = np.diff(np.searchsorted(np.flatnonzero(_IS_LETTER[buf] & (buf < 128)), offs))
            for i in full[ascii_letters[full] == 0]:  # characters above ASCII are letters only if Unicode says so
                if not any(map(str.isalpha, batch.column(0)[int(i)].as_py())):
                    full = full[full != i]
            if len(full) and names:
                words = ragged(first[full], np.diff(first)[full])
                owner = np.repeat(np.arange(len(full)), np.diff(first)[full])
                with np.errstate(over="ignore"):  # a document's words in order of their first place, each once
                    codes, distinct = pd.factorize(mix(span_hashes(buf, starts, ends, fold=True)[words] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                at = np.empty(len(distinct), dtype=np.int64)
                at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
                edges = np.searchsorted(owner[at], np.arange(len(full) + 1))
                theta = mixtures(word_likelihoods(bucket, starts[words[at]], ends[words[at]], table), edges, np.bincount(codes, minlength=len(distinct)))
                best = theta.argmax(axis=1)
                pred[full], score[full] = np.array(names, dtype=object)[best], np.clip(theta.max(axis=1), 0, 1)
                for i, row in zip(full.tolist(), theta, strict=True):
                    found[i] = [{"lang": names[k], "share": float(row[k])} for k in np.argsort(-row, kind="stable") if row[k] > 0]
            yield pa.record_batch([batch.column(1), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array([len(x) for x in found], pa.int64()), pa.array(found, kinds)], names=["rest", "lang_pred", "score", "n_languages", "mixture"])

    rest = read.schema["rest"].dataType.simpleString()
    out = read.mapInArrow(predict, f"rest {rest}, lang_pred string, score double, n_languages long, mixture array<struct<lang: string, share: double>>")
    return out.select("rest.*", "lang_pred", "score", "n_languages", "mixture")
