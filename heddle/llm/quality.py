"""Quality classifier by co-training of two views.

The text view sees the words and the shape of a text, the metadata view its source, language and
recorded length. Both start from the same bounded sample of labelled documents. In each round either
view labels those documents of a bounded unlabelled sample of which it is surest, and hands
them to the other view as training rows. Then each view is calibrated on labelled documents kept aside
(Platt scaling), the calibrated views are combined by a logistic model on the same documents, and all
documents are scored. A document is rejected when its probability to be bad reaches the cut (``rejection_cut``): the
level that all but ``GOOD_LOSS`` of the good calibration documents stay below, unless fewer than ``LEAST_RECALL`` of the bad or of the
toxic ones reach it, as happens when some labels are wrong; then the level that so many reach. It is never below 0.5.

A good document is one labelled of quality and not toxic. Sample sizes are parameters; the samples are
chosen by a hash of the id, so a run repeats. Everything else covers all documents in one pass.

Defined cases: null and wordless texts are scored like others and never kept; documents whose
labels contradict each other count as bad; of rows that repeat a sampled id one is learnt from (the least by its features); rows with a null id are scored but never sampled; without labels
of both kinds nothing is learnt, scores are null and every text with a word is kept; an empty table gives an empty result;
columns that ``documents`` passes through may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.quality_rules import base_counts
from heddle.llm.textcore import BLOCK, documents_per_batch, mix, slices, span_hashes, spans, utf8

#: Expected labelled and unlabelled documents of the samples, rounds of co-training, share of the labelled kept aside.
LABELLED, UNLABELLED, ROUNDS, ASIDE = 6_000, 4_000, 4, 0.3
#: Probability from which a view is sure, and documents of each class it hands over in a round.
SURE, HANDED = 0.97, 200
#: Share of good calibration documents that may be lost.
GOOD_LOSS = 0.003
#: Share of bad calibration documents, and of toxic ones among them, that are to be caught where a level of 0.5 or more allows it.
LEAST_RECALL = 0.97
#: Words of the lexicon: documents they stand in at least, and the least root of their likelihood-ratio statistic.
WORD_DOCS, WORD_Z = 5, 5.0
#: Log odds ratio from which a word points almost only to bad documents.
STRONG_ODDS = 3.5
#: Buckets of source and of language in the metadata view.
SOURCES, LANGS = 64, 16

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CLASSES = [(65, 91), (48, 58)]


def text_shape(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shares and lengths of each document that need no vocabulary."""
    c = base_counts(buf, offs)
    size = np.maximum(np.diff(offs), 1)
    words = np.maximum(c["n_words"], 1)
    per = lambda flags: np.diff(np.searchsorted(np.flatnonzero(flags), offs))
    letters = np.maximum(per(_LETTER[buf]), 1)
    upper = per((buf >= 65) & (buf < 91))
    mark = (buf > 32) & (buf < 127) & ~_LETTER[buf] & ~((buf >= 48) & (buf < 58))
    plain = (buf == 46) | (buf == 44)
    return np.stack([upper / letters, per(mark & ~plain) / size, per(plain) / words, per((buf >= 48) & (buf < 58)) / size, c["n_symbols"] / words, per(buf == 33) / words, per(buf == 124) / words, per(buf == 10) / words, c["word_chars"] / words, c["n_dup_lines"] / np.maximum(per(buf == 10) + 1, 1), c["n_repeat_words"] / words, np.log1p(c["n_words"])], axis=1)


def letter_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased letter runs, and the first of each document."""
    starts, ends, first = spans(buf, offs, _LETTER)
    return span_hashes(buf, starts, ends, fold=True), first


def metadata(source: list, lang: list, n_chars: np.ndarray) -> np.ndarray:
    """Source and language by bucket (the first is for null), length and its square."""
    rows = len(source)
    out = np.zeros((rows, SOURCES + LANGS + 2))
    for at, values, size in ((0, source, SOURCES), (SOURCES, lang, LANGS)):
        texts = pa.array(["" if v is None else f"={v}" for v in values], pa.string())
        buf, offs = utf8(texts)
        full = np.flatnonzero(np.diff(offs))
        key = np.zeros(rows, dtype=np.int64)
        key[full] = 1 + (span_hashes(buf, offs[:-1][full], offs[1:][full]) % np.uint64(size - 1)).astype(np.int64)
        out[np.arange(rows), at + key] = 1
    length = np.log1p(np.maximum(n_chars, 0))
    out[:, -2], out[:, -1] = length / 10, (length / 10) ** 2
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, w: np.ndarray | None = None) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale < 1e-9, 1.0, scale)
        z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
        w = np.ones(len(x)) if w is None else w
        beta, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            g = z.T @ (w * (y - p)) - penalty * beta
            h = (z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, g)
            beta += step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, beta)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weight[:-1] + self.weight[-1], -30, 30)


def learn_lexicon(words: list[np.ndarray], bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that tell bad documents from good ones (by the likelihood-ratio statistic), and what they point to: 2 almost only to bad, 1 rather to bad, -1 to good."""
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    flag = np.repeat(bad.astype(np.int64), [len(x) for x in words])
    keys, inverse = np.unique(flat, return_inverse=True)
    n, b = np.bincount(inverse, minlength=len(keys)).astype(float), np.bincount(inverse, flag, minlength=len(keys))
    g, nb, ng = n - b, float(bad.sum()), float((~bad).sum())
    part = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    share = n / (nb + ng)
    z = np.sqrt(np.maximum(2 * (part(b, nb * share) + part(g, ng * share) + part(nb - b, nb * (1 - share)) + part(ng - g, ng * (1 - share))), 0))
    odds = np.log((b + 0.5) / (nb - b + 0.5)) - np.log((g + 0.5) / (ng - g + 0.5))
    keep = (n >= WORD_DOCS) & (z >= WORD_Z)
    return keys[keep], np.where(odds >= STRONG_ODDS, 2, np.sign(odds))[keep]


def lexicon_features(hashes: np.ndarray, first: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per document: number, presence and share of the words that point almost only to bad, shares of those that rather point to bad and to good."""
    keys, kind = lexicon
    value = np.zeros(len(hashes))
    if len(keys) and len(hashes):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        value = np.where(keys[at] == hashes, kind[at], 0)
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[first])
    n, strong = np.maximum(np.diff(first), 1), count(value == 2)
    return np.stack([np.log1p(strong), np.minimum(strong, 1), strong / n, count(value == 1) / n, count(value == -1) / n], axis=1)


@dataclass
class Model:
    lexicon: tuple[np.ndarray, np.ndarray]
    text: Logistic
    meta: Logistic
    platt: tuple[Logistic, Logistic]
    joint: Logistic
    cut: float

    def score(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities to be bad: of the text view, of the metadata view, of both."""
        a, b = self.platt[0].logit(self.text.logit(x_text)[:, None]), self.platt[1].logit(self.meta.logit(x_meta)[:, None])
        return tuple(1 / (1 + np.exp(-v)) for v in (a, b, self.joint.logit(np.stack([a, b], axis=1))))


def rejection_cut(p: np.ndarray, bad: np.ndarray, toxic: np.ndarray) -> float:
    """Level of the probability ``p`` to be bad from which documents are rejected, from calibration documents of both kinds."""
    level = float(np.quantile(p[~bad], 1 - GOOD_LOSS, method="higher")) + 1e-9
    for kind in (bad, toxic):
        if kind.any():
            level = min(level, float(np.quantile(p[kind], 1 - LEAST_RECALL, method="lower")))
    return max(0.5, level)


def co_train(shape: np.ndarray, words: list[np.ndarray], meta: np.ndarray, label: np.ndarray, aside: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """Fit both views. ``label`` is 1 for bad, 0 for good, -1 for unlabelled; ``aside`` marks the calibration rows, ``toxic`` the toxic ones of the bad."""
    train, pool = (label >= 0) & ~aside, label < 0
    if len(set(label[train].tolist())) < 2 or len(set(label[aside & (label >= 0)].tolist())) < 2:
        return None
    first = np.concatenate([[0], np.cumsum([len(x) for x in words])])
    flat = np.concatenate(words)
    given = [np.where(train, label, -1), np.where(train, label, -1)]  # labels each view trains on
    for turn in range(rounds + 1):
        own = [g >= 0 for g in given]
        lexicon = learn_lexicon([words[i] for i in np.flatnonzero(own[0])], given[0][own[0]] == 1)
        x = [np.hstack([shape, lexicon_features(flat, first, lexicon)]), meta]
        views = [Logistic.fit(x[v][own[v]], given[v][own[v]].astype(float)) for v in (0, 1)]
        if turn == rounds:
            break
        for v in (0, 1):
            p = 1 / (1 + np.exp(-views[v].logit(x[v])))
            free = pool & (given[1 - v] < 0)
            for kind, sure in ((1, p), (0, 1 - p)):
                at = np.flatnonzero(free & (sure >= SURE))
                given[1 - v][at[np.argsort(-sure[at], kind="stable")[:HANDED]]] = kind
    at = aside & (label >= 0)
    y = label[at].astype(float)
    logits = [views[v].logit(x[v][at]) for v in (0, 1)]
    platt = tuple(Logistic.fit(z[:, None], y) for z in logits)
    both = np.stack([platt[v].logit(logits[v][:, None]) for v in (0, 1)], axis=1)
    joint = Logistic.fit(both, y)
    p = 1 / (1 + np.exp(-joint.logit(both)))
    return Model(lexicon, views[0], views[1], platt, joint, rejection_cut(p, y == 1, toxic[at]))


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    have = lambda c, kind: F.col(f"`{c}`").cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    return docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), have(source_col, "string").alias("source"), have(lang_col, "string").alias("lang"), have(chars_col, "double").alias("n_chars"))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, offs = utf8(batch.column(0))
    words, first = letter_words(buf, offs)
    chars = np.nan_to_num(batch.column(4).fill_null(0).to_numpy(zero_copy_only=False).astype(float), posinf=0, neginf=0)
    return text_shape(buf, offs), words, first, metadata(batch.column(2).to_pylist(), batch.column(3).to_pylist(), chars)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Model | None:
    """Train on samples of about ``labelled`` and ``unlabelled`` documents; the driver gets their features and no texts."""
    spark, scale = docs.sparkSession, 1_000_003
    documents_per_batch(spark)
    share = lambda n, most: scale if n <= most else int(scale * most / n)
    place = lambda c, seed: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(scale))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.col("quality"), F.lit(1)) < 1).cast("int").alias("low"), (F.coalesce(F.col("toxic"), F.lit(0)) > 0).cast("int").alias("toxic")).where("doc_id IS NOT NULL")
    chosen = known.where(place("doc_id", 3) < share(known.count(), labelled)).groupBy("doc_id").agg(F.greatest(F.max("low"), 2 * F.max("toxic")).alias("bad"))  # 2: toxic
    rows = _columns(docs, id_col, text_col, source_col, lang_col, chars_col).where("doc_id IS NOT NULL")
    part = place("doc_id", 5) < share(docs.count(), unlabelled)
    # the labelled sample is bounded by construction, so it may be broadcast
    sample = rows.join(F.broadcast(chosen), "doc_id", "left").where(F.col("bad").isNotNull() | F.coalesce(part, F.lit(False)))
    sample = sample.select("text", "doc_id", "source", "lang", "n_chars", F.coalesce("bad", F.lit(-1)).alias("bad"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            shape, words, first, meta = _views(batch)
            own = [np.unique(words[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(1), batch.column(5), pa.array([r.tobytes() for r in shape], pa.binary()), pa.array(own, pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], names=["doc_id", "bad", "shape", "words", "meta"])

    found = sample.mapInArrow(features, "doc_id long, bad int, shape binary, words binary, meta binary")
    # one row of each sampled id, however many the table has, so that the sample stays bounded
    found = found.groupBy("doc_id").agg(F.min(F.struct("bad", "shape", "words", "meta")).alias("x")).select("doc_id", "x.*")
    # documents of the unlabelled sample that have a label outside the labelled one are left out
    found = sorted(found.collect(), key=lambda r: (r.doc_id, r.bad, r.shape))
    ids = spark.createDataFrame([(r.doc_id,) for r in found if r.bad < 0], "doc_id long")
    other = {r.doc_id for r in known.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id").distinct().collect()}
    found = [r for r in found if r.bad >= 0 or r.doc_id not in other]
    if not found:
        return None
    kind = np.array([r.bad for r in found])
    wide = lambda c: np.stack([np.frombuffer(r[c], dtype=np.float64) for r in found])
    aside = (mix(np.array([r.doc_id for r in found], dtype=np.int64).view(np.uint64)) % np.uint64(1000)) < int(1000 * ASIDE)
    return co_train(wide("shape"), [np.frombuffer(r.words, dtype=np.uint64) for r in found], wide("meta"), np.minimum(kind, 1), aside, kind == 2)


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", documents: bool = False) -> DataFrame:
    """One row per document row: doc_id, text_bad, meta_bad, score (probability to be good), kept. With ``documents``, the kept rows of ``docs`` as they are."""
    documents_per_batch(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon is bounded by the sample
    views = _columns(docs, id_col, text_col, source_col, lang_col, chars_col)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]) if documents else F.struct(F.col(id_col).cast("long").alias("doc_id"))
    names = views.columns
    have = {source_col: "string", lang_col: "string", chars_col: "double"}
    read = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), *[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(k).alias(n) for (c, k), n in zip(have.items(), names[2:], strict=True)], rest.alias("rest"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text", BLOCK):
            shape, words, first, meta = _views(batch)
            n_words = np.expm1(shape[:, -1])
            if m is None:
                nothing = pa.nulls(batch.num_rows, pa.float64())
                a, b, score, kept = nothing, nothing, nothing, n_words > 0.5
            else:
                a, b, p = m.score(np.hstack([shape, lexicon_features(words, first, m.lexicon)]), meta)
                kept, a, b, score = (p < m.cut) & (n_words > 0.5), pa.array(a), pa.array(b), pa.array(1 - p)
            out = [batch.column(5), a, b, score, pa.array(kept)]
            names = ["rest", "text_bad", "meta_bad", "score", "kept"]
            yield pa.record_batch([*out, batch.column(0)], names=[*names, "text"]) if documents else pa.record_batch(out, names=names)

    kind = read.schema["rest"].dataType.simpleString()
    out = read.mapInArrow(judge, f"rest {kind}, text_bad double, meta_bad double, score double, kept boolean" + (", text string" if documents else ""))
    if documents:
        return out.where("kept").select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
    return out.select("rest.doc_id", "text_bad", "meta_bad", "score", "kept")
