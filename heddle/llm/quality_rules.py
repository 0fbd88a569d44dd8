"""Quality rules: cheap counts, then tokeniser fertility.

Counts are taken from all texts at once (word, line and 3-word-window hashes of a slice, 128 bits each). The
fertility verdict encodes each whole text with a public vocabulary and measures characters of words
per token, the share of byte-fallback tokens and the entropy of the text's tokens. A text has the script of most
of its letters, by Unicode's names of them; ties go to the script that stands first in ``SCRIPTS``.

A text is rejected when a figure leaves the band of its script (``BANDS``, ``entropy_band``): hexadecimal and base64 dumps, random
letters and text read in a wrong encoding have too few characters per token or too many fallback tokens, strings of words without grammar have too much
entropy, endless repetition too little. The bands hold natural text in many languages (README) and the invented prose of the given
tables alike, so they do not depend on what else is in the corpus.

Latin text is measured with the given model, other scripts with a multilingual byte vocabulary, whose
fallback tokens are those that end or start inside a character. Latin text that leaves its band is measured again with the multilingual
one, as languages with many diacritics are dear in the first, and is rejected only if it leaves the band there too. Runs of white space count as one space, as
how a text is wrapped or aligned says nothing about it.

Defined cases: null and empty texts have no words, fail the base rule and are not kept; very long texts are measured whole; repeated
rows are judged each by itself; an empty table gives an empty result; ids are passed through, null included; other columns are not read, so names cannot clash.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.piece_codec import codec_of, flat_ids
from heddle.llm.textcore import BLOCK, IS_WORD_BYTE, documents_per_batch, slices, span_hashes, spans, utf8, window_hashes

#: Bands by script: least and most word characters per token, most byte-fallback share, base of the least entropy in bits.
BANDS = {
    "latin": (1.62, 5.6, 0.10, 3.4),
    "greek": (1.15, 4.5, 0.30, 3.0),
    "cyrillic": (1.18, 5.0, 0.40, 3.0),
    "kana": (0.6, 4.5, 0.35, 3.0),
    "other": (0.6, 4.5, 0.70, 3.0),
    "none": (0.5, 4.5, 0.30, 3.0),
}
#: The band of latin text in the multilingual vocabulary.
SECOND_LATIN = (1.5, 5.6, 0.30, 3.4)
#: Scripts told apart; those without a band of their own have that of "other".
SCRIPTS = ["latin", "greek", "cyrillic", "arabic", "hebrew", "devanagari", "thai", "hangul", "kana", "han", "other", "none"]
#: Bits of least entropy for each doubling of the tokens, above the base; and as a share of the greatest possible entropy, which is what binds short texts.
ENTROPY_STEP, ENTROPY_SHARE = 0.15, 0.6
#: The same for the most entropy: base and bits for each doubling, and share.
MOST_ENTROPY, MOST_STEP, MOST_SHARE = 4.6, 0.45, 0.975
#: Fixed limits of the base rule.
LEAST_WORDS, REPEAT_PERCENT = 50, 50

_BREAKS = re.compile(r"[\x09-\x0D][\x09-\x0D ]*| [\x09-\x0D ]+")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[10] = False


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Set flags of each document (flags by position, documents as offsets)."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), offs))


def base_counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    starts, ends, first = spans(buf, offs)
    n_words = np.diff(first)
    docs = len(offs) - 1
    # a code point starts at every byte that is not a continuation byte
    word_chars = _per_doc(IS_WORD_BYTE[buf] & ((buf & 0xC0) != 0x80), offs)
    n_symbols = _per_doc(_SYMBOL[buf], offs)

    words = [span_hashes(buf, starts, ends, which=k) for k in (0, 1)]
    windows = [window_hashes(words[k], 3, which=k) for k in (0, 1)]
    owner = np.repeat(np.arange(docs), n_words)
    n_repeat = np.zeros(docs, dtype=np.int64)
    if len(windows[0]):
        good = np.flatnonzero(owner[: len(windows[0])] == owner[2:])
        twice = pd.DataFrame({"o": owner[good], "h": windows[0][good], "g": windows[1][good]}).duplicated(keep=False).to_numpy()
        hit = np.zeros(len(owner), dtype=bool)
        at = good[twice]
        for k in range(3):
            hit[at + k] = True
        n_repeat = np.bincount(owner[hit], minlength=docs)

    line_starts, line_ends, _ = spans(buf, offs, _NOT_NEWLINE)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    lines = pd.DataFrame({"d": np.searchsorted(offs, line_starts, side="right") - 1, **{k: span_hashes(buf, line_starts, line_ends, which=k) for k in (0, 1)}})
    n_dup = np.bincount(lines["d"][lines.duplicated()], minlength=docs)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat}


def token_figures(ids: np.ndarray, counts: np.ndarray, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-fallback share and token entropy (bits) of each document."""
    docs = len(counts)
    stop = np.cumsum(counts)
    some = np.maximum(counts, 1)
    share = _per_doc(is_byte[ids], np.concatenate([[0], stop])) / some
    entropy = np.zeros(docs)
    for at in range(0, docs, 256):
        to = min(docs, at + 256)
        lo, hi = stop[at] - counts[at], stop[to - 1]
        key = np.sort(np.repeat(np.arange(to - at, dtype=np.int64) << 32, counts[at:to]) | ids[lo:hi].astype(np.int64))
        if not len(key):
            continue
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(edge, len(key)))
        owner = key[edge] >> 32
        p = n / some[at:to][owner]
        entropy[at:to] = np.bincount(owner, -p * np.log2(p), minlength=to - at)
    return share, entropy


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Place in ``SCRIPTS`` of the script of each code point that is a letter, by its Unicode name; others have that of "none"."""
    words = {"CJK": "han", "HIRAGANA": "kana", "KATAKANA": "kana"} | {k.upper(): k for k in SCRIPTS[:8]}
    out = np.full(0x110000, SCRIPTS.index("none"), dtype=np.uint8)
    for c in range(0x40000):
        if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo"):
            name = unicodedata.name(chr(c), "").replace("-", " ").split()
            out[c] = SCRIPTS.index(next((words[w] for w in name if w in words), "other"))
    return out


def scripts(texts: list[str], buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Script of most letters of each document. Only documents with a character above ASCII are looked up by code point."""
    ascii_letters = _per_doc(((buf | 32) >= 97) & ((buf | 32) <= 122), offs)
    out = np.where(ascii_letters > 0, "latin", "none").astype(object)
    for i in np.flatnonzero(_per_doc(buf >= 128, offs)).tolist():
        counts = np.bincount(script_table()[np.frombuffer(texts[i].encode("utf-32-le"), dtype=np.uint32)], minlength=len(SCRIPTS))[:-1]
        out[i] = SCRIPTS[int(counts.argmax())] if counts.any() else "none"
    return out


@lru_cache(maxsize=2)
def ranks_of(path: str) -> tuple:
    """Encoder of a ranks file and whether each id ends or starts inside a character, built once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in f.read().splitlines() if line)}
    inside = np.zeros(max(ranks.values()) + 1, dtype=bool)
    for token, i in ranks.items():
        inside[i] = "\ufffd" in token.decode("utf-8", "replace")
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), inside


def entropy_band(tokens: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and most entropy of texts of so many tokens."""
    doublings = np.log2(np.maximum(tokens, 1))
    return np.minimum(ENTROPY_SHARE * doublings, base + ENTROPY_STEP * doublings), np.minimum(MOST_SHARE * doublings, MOST_ENTROPY + MOST_STEP * doublings)


def in_band(band: tuple[float, float, float, float], chars: np.ndarray, tokens: np.ndarray, share: np.ndarray, entropy: np.ndarray) -> np.ndarray:
    """Whether the figures lie in a band."""
    least, most, most_share, base = band
    per_token, (low, high) = chars / np.maximum(tokens, 1), entropy_band(tokens, base)
    return (per_token >= least) & (per_token <= most) & (share <= most_share) & (entropy >= low) & (entropy <= high)


def quality_rules(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", bands: dict[str, tuple[float, float, float, float]] = BANDS, multi: str | None = None) -> DataFrame:
    """One row per document row: doc_id, the base counts, base_failed, kept (it passes the base rule, and its token figures lie in the band of its script), n_tokens, script, chars_per_token, byte_share, token_entropy, vocabulary.

    ``multi`` is the ranks file for all scripts but latin and for latin text outside its band (byte_bpe_multi_50k unless given); the token figures are those of the ``vocabulary`` (first or second) that
    decided. One pass, without a shuffle.
    """
    if multi is None:
        import public_tokenizers

        multi = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    documents_per_batch(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in slices(batches, "text", BLOCK):
            texts = [_BREAKS.sub(" ", t) for t in batch.column(1).fill_null("").to_pylist()]
            buf, offs = utf8(batch.column(1))
            c = base_counts(buf, offs)
            script, chars = scripts(texts, buf, offs), c["word_chars"]
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
            counts, share, entropy, good = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)

            def measure(own: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                some = [texts[i] for i in own]
                encoder, inside = ranks_of(multi) if second else (codec, codec.is_byte)
                ids, n = flat_ids(encoder.encode_ordinary_batch(some, num_threads=1) if second else encoder.encode(some))
                return n, *token_figures(ids, n, inside)

            def decide(own: np.ndarray, second: bool) -> None:
                counts[own], share[own], entropy[own] = measure(own, second)
                for name in set(script[own]):
                    at = own[script[own] == name]
                    band = SECOND_LATIN if second and name == "latin" else bands.get(name, bands["other"])
                    good[at] = in_band(band, chars[at], counts[at], share[at], entropy[at])

            second = ~np.isin(script, ["latin", "none"])
            for kind in (False, True):
                if len(own := np.flatnonzero(second == kind)):
                    decide(own, kind)
            again = np.flatnonzero((script == "latin") & ~good & ~failed)
            if len(again):
                before = counts[again], share[again], entropy[again]
                decide(again, True)
                still = ~good[again]  # rejected by both: the figures of the first stay
                counts[again[still]], share[again[still]], entropy[again[still]] = (x[still] for x in before)
                second[again[~still]] = True
            out = {"doc_id": batch.column(0), **{k: pa.array(v, pa.int64()) for k, v in c.items()}, "base_failed": pa.array(failed), "kept": pa.array(good & ~failed)}
            out |= {"n_tokens": pa.array(counts), "script": pa.array(script.tolist(), pa.string()), "chars_per_token": pa.array(chars / np.maximum(counts, 1)), "byte_share": pa.array(share), "token_entropy": pa.array(entropy)}
            out["vocabulary"] = pa.array(np.where(second, "second", "first").tolist(), pa.string())
            yield pa.record_batch(list(out.values()), names=list(out))

    return read.mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, script string, chars_per_token double, byte_share double, token_entropy double, vocabulary string")
