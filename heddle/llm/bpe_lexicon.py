"""BPE encoding and decoding with a minimal acyclic transducer of the frequent words.

The most frequent pieces of the corpus (counted over all texts) are encoded once and compiled into a minimal
acyclic automaton: equal endings share their states, and every transition carries a number, so that the numbers along
a word's path add up to its place in the list of ids. The automaton is a flat file in the shared folder; tasks map it into
memory (``Lexicon.open``) and walk it for all pieces of a slice in step, one byte of each at a time. The pieces that are not in it
are merged exactly, by the library's own encoder, once for each distinct one of a slice.

The lexicon decides speed only: ids do not depend on what it holds. It is bounded (``LEXICON_WORDS``), as
the driver compiles it; words beyond are merged exactly.

Defined cases: null text is encoded as the empty text and has no tokens (its decoded text is empty); very long texts make a
slice of their own, and pieces longer than the longest word of the lexicon are merged; repeated rows are encoded each by itself; an empty table
gives an empty result and an empty lexicon; columns other than id and text are not read, so names cannot clash; null ids are passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.units import octave
from heddle.llm.textcore import BLOCK, documents_per_batch, materialize, ragged, shared_folder, slices
from heddle.llm.token_files import WordEncoder

#: Words of a lexicon at most, and bytes of one.
LEXICON_WORDS, LEXICON_BYTES = 1 << 16, 64
#: Times that a word must be met to enter it.
LEAST_COUNT = 2
#: Pieces outside the lexicon that one Python worker remembers before it forgets them all.
REMEMBERED = 200_000
#: Runs that are counted: letters, digits and all above ASCII with apostrophes, or marks.
_RUNS = r"[0-9A-Za-z'\x{80}-\x{10FFFF}]+|[!-&(-/:-@\[-`{-~]+"
_MAGIC = b"HEDDLEX1"
#: Numbers of the state without transitions and of the first state.
_DEAD, _ROOT = 0, 1


def automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Transitions and finality of the states of the minimal automaton of sorted distinct words; state 0 is dead, 1 the first. States are merged as soon as no later word can reach below them."""
    edges: list[dict[int, int]] = [{}, {}]
    final, path, known, last = [False, False], [_ROOT], {}, b""

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(edges[state].items()))
            edges[path[-1]][last[len(path) - 1]] = known.setdefault(key, state)

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        freeze(shared)
        for byte in word[shared:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]], last = True, word
    freeze(0)
    return edges, final


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file of a lexicon: states as bit sets of their bytes, transitions with targets and numbers, and the ids of the words in order."""
    words = sorted(w for w in entries if w)
    edges, final = automaton(words)
    order, number, count = [], {_DEAD: 0}, {_DEAD: 0}
    stack = [(_ROOT, False)]
    while stack:  # children before parents
        state, done = stack.pop()
        if done:
            if state not in count:
                count[state] = final[state] + sum(count[t] for t in edges[state].values())
                order.append(state)
        elif state not in count:
            stack.append((state, True))
            stack.extend((t, False) for t in edges[state].values() if t not in count)
    for state in reversed(order):  # the first state is the last one that is done
        number[state] = len(number)
    bits = np.zeros((len(number), 4), dtype=np.uint64)
    base = np.zeros((len(number), 4), dtype=np.int32)
    target, weight = [_DEAD], [0]
    for state in reversed(order):
        k, before = number[state], int(final[state])
        for byte, t in sorted(edges[state].items()):
            if not bits[k, byte >> 6]:
                base[k, byte >> 6] = len(target)
            bits[k, byte >> 6] |= np.uint64(1 << (byte & 63))
            target.append(number[t])
            weight.append(before)
            before += count[t]
    ends = np.zeros(len(number), dtype=np.int32)
    for state, k in number.items():
        ends[k] = final[state]
    ids = [entries[w] for w in words]
    place = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(place[-1]))
    parts = [bits.ravel(), base.ravel(), np.asarray(target, np.int32), np.asarray(weight, np.int32), ends, place, flat]
    head = np.asarray([max(map(len, words), default=0), *map(len, parts)], dtype=np.int64)
    return b"".join([_MAGIC, head.tobytes(), *(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)])


class Lexicon:
    """A compiled lexicon: a read-only view of its bytes."""

    def __init__(self, data):
        head = np.frombuffer(data, dtype=np.int64, count=9)
        if head[0] != np.frombuffer(_MAGIC, dtype=np.int64)[0]:
            raise ValueError("not a lexicon file")
        self.longest, at, views = int(head[1]), 72, []
        for n, kind in zip(head[2:].tolist(), (np.uint64, *[np.int32] * 6), strict=True):
            views.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
            at += n * views[-1].itemsize + -n * views[-1].itemsize % 8
        self.bits, self.base, self.target, self.weight, self.final, self.place, self.flat = views

    @classmethod
    def open(cls, uri: str) -> Lexicon:
        """Map the file into memory where the folder is mounted; other file systems give a buffer of its (bounded) bytes."""
        fs, path = pafs.FileSystem.from_uri(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            return cls(pa.memory_map(path).read_buffer())
        with fs.open_input_file(path) as f:
            return cls(f.read_buffer())

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each span in the sorted words, -1 where it is none of them."""
        size = ends - starts
        out = np.full(len(starts), -1, dtype=np.int64)
        order = np.flatnonzero((size <= self.longest) & (size > 0))
        order = order[np.argsort(-size[order], kind="stable")]  # those still to be read stay in front
        first, length = starts[order], size[order]
        state, total = np.full(len(order), _ROOT, dtype=np.int32), np.zeros(len(order), dtype=np.int32)
        left = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        one = np.uint64(1)
        for j, m in enumerate(left.tolist()):
            byte = buf[first[:m] + j]
            row = (state[:m] << 2) + (byte >> 6)
            word, bit = self.bits[row], one << (byte & 63).astype(np.uint64)
            there = (word & bit) != 0
            k = np.where(there, self.base[row] + np.bitwise_count(word & (bit - one)), 0)
            total[:m] += self.weight[k]
            state[:m] = self.target[k]
        ok = self.final[state] == 1
        out[order[ok]] = total[ok]
        return out


class _Pieces:
    """What ``WordEncoder`` asks for the ids of its pieces: the lexicon first, then exact merging."""

    def __init__(self, lexicon: Lexicon, merge: Callable[[Sequence[str]], list[list[int]]]):
        self.lexicon, self.merge = lexicon, merge
        self.known: dict[bytes, list[int]] = {}

    def _unseen(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces that the lexicon does not hold."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(dict.fromkeys(pieces))
        self.known |= zip(new, self.merge([p.decode("utf-8") for p in new]), strict=True)
        return [self.known[p] for p in pieces]

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, flat = self.lexicon.find(buf, starts, ends), self.lexicon.flat
        at = self.lexicon.place[place].astype(np.int64)
        counts = self.lexicon.place[np.minimum(place + 1, len(self.lexicon.place) - 1)] - at
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = buf.tobytes()
            found = self._unseen([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            counts[new] = [len(x) for x in found]
            at[new] = len(flat) + np.cumsum(counts[new]) - counts[new]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(counts[new].sum()))])
        return flat[ragged(at, counts)], counts


class LexiconCodec(WordEncoder):
    """Encoder and decoder of a tokenizers file; ``lexicon`` may be empty."""

    def __init__(self, path: str, lexicon: Lexicon):
        super().__init__(path)
        self.cache = _Pieces(lexicon, self.merge)
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.names = [names.get(i, "").encode("utf-8") for i in range(max(names) + 1)]

    def merge(self, pieces: Sequence[str]) -> list[list[int]]:
        """Ids of pieces by the merges of the file."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 text of the ids: a file without a decoder gives its tokens as they are written, parted by spaces."""
        name = self.names
        return b" ".join([name[i] for i in ids])


@lru_cache(maxsize=2)
def codec_of(path: str, lexicon: str) -> LexiconCodec:
    """The codec of a tokenizer and a lexicon file, opened once per Python worker."""
    return LexiconCodec(path, Lexicon.open(lexicon))


def frequent_words(docs: DataFrame, text_col: str = "text", words: int = LEXICON_WORDS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): at most ``words`` of the most frequent runs of all texts, ASCII ones lower-cased: all that are met more often than a bound, the least one that leaves no more of them.

    The bound is found from the numbers of words by the size of their count (a few thousand rows), so no task sends words that do not enter.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(_RUNS), F.lit(0)))
    runs = docs.select(run.alias("word")).where(F.octet_length("word") <= LEXICON_BYTES)
    folded = F.when(F.octet_length("word") == F.char_length("word"), F.lower("word")).otherwise(F.col("word"))
    counted = runs.groupBy(folded.alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counted = materialize(counted.withColumn("size", octave(F.col("n").cast("double"))), "word-counts")
    left, bound = words, None
    for r in sorted(counted.groupBy("size").count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        bound = r.size
    return counted.where(F.col("size") >= F.lit(bound)).select("word", "n")


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = LEXICON_WORDS, folder: str | None = None) -> str:
    """Compile the frequent words of ``docs`` to a file in the shared folder; returns its URI. The driver gets at most ``words`` words."""
    found = [r.word for r in frequent_words(docs, text_col, words).collect()]
    merge = LexiconCodec(tokenizer, Lexicon(compile_lexicon({}))).merge
    data = compile_lexicon({w.encode("utf-8"): ids for w, ids in zip(found, merge(found), strict=True)})
    folder = folder or shared_folder(docs.sparkSession, "lexicon")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/words.lexicon") as f:
        f.write(data)
    return f"{folder}/words.lexicon"


def encode_words(docs: DataFrame, tokenizer: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256 (of the decoded text); with ``full`` also token_ids and decoded."""
    documents_per_batch(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer, lexicon)
        for batch in slices(batches, "text", BLOCK):
            ids, counts = codec.encode(batch.column(1))
            ids = ids.astype("<u4")
            parts = np.split(ids, np.cumsum(counts)[:-1])
            texts = [codec.decode(p.tolist()) for p in parts]
            columns = [batch.column(0), pa.array(counts.astype(np.int64)), pa.array([hashlib.sha256(p.tobytes()).hexdigest() for p in parts]), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            if full:
                columns += [pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, names=schema)

    schema = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids", "decoded"] * full]
    kinds = ["long", "long", "string", "string", "array<int>", "string"]
    return read.mapInArrow(code, ", ".join(f"{n} {k}" for n, k in zip(schema, kinds, strict=False)))


def decode_ids(coded: DataFrame, tokenizer: str, lexicon: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text): the texts of stored ids. Null ids give the empty text."""
    documents_per_batch(coded.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer, lexicon)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(code, "doc_id long, text string")


def bpe_words(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> DataFrame:
    """``encode_words`` with the lexicon of the documents themselves."""
    return encode_words(docs, tokenizer, build_lexicon(docs, tokenizer, words=words))
