"""Operators 11 to 13 against brute force: filter audits, importance resampling, the BPE lexicon."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm.test_llm import LONG, SCHEMA, TEXTS, odd_texts

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
GRAM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    more = [(20, "CAPS AND | MARKS " * 90), (21, "same same " * 120), (22, "same same " * 120), (23, "one two three"), (24, "one two three"), (25, "a" + " ".join(f"w{i}" for i in range(250)))]
    rows = [(i, t, "en", ["a", None, "hot"][k % 3], None, False, 0, "clash", "clash", 1, 0.5) for k, (i, t) in enumerate([*TEXTS, *more])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# filter audit -------------------------------------------------------------------------------------------


def brute_masks(rows):
    """Failures of each row, from the words of the rules."""
    least = {}
    for r in rows:
        if r.doc_id is not None:
            t = r.text or ""
            least[t] = min(least.get(t, r.doc_id), r.doc_id)
    for r in rows:
        t = r.text or ""
        w = WORD.findall(t)
        yield {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": r.doc_id is not None and least[t] < r.doc_id,
        }


def brute_audit(rows, labels):
    rows = list(rows)
    fails = list(brute_masks(rows))
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    out, shapley = {}, Counter()
    parts = defaultdict(list)
    for r, f in zip(rows, fails, strict=True):
        parts[r.source or ""].append((r.doc_id, f))
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            here = members
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in here if x[f]]
                here = [(i, x) for i, x in here if not x[f]]
                redundant = sum(x[f] and any(x[g] for g in order[: step - 1]) for _, x in members)
                alone = sum(x[f] and sum(x.values()) == 1 for _, x in members)
                out[part, "".join(order), step] = [len(here), len(gone), redundant, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, f] += len(gone)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_swaps_visit_every_order_once():
    from heddle.llm.filter_audit import swaps

    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def test_audit_matches_brute_force(spark, docs, empty):
    from heddle.llm.filter_audit import audit_filters

    told = [(1, 1, 0), (5, 1, 1), (20, 0, 1), (22, 1, None), (22, None, 1), (None, 1, 1), (999, 1, 1), (10, 1, 0), (21, 0, 0)]
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    out = audit_filters(docs, labels)
    rows = docs.collect()
    found = {tuple(r) for r in out.collect()}
    assert out.count() == len(found) == 600 * 3
    assert found == brute_audit(rows, told)
    assert audit_filters(empty, labels).collect() == []
    assert {r.good_lost for r in audit_filters(docs, labels.where("false")).collect()} == {0}


def test_each_swap_adds_up_one_step():
    """The walk equals a fresh count of every order, for numbers of filters other than five too."""
    from heddle.llm.filter_audit import audit

    rng = np.random.default_rng(3)
    for k in (1, 2, 4):
        cells = rng.integers(0, 50, (3, 5, 1 << k))
        out = audit(cells, "ABCDEF"[:k])
        assert len(out["order"]) == math.factorial(k)
        for o, order in enumerate(out["order"].tolist()):
            before = 0
            for s, f in enumerate(order):
                gone = [m for m in range(1 << k) if m >> f & 1 and not m & before]
                assert (out["removed"][o, s] == cells[0][:, gone].sum(axis=1)).all() and (out["toxic_lost"][o, s] == cells[2][:, gone].sum(axis=1)).all()
                before |= 1 << f
        assert (out["shapley"].sum(axis=1)[0] == math.factorial(k) * (cells[0].sum(axis=1) - cells[0][:, 0])).all()


# importance resampling -----------------------------------------------------------------------------------


def brute_features(text):
    w = GRAM_WORD.findall((text or "").translate(LETTERS))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def brute_resample(docs, target, buckets=10_000, least=20, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in brute_features(t)[1])
    g = Counter(bucket(f) for t in target for f in brute_features(t)[1])
    S, T = sum(s.values()), sum(g.values())
    gain = lambda b: math.floor(1000 * math.log((g[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, t in docs:
        w, f = brute_features(t)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, rows.index(r)))
    ranks = Counter()
    for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        ranks[r[:4], k] += 1
    return Counter(r[:4] for r in rows), ranks


def test_resampling_matches_brute_force(spark, docs, empty):
    from heddle.llm.importance import resample

    target = ["one two three four", None, "", "w1x1 w2x2 End of ELEVEN é", "one two"]
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    many = docs.union(docs.withColumn("doc_id", docs.doc_id + 100)).union(docs.where("doc_id = 9").withColumn("text", docs.text))
    found = resample(many, goal).collect()
    every, ranks = brute_resample([(r.doc_id, r.text) for r in many.collect()], target)
    assert Counter(tuple(r)[:4] for r in found) == every
    assert Counter((tuple(r)[:4], r.rank) for r in found if r.rank is not None) == ranks and len(ranks) >= 3
    assert resample(empty, goal).collect() == []
    bare, _ = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [])
    assert Counter(tuple(r)[:4] for r in resample(docs, goal.where("false")).collect()) == bare


def test_longer_grams_cross_no_document(spark):
    from heddle.llm.importance import bucket_counts, positions

    df = spark.createDataFrame([(1, "a b c d"), (2, "e F"), (3, None), (4, "g")], "doc_id long, text string")
    got = {r.bucket: r.n for r in bucket_counts(positions(df, 3, 1 << 30), 3).collect()}
    assert got == Counter(zlib.crc32(f.encode()) % (1 << 30) for f in "a b c d e f g".split() + ["a b", "b c", "c d", "e f", "a b c", "b c d"])
    assert positions(df, 3).count() == 8


# BPE lexicon --------------------------------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(MODEL)
    t.no_padding()
    t.no_truncation()
    return t


def expected(texts):
    t = library()
    for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False):
        yield len(e.ids), hashlib.sha256(np.asarray(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_automaton_is_minimal_and_numbers_words():
    from heddle.llm.bpe_lexicon import Lexicon, automaton, compile_lexicon

    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé中") for _ in range(rng.randint(1, 7))).encode() for _ in range(3000)})
    edges, final = automaton(words)
    seen, stack = {1}, [1]
    while stack:
        for t in edges[stack.pop()].values():
            if t not in seen:
                seen.add(t)
                stack.append(t)
    # as many states as there are different sets of endings
    endings = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            endings[w[:i]].add(w[i:])
    assert len(seen) == len({frozenset(v) for v in endings.values()}) and sum(final[s] for s in seen) >= 1
    lexicon = Lexicon(compile_lexicon({w: [k, len(w)] for k, w in enumerate(words)}))
    others = [w + b"x" for w in words[:50]] + [w[:-1] for w in words if w[:-1] not in set(words)][:50] + [b"", b"zz", b"a" * 99]
    every = [*words, *others]
    buf, ends = np.frombuffer(b"".join(every), np.uint8), np.cumsum([len(w) for w in every])
    place = lexicon.find(buf, ends - [len(w) for w in every], ends).tolist()
    assert place == [*range(len(words)), *[-1] * len(others)]
    assert [lexicon.flat[lexicon.place[k] : lexicon.place[k + 1]].tolist() for k in (0, 7)] == [[0, len(words[0])], [7, len(words[7])]]
    with pytest.raises(ValueError):
        Lexicon(b"something else" * 20)


def test_ids_and_texts_equal_the_library(spark, docs, empty):
    from heddle.llm.bpe_lexicon import bpe_words, build_lexicon, decode_ids, encode_words

    texts = {**{i: t for i, t in enumerate(odd_texts(3000, 11))}, 9000: LONG, 9001: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = dict(zip(texts, expected(texts.values()), strict=True))
    for words in (0, 40, 1 << 16):  # the lexicon decides speed only
        out = bpe_words(df, MODEL, words=words).collect()
        assert {r.doc_id: tuple(r)[1:] for r in out} == want and len(out) == len(texts)
    out = bpe_words(docs, MODEL)
    assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(expected([r.text for r in docs.collect()]))
    assert bpe_words(empty, MODEL).collect() == []
    lexicon = build_lexicon(df, MODEL)
    coded = encode_words(df, MODEL, lexicon, full=True)
    t = library()
    assert all(r.decoded == t.decode(r.token_ids, skip_special_tokens=False) and len(r.token_ids) == r.n_tokens for r in coded.collect())
    assert {r.doc_id: r.text for r in decode_ids(coded, MODEL, lexicon).collect()} == {r.doc_id: r.decoded for r in coded.collect()}


def test_remembered_pieces_are_forgotten(monkeypatch):
    from heddle.llm import bpe_lexicon as B

    monkeypatch.setattr(B, "REMEMBERED", 50)
    codec, t = B.LexiconCodec(MODEL, B.Lexicon(B.compile_lexicon({b"zebra": [1, 2]}))), library()
    for seed in range(4):
        texts = odd_texts(40, seed)
        ids, counts = codec.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        assert len(codec.cache.known) <= max(50, sum(map(len, texts)))
    ids, _ = codec.encode(pa.array(["zebra Zebra zebra,"]))
    assert ids.tolist()[:6] == [1, 2, 1, 2, 1, 2]  # what the lexicon says is what comes out


def test_frequent_words_are_counted_over_all_texts(spark):
    from heddle.llm.bpe_lexicon import frequent_words

    df = spark.createDataFrame([(1, "The the THE cat's é É é"), (2, "the, the! ÉL"), (3, None), (4, "once " + "y" * 70 + " " + "y" * 70)], "doc_id long, text string")
    assert {r.word: r.n for r in frequent_words(df).collect()} == {"the": 5, "é": 2}
    assert [r.word for r in frequent_words(df, words=1).collect()] == ["the"]
    assert frequent_words(df, words=0).collect() == [] and frequent_words(df.where("false")).collect() == []
    same = spark.createDataFrame([(1, "a b c a b c d d d")], "doc_id long, text string")
    assert [r.word for r in frequent_words(same, words=3).collect()] == ["d"]  # words of one count enter together or not at all


def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    from heddle.llm.oracles import ORACLES
    from heddle.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ("op11_filter_audit", "op12_importance"):
        out = QUERIES[name](spark, SF)
        found = con.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(out.columns)
        assert sorted(repr(tuple(r[c] for c in names)) for r in out.collect()) == sorted(map(repr, found.fetchall()))
