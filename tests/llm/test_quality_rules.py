"""The fertility bands take decisions: garbage leaves them, nearly all given documents do not."""

import base64
import gettext
import glob
import math
import random
import re
import string
import textwrap
import unicodedata
from collections import Counter

import public_tokenizers
import pytest

SF = "/root/testdata/sf0.01"


def entropy_limits(script, tokens):
    from heddle.llm.quality_rules import BANDS

    doublings = math.log2(max(tokens, 1))
    return min(0.6 * doublings, BANDS.get(script, BANDS["other"])[3] + 0.15 * doublings), min(0.975 * doublings, 4.6 + 0.45 * doublings)


def rules(spark, texts):
    from heddle.llm.quality_rules import quality_rules

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in quality_rules(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}


def test_garbage_is_rejected(spark):
    """Random letters of several scripts, encoded bytes, texts read in a wrong encoding, and strings of vocabulary words or tokens without grammar."""
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(7)
    words = lambda letters, n=300: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))
    encoded = base64.b64encode(rng.randbytes(1500)).decode()
    han, printable = [chr(c) for c in range(0x4E00, 0x9FA5)], [c for c in string.printable if not c.isspace()]
    texts = [words(string.ascii_letters + string.digits + "+/"), " ".join(encoded[i : i + 7] for i in range(0, len(encoded), 7)), words("0123456789abcdef"), words(string.ascii_lowercase), words(string.ascii_lowercase, 60), words(printable), words("абвгдежзийклмнопрстуфхцчшщъыьэюя"), words("αβγδεζηθικλμνξοπρστυφχψω"), words(han)]
    for encoding in ("utf-8", "cp1251", "utf-16-le"):
        # parts of a text that does not repeat, so that the base rule has nothing to say
        texts.append(" ".join(w.encode(encoding).decode("latin-1") for w in (RUSSIAN + " " + RUSSIAN_TOO).split()))
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [model.id_to_piece(i) for i in range(3, model.vocab_size()) if not model.is_byte(i)]
    plain = [p[1:] for p in pieces if p.startswith("▁") and p[1:].isascii() and p[1:].isalpha() and len(p) > 3]
    texts += [" ".join(rng.choice(plain) for _ in range(n)) for n in (60, 300, 3000, 30_000)]
    texts += ["".join(rng.choice(pieces) for _ in range(n)).replace("▁", " ") for n in (400, 4000)]
    out = rules(spark, texts)
    assert [(i, out[i].base_failed, out[i].kept) for i in range(len(texts))] == [(i, False, False) for i in range(len(texts))]


RUSSIAN = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах."
RUSSIAN_TOO = "Никто не должен подвергаться пыткам или жестоким, бесчеловечным или унижающим его достоинство обращению и наказанию. Каждый человек, где бы он ни находился, имеет право на признание его правосубъектности. Все люди равны перед законом и имеют право, без всякого различия, на равную защиту закона."
KOREAN = "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다. 어느 누구도 노예상태 또는 예속상태에 놓여지지 아니한다. 모든 형태의 노예제도와 노예매매는 금지된다. 어느 누구도 고문 또는 잔혹하거나 비인도적이거나 굴욕적인 처우 또는 형벌을 받지 아니한다. 모든 사람은 어디에서나 법 앞에 인간으로서 인정받을 권리를 가진다."
#: The first articles of the Universal Declaration of Human Rights.
DECLARATION = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion, national or social origin, property, birth or other status. Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat Anspruch auf die in dieser Erklärung verkündeten Rechte und Freiheiten ohne irgendeinen Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder sonstiger Überzeugung, nationaler oder sozialer Herkunft, Vermögen, Geburt oder sonstigem Stand. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel sind in allen ihren Formen verboten.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente Déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude ; l'esclavage et la traite des esclaves sont interdits sous toutes leurs formes.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Toda persona tiene todos los derechos y libertades proclamados en esta Declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o cualquier otra condición. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre; la esclavitud y la trata de esclavos están prohibidas en todas sus formas.",
}


def test_repetition_of_few_tokens_is_rejected(spark):
    rng = random.Random(3)
    r = rules(spark, [" ".join(rng.choice(["the", "and", "for", "one"]) for _ in range(60))])[0]
    assert r.n_tokens < 200 and r.token_entropy < entropy_limits("latin", r.n_tokens)[0] and not r.kept


def test_declarations_are_kept_however_they_are_wrapped(spark):
    texts = [*DECLARATION.values(), RUSSIAN, KOREAN]
    wrapped = ["\n".join(textwrap.wrap(t, 30)) for t in texts] + [t.replace(". ", ".\r\n\r\n    ") for t in texts] + [" ".join(t.split()[:50]) for t in texts[:4]]
    out = rules(spark, [*texts, *wrapped])
    assert [(i, r.base_failed, r.kept) for i, r in sorted(out.items())] == [(i, False, True) for i in range(len(texts) + len(wrapped))]
    assert [out[i].script for i in range(6)] == ["latin"] * 4 + ["cyrillic", "hangul"]
    for i in range(6):
        assert abs(out[i].chars_per_token - out[6 + i].chars_per_token) < 1e-9 and out[i].byte_share == out[6 + i].byte_share 


def natural(language):
    """Paragraphs of at least fifty words that this machine has: licences and manuals, and translated messages."""
    out = []
    if language == "en":
        for f in sorted(glob.glob("/usr/share/common-licenses/*") + glob.glob("/usr/share/perl/5*/pod/*.pod")):
            try:
                text = open(f, encoding="utf-8").read()
            except UnicodeDecodeError:
                continue
            out += [*(p for p in text.split("\n\n") if len(p.split()) >= 50), text, " ".join(text.split())]
    else:
        for f in sorted(glob.glob(f"/usr/share/locale/{language}/LC_MESSAGES/*.mo")):
            try:
                messages = gettext.GNUTranslations(open(f, "rb"))._catalog
            except (OSError, UnicodeDecodeError):
                continue
            # running text: hardly any marks of commands and formats
            out += [v for k, v in messages.items() if isinstance(k, str) and k and len(v.split()) >= 50 and sum(v.count(c) for c in "-%<>|~=") * 50 < len(v)]
    return out


@pytest.mark.parametrize("language", ["en", "de", "fr", "es", "it", "nl", "pl", "ru"])
def test_natural_paragraphs_are_kept(spark, language):
    texts = natural(language)
    if len(texts) < 20:
        pytest.skip("this machine has no texts of the language")
    out = rules(spark, texts).values()
    assert sum(not r.base_failed for r in out) >= 20
    assert not [texts[r.doc_id][:200] for r in out if not r.base_failed and not r.kept]


def test_given_documents_are_kept(spark):
    from heddle.llm.queries import QUERIES

    good = [r for r in QUERIES["op10_quality_rules"](spark, SF).collect() if not r.base_failed]
    assert len(good) > 800 and sum(not r.kept for r in good) <= len(good) / 1000


def brute_script(text):
    known = {"LATIN": "latin", "GREEK": "greek", "CYRILLIC": "cyrillic", "ARABIC": "arabic", "HEBREW": "hebrew", "DEVANAGARI": "devanagari", "THAI": "thai", "HANGUL": "hangul", "HIRAGANA": "kana", "KATAKANA": "kana", "CJK": "han"}
    found = Counter()
    for c in text:
        if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo"):
            found[next((known[w] for w in unicodedata.name(c, "").replace("-", " ").split() if w in known), "other")] += 1
    order = [*dict.fromkeys([*list(known.values())[:8], "kana", "han", "other"])]
    return min(found, key=lambda k: (-found[k], order.index(k))) if found else "none"


def test_every_column_matches_brute_force(spark):
    """Scripts by Unicode names, figures from the libraries' own encodings, the second vocabulary where the first says no, the verdict from the bands."""
    import tiktoken
    from sentencepiece import SentencePieceProcessor

    from heddle.llm.quality_rules import BANDS, SECOND_LATIN

    piece = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
    multi = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    name = {v: k for k, v in ranks.items()}
    rng = random.Random(8)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").collect()]
    vietnamese = "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Mọi người đều được hưởng tất cả những quyền và tự do nêu trong Tuyên ngôn này."
    texts += [None, "", "“” — … 🙂 123", vietnamese, "日本語のテキストです。" * 8, "ÄÖ" * 3, "שלום עולם " * 30, *DECLARATION.values(), RUSSIAN, "a b\n\n\tc " * 40]
    texts += [" ".join("".join(rng.choice(string.hexdigits) for _ in range(7)) for _ in range(90)), "Ð’ÑÐµ Ð»ÑŽÐ´Ð¸ Ñ€Ð¾Ð¶Ð´Ð°ÑŽÑ‚ÑÑ " * 30]
    out, rejected, second = rules(spark, texts), 0, 0
    for i, t in enumerate(texts):
        t = re.sub(r"[\x09-\x0D][\x09-\x0D ]*| [\x09-\x0D ]+", " ", t or "")
        script, r = brute_script(t), out[i]

        def look(by_piece, t=t):
            ids = piece.encode(t) if by_piece else multi.encode_ordinary(t)
            bad = sum(piece.is_byte(k) if by_piece else "\ufffd" in name[k].decode("utf-8", "replace") for k in ids)
            n, counts = max(len(ids), 1), Counter(ids)
            return r.word_chars / n, bad / n, -sum(k / n * math.log2(k / n) for k in counts.values()), len(ids)

        def inside(f, band, script=script):
            low, high = entropy_limits(script, f[3])
            return band[0] <= f[0] <= band[1] and f[1] <= band[2] and low <= f[2] <= high

        home = script in ("latin", "none")
        figures, vocabulary = look(home), "first" if home else "second"
        good = inside(figures, BANDS.get(script, BANDS["other"]))
        if script == "latin" and not good and not r.base_failed and inside(other := look(False), SECOND_LATIN):
            figures, good, vocabulary, second = other, True, "second", second + 1
        assert (r.script, r.n_tokens, r.kept, r.vocabulary) == (script, figures[3], good and not r.base_failed, vocabulary), i
        assert math.isclose(r.chars_per_token, figures[0]) and math.isclose(r.byte_share, figures[1]) and math.isclose(r.token_entropy, figures[2], abs_tol=1e-9)
        rejected += not r.base_failed and not r.kept
    assert rejected >= 1 and second >= 1 and not out[len(texts) - 2].kept and not out[len(texts) - 1].kept
