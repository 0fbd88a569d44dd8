"""Main text of web pages by a tree-structured graphical model.

A page is parsed into its tree of block elements (all others, known or not, belong to the block around them). Each
block is content, the rest, or a frame that holds both (the page itself and its body). The model multiplies a unary potential per block (its kind of tag with its link
share, the words of its class, id and role, its amount of text, and its share of the page's text) with a pairwise potential per parent and child;
sum-product messages, upward from the leaves and downward from the root, give each block's exact marginal. Blocks
that are content or a frame with a probability above one half keep their own text.

The potentials are maximum-likelihood counts from labelled pages: pairs of parent and child labels and
features given the label, smoothed. ``labelled_pages`` writes such pages from a grammar of common page
layouts, with the label of each block in an attribute that the parser hides from the features; any other
labelled pages in that form can be given to ``train``.

Inside a block white space becomes one space, line breaks included; blocks are joined by one newline.
Text on both sides of an inner block is two blocks. Only scripts, styles, comments, titles, templates, frames and the
controls of forms never have text; formulas and drawings are text of their block like any other element.

Defined cases: null and empty html give an empty text; unclosed and unmatched tags are repaired as browsers
do for paragraphs, items and cells, other end tags without a start are dropped; attributes are read as browsers do, so
a quote inside an unquoted value belongs to it and an open one reaches to the next of its kind; a cut-off tag or comment at the
end of the page is dropped; very long, deep or broken pages take time and memory in proportion to their length; repeated rows are judged each by itself; null ids and urls pass through; an empty table
gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.textcore import documents_per_batch, slices

#: Fixed values of HTML: elements without an end, elements that are blocks, elements without text, elements whose inside is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style noscript template title iframe head textarea select option datalist button".split())
RAW = frozenset("script style textarea title iframe".split())
#: An opening tag closes an open element of these names (up to the barrier); those of other blocks close a paragraph.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
BARRIER = frozenset("ul ol table dl select body html article section div main button".split())
#: Tags that the model takes as one kind.
KINDS = {**{f"h{i}": "h" for i in range(1, 7)}, "summary": "h", "dt": "li", "dd": "li", "dl": "ul", "ol": "ul", "dir": "ul", "menu": "ul", "details": "div", "center": "div", "dialog": "div", "fieldset": "form", "legend": "form", "search": "form", "th": "td", "tbody": "table", "thead": "table", "tfoot": "table", "caption": "figcaption"}
#: Attribute with the label of a block in labelled pages.
LABEL = "data-label"

#: A comment, a declaration, or a tag with its attributes: names, each perhaps with a quoted or unquoted value.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>)|\Z))?+)*+)(>|\Z)",
    re.S,
)
_ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+", re.S)
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


class Names:
    """Words of an open element that is no block, and those of the ones around it up to their block. Elements share what stands above them."""

    __slots__ = ("above", "words", "known")

    def __init__(self, above: Names | None, words: list[str]):
        self.above, self.words, self.known = above, tuple(words), None

    def among(self, vocabulary: frozenset[str]) -> frozenset[str]:
        """The words that a vocabulary holds. Looked up once for each element (with one vocabulary)."""
        path, node = [], self
        while node is not None and node.known is None:
            path.append(node)
            node = node.above
        found = frozenset() if node is None else node.known
        for node in reversed(path):
            found = node.known = found if vocabulary.isdisjoint(node.words) else found | vocabulary.intersection(node.words)
        return found

    def all(self) -> Iterator[str]:
        node = self
        while node is not None:
            yield from node.words
            node = node.above


@dataclass(slots=True)
class Block:
    tag: str
    parent: int
    own: tuple[str, ...] = ()
    around: Names | None = None
    label: int | None = None
    chars: int = 0
    linked: int = 0
    below: int = 0
    below_linked: int = 0

    @property
    def words(self) -> tuple[str, ...]:
        """Words of the names of the block, and of the elements between it and the block around it."""
        return tuple(sorted({*self.own, *(self.around.all() if self.around else ())}))

    def known(self, vocabulary: frozenset[str]) -> tuple[str, ...]:
        """Those of the words that a vocabulary holds."""
        if self.around is None and not self.own:
            return ()
        return tuple(sorted(vocabulary.intersection(self.own) | (self.around.among(vocabulary) if self.around else frozenset())))


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str) -> Page:
    """Blocks in page order (a parent precedes its children) and the runs of text with their blocks. Time and memory grow with the length of the page, however deep or broken it is."""
    page = Page([Block("#root", -1)])
    stack: list[tuple[str, int, Names | None]] = [("#root", 0, None)]  # open elements with the block they stand in and the names of those that are none
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements in the stack, by name
    barriers: list[int] = [0]
    parts: list[str] = []
    at = links = silent = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                block = stack[-1][1]
                page.runs.append((block, text))
                page.blocks[block].chars += len(text)
            parts = []

    def add(raw: str) -> None:
        if raw and not silent:
            text = entities.unescape(raw)
            parts.append(text)
            if links:
                page.blocks[stack[-1][1]].linked += len(text)

    def last(names: Iterable[str]) -> int:
        """Place of the innermost open element of these names, zero if there is none."""
        return max((p[-1] for n in names if (p := places.get(n))), default=0)

    def close(to: int) -> None:
        nonlocal links, silent
        while len(stack) > to:
            name = stack[-1][0]
            if name in BLOCKS:
                flush()
            stack.pop()
            places[name].pop()
            if name in BARRIER:
                barriers.pop()
            links -= name == "a"
            silent -= name in SILENT

    def push(name: str, block: int, names: Names | None) -> None:
        nonlocal links, silent
        places[name].append(len(stack))
        if name in BARRIER:
            barriers.append(len(stack))
        stack.append((name, block, names))
        links += name == "a"
        silent += name in SILENT

    n = len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None or not m[4]:
            continue
        name = name.lower()
        if m[1]:
            if k := last((name,)):
                close(k)
            continue
        if name == "br":
            add(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        words, label = [], None
        for a in _ATTR.finditer(m[3]):
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key == LABEL:
                label = int(value)
            elif key in ("class", "id", "role"):
                words += [w.lower() for w in _PART.findall(value)]
        if name in BLOCKS:
            flush()
            k = last(CLOSES.get(name, ("p",)))
            if k > (0 if name == "body" else barriers[-1]):
                close(k)
            if name in ("header", "footer"):
                k = last(("article", "main", "section"))
                words.append(f"{name}-of-{stack[k][0] if k else 'body'}")
            page.blocks.append(Block(name, stack[-1][1], tuple(words), stack[-1][2], label))
            push(name, len(page.blocks) - 1, None)
        else:  # the names of such an element count for the blocks inside it
            words += name.split("-") if "-" in name else []
            push(name, stack[-1][1], Names(stack[-1][2], words) if words else stack[-1][2])
    close(1)
    flush()
    for b in reversed(page.blocks):  # a child stands behind its parent
        b.below += b.chars
        b.below_linked += b.linked
        if b.parent >= 0:
            page.blocks[b.parent].below += b.below
            page.blocks[b.parent].below_linked += b.below_linked
    return page


def features(block: Block, total: int, vocabulary: frozenset[str] | None = None) -> tuple:
    """Kind of tag together with the link share of the text in and below the block, attribute words, amount of own text, share of the page's text outside links (``total``); numbers in steps. With a vocabulary other words are left out."""
    share = block.below_linked / block.below if block.below else 0
    own = block.below - block.below_linked
    part = 0 if own <= 0 else 1 + (10 * own > total) + (2 * own > total)
    return (KINDS.get(block.tag, block.tag), min(3, int(4 * share))), block.words if vocabulary is None else block.known(vocabulary), 0 if not block.chars else min(4, 1 + int(math.log10(block.chars) * 1.5)), part


#: Labels of blocks: not content, content, frame.
REST, CONTENT, FRAME = LABELS = range(3)


class TreeModel:
    """Potentials of the tree and exact marginals by sum-product."""

    SMOOTHING = 0.5
    #: Weight of the unary log-potentials; below one because a block's features repeat each other.
    UNARY = 0.9

    def __init__(self, pages: Iterable[Page]):
        pairs = [[self.SMOOTHING for _ in LABELS] for _ in LABELS]
        self.counts = [defaultdict(Counter) for _ in LABELS]  # by label and feature: 0 kind, 1 words, 2 own text, 3 part
        self.blocks = [0 for _ in LABELS]
        vocabulary: dict[int, set] = defaultdict(set)
        for page in pages:
            labels = [FRAME if b.label is None and b.parent < 0 else b.label for b in page.blocks]
            for i, b in enumerate(page.blocks):
                if labels[i] is None:
                    labels[i] = labels[b.parent]
                y = labels[i]
                if b.parent >= 0:
                    pairs[labels[b.parent]][y] += 1
                self.blocks[y] += 1
                kind, words, size, part = features(b, page.blocks[0].below - page.blocks[0].below_linked)
                for k, v in ((0, kind), (2, size), (3, part)):
                    self.counts[y][k][v] += 1
                    vocabulary[k].add(v)
                for w in words:
                    self.counts[y][1][w] += 1
        self.sizes = {k: len(v) + 1 for k, v in vocabulary.items()}
        self.pair = [[p / sum(row) for p in row] for row in pairs]
        self.words = frozenset(w for y in LABELS for w in self.counts[y][1])
        self.unary = lru_cache(maxsize=20_000)(self._unary)

    def _unary(self, key: tuple) -> tuple[float, ...]:
        """Potentials of the labels, the largest one being 1."""
        kind, words, size, part = key
        logs = []
        mean = sum(self.blocks) / len(LABELS)
        for y in LABELS:
            total = self.blocks[y]
            some = self.SMOOTHING * total / mean  # in proportion, so that what no page has shown speaks for no label
            v = sum(math.log((self.counts[y][k][x] + some) / (total + some * self.sizes[k])) for k, x in ((0, kind), (2, size), (3, part)))
            for w in words:
                if any(self.counts[z][1][w] for z in LABELS):
                    v += math.log((self.counts[y][1][w] + some) / (total + 2 * some))
            logs.append(self.UNARY * v)
        top = max(logs)
        return tuple(math.exp(v - top) for v in logs)

    def marginals(self, blocks: list[Block]) -> list[tuple[float, ...]]:
        """Probabilities of the labels of each block. The page as a whole is a frame."""
        flat = self._sum_product(blocks)
        return list(zip(flat[0::3], flat[1::3], flat[2::3], strict=True))

    def _sum_product(self, blocks: list[Block]) -> array:
        """The marginals one after another, three numbers for each block."""
        n, total = len(blocks), blocks[0].below - blocks[0].below_linked
        belief = array("d")  # unary times messages from the children
        for b in blocks:
            belief.extend(self.unary(features(b, total, self.words)))
        belief[0:3] = array("d", [float(y == FRAME) for y in LABELS])
        up = array("d", [1.0]) * (3 * n)
        (p0, p1, p2), (q0, q1, q2), (r0, r1, r2) = self.pair
        for i in range(3 * n - 3, 0, -3):
            a, b, c = belief[i : i + 3]
            x, y, z = p0 * a + p1 * b + p2 * c, q0 * a + q1 * b + q2 * c, r0 * a + r1 * b + r2 * c
            s = x + y + z
            up[i], up[i + 1], up[i + 2] = x, y, z = x / s, y / s, z / s
            k = 3 * blocks[i // 3].parent
            x, y, z = belief[k] * x, belief[k + 1] * y, belief[k + 2] * z
            s = x + y + z
            belief[k], belief[k + 1], belief[k + 2] = x / s, y / s, z / s
        out = belief  # final from the root on: a parent is done before its children
        for i in range(3, 3 * n, 3):
            # the parent's belief without this child's message, carried down
            k = 3 * blocks[i // 3].parent
            a, b, c = out[k] / max(up[i], 1e-300), out[k + 1] / max(up[i + 1], 1e-300), out[k + 2] / max(up[i + 2], 1e-300)
            s = a + b + c
            a, b, c = a / s, b / s, c / s
            x, y, z = belief[i] * (p0 * a + q0 * b + r0 * c), belief[i + 1] * (p1 * a + q1 * b + r1 * c), belief[i + 2] * (p2 * a + q2 * b + r2 * c)
            s = x + y + z
            out[i], out[i + 1], out[i + 2] = x / s, y / s, z / s
        return out


def train(pages: Iterable[str]) -> TreeModel:
    return TreeModel(parse(p) for p in pages)


def extract(html: str | None, model: TreeModel) -> str:
    page = parse(html or "")
    if not page.runs:
        return ""
    p = model._sum_product(page.blocks)
    return "\n".join(text for block, text in page.runs if p[3 * block + REST] < 0.5)


def labelled_pages(n: int = 600, seed: int = 7) -> Iterator[str]:
    """Generated pages of common layouts; 1 marks content, 2 a frame, 0 the rest. A third have no semantic elements, and names that say nothing stand on both labels."""
    r = random.Random(seed)
    pool = ["".join(r.choices("aeioubdgklmnprst", k=r.randint(1, 9))) for _ in range(500)]
    word = lambda: r.choice(pool)
    text = lambda lo, hi: " ".join(r.choices(pool, k=r.randint(lo, hi))).capitalize() + r.choice(["", ".", ".", "!"])
    link = lambda: f'<a href="/{word()}">{text(1, 3)}</a>'
    neutral = ["row", "col", "box", "block", "inner", "text", "wrap", "clearfix", "item", "c", "el", "css", "x"]
    plain = False  # the page has no semantic elements

    def tag(name: str, label: int, inner: str, words: list[str] = (), named: float = 0.85) -> str:
        if plain and name in ("nav", "header", "footer", "aside", "main", "article", "section", "figure"):
            name = "div"
        kind = r.choice(words) if words and r.random() < named else f"{r.choice(neutral)}{r.choice(['', '', '-1', str(r.randint(2, 99))])}" if r.random() < 0.15 else ""
        attribute = f' {r.choice(["class", "class", "id"])}="{kind}"' if kind else ""
        return f'<{name} {LABEL}="{label}"{attribute}>{inner}</{name}>'

    def menu(words: list[str], name: str = "nav") -> str:
        items = "".join(tag("li", 0, link()) for _ in range(r.randint(2, 9)))
        links = "".join(link() + r.choice(["", " "]) for _ in range(r.randint(1, 6)))
        boxes = "".join(tag("div", 0, link()) for _ in range(r.randint(1, 6)))
        return tag(name, 0, r.choice([tag("ul", 0, items), links, boxes, tag("h2", 0, text(1, 2)) + tag("ul", 0, items)]), words, 0.6)

    def note(name: str, words: list[str], lo: int = 2, hi: int = 25) -> str:
        line = text(lo, hi)
        inner = r.choice([line, tag("p", 0, line), tag("p", 0, f"{line} {link()}"), f"<span>{line}</span><button>{text(1, 2)}</button>", tag("div", 0, line)])
        return tag(name, 0, inner, words, 1.0 if plain or name == "div" else 0.85)

    def comments() -> str:
        one = lambda: tag(r.choice(["li", "div", "article"]), 0, tag(r.choice(["p", "div"]), 0, text(3, 40)) + r.choice(["", tag("footer", 0, text(1, 3)), tag("div", 0, text(1, 3), ["author", "meta"])]), ["comment", "reply", "comment-body"])
        inner = r.choice(["", tag(r.choice(["h2", "h3", "h4"]), 0, text(1, 3))]) + "".join(one() for _ in range(r.randint(1, 5)))
        return tag(r.choice(["section", "div", "div", "ol", "aside"]), 0, inner, ["comments", "comment-list", "reader-comments", "responses", "discussion", "disqus_thread", "fb-comments", "utterances", "giscus", "respond"], 1.0)

    def form() -> str:
        return tag("form", 0, r.choice(["", f"<label>{text(1, 3)}</label>"]) + f'<input name="q"><button>{text(1, 2)}</button>' + r.choice(["", tag("p", 0, text(3, 12))]), ["search", "newsletter", "subscribe", "login"])

    def byline() -> str:
        return tag(r.choice(["p", "div", "address"]), 1, text(1, 6), ["byline", "author", "dateline", "published", "meta", "date"], 0.7)

    def body() -> str:
        title = tag(r.choice(["h1", "h1", "h2"]), 1, text(2, 12), ["title", "headline"] if r.random() < 0.3 else [])
        out = [r.choices([title, title + byline(), tag("header", 1, title + r.choice(["", byline()]), ["entry-header", "post-header"], 0.4), ""], [10, 3, 3, 1])[0]]
        part = "div" if plain and r.random() < 0.7 else "p"
        for _ in range(r.randint(1, 14)):
            line = r.choice([text(1, 4), text(5, 40), text(30, 120), f"{text(3, 20)} {link()} {text(3, 20)}", f"<b>{text(2, 40)}"])
            items = lambda lo=1: "".join(tag("li", 1, text(lo, 15)) for _ in range(r.randint(1, 5)))
            out.append(r.choices([
                lambda v: tag(part, 1, v),
                lambda v: f'<p {LABEL}="1">{v}<br>',
                lambda v: tag("div", 1, v),
                lambda v: tag(r.choice(["h2", "h3", "h4", "h5", "h6"]), 1, text(1, 8)),
                lambda v: tag(r.choice(["ul", "ol"]), 1, items()),
                lambda v: tag("dl", 1, "".join(tag("dt", 1, text(1, 4)) + tag("dd", 1, text(2, 25)) for _ in range(r.randint(1, 5)))),
                lambda v: tag("details", 1, tag("summary", 1, text(1, 6)) + tag("p", 1, v)),
                lambda v: tag("blockquote", 1, r.choice([v, tag("p", 1, v)])),
                lambda v: tag("pre", 1, v),
                lambda v: tag("figure", 1, tag("figcaption", 1, text(2, 10))),
                lambda v: tag("table", 1, "".join(tag("tr", 1, tag("th", 1, text(1, 2)) + tag("td", 1, text(1, 5))) for _ in range(r.randint(1, 4)))),
                lambda v: tag("section", 1, tag("h2", 1, text(1, 5)) + tag("p", 1, v)),
                lambda v: tag("p", 1, link()),
            ], [12, 4, 1, 2.5, 1, 0.7, 0.5, 1, 0.4, 0.4, 0.4, 0.8, 0.3])[0](line))
            if r.random() < 0.1:
                out.append(r.choice([note("div", ["ad", "ads", "advert", "sponsored", "promo", "banner"]), note("aside", ["related", "pullout", ""]), menu(["related", "share", "social", "tags"], "div"), form()]))
        if r.random() < 0.1:
            out.append(note("footer", ["entry-footer", "post-footer"], 2, 8) if not plain else "")
        return "".join(out)

    for _ in range(n):
        plain = r.random() < 0.35
        main = r.choices([lambda v: tag("article", 1, v, ["post", "article", "entry"], 0.4), lambda v: tag("main", 1, v), lambda v: tag("main", 1, tag("article", 1, v)), lambda v: tag("div", 1, v, ["content", "main-content", "article-body", "post", "story", "entry-content", "main"], 0.6), lambda v: tag("section", 1, v, ["content", "article"]), lambda v: tag("div", 1, tag("div", 1, v)), lambda v: v], [6, 2, 2, 2, 1, 1, 1])[0](body())
        before = [note("header", ["site-header", "header", "masthead", "top"], 1, 6) if r.random() < 0.5 else "", menu(["nav", "menu", "navbar", "navigation", "breadcrumb"]) if r.random() < 0.85 else menu(["menu", "nav", "breadcrumbs", "topbar"], r.choice(["div", "header"])), note("div", ["ad", "advert", "ads", "advertisement", "banner", "sponsor", "promo"]) if r.random() < 0.6 else "", note("div", ["cookie-notice", "notice", "cookie", "consent", "gdpr", "alert", "popup", "modal"]) if r.random() < 0.35 else "", form() if r.random() < 0.2 else ""]
        foot = lambda: r.choice([note("footer", ["footer", "site-footer", "page-footer"], 2, 14), menu(["footer", "footer-links"], "footer"), note("div", ["footer", "copyright", "legal", "bottom"])])
        after = [comments() if r.random() < 0.45 else "", tag("aside", 0, r.choice([menu(["related", "recent"], "div"), note("div", ["ad", "widget"]), tag("p", 0, text(2, 20)), tag("h3", 0, text(1, 3)) + tag("p", 0, text(2, 30))]), ["sidebar", "related", "widget"], 1.0 if plain else 0.85) if r.random() < 0.4 else note("div", ["sidebar", "side", "widget", "related"]) if r.random() < 0.3 else "", form() if r.random() < 0.2 else "", foot()]
        r.shuffle(before)
        r.shuffle(after)
        middle = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            middle = tag("div", 1, middle, ["wrapper", "page", "container", "layout", "site"], 0.7)
        yield f'<!DOCTYPE html><html {LABEL}="2"><head {LABEL}="0"><title>{text(1, 6)}</title></head><body {LABEL}="2">{middle}</body></html>'


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    """The model of ``labelled_pages``, trained once per process (about a second) and the same everywhere."""
    return train(labelled_pages())


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars (code points)."""
    documents_per_batch(pages.sparkSession)
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = default_model()
        for batch in slices(batches, "html"):
            texts = [extract(h, model) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return read.mapInArrow(run, f"page_id {read.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
