"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags, with
their open ancestors. Features come from ancestor tags, words of class and id attributes, and the
text itself. A two-label chain (boilerplate, content) is trained by maximum likelihood on labelled
pages and decoded by Viterbi; the text is the content blocks in page order.

Labelled pages are a bounded sample of the corpus itself, FIT_PAGES pages of at most FIT_CHARS
characters whose authors marked the article (``article`` or ``main``), labelled by that mark, and SEED_PAGES, hand-labelled layouts
with parts such a corpus may lack. Each sampled page is also given with its mark hidden, so that
the chain learns to do without.

Defined cases: null html is the empty page, whose text is empty; a page without content blocks has
empty text; broken markup is read as browsers do in simple cases (a new block closes an open
paragraph, stray end tags are skipped); very long and deeply nested pages are read whole, in steps
in proportion to their length; repeated rows are read one by one; extra columns are ignored,
whatever their names; empty tables give empty results."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamkit.llm._shared import small_batches

#: Marked pages of the corpus that the chain is trained on, at most: those first in hash order.
FIT_PAGES = 200
#: Characters that such a page may have; longer ones are read and extracted like all others, but
#: nothing is learnt from them.
FIT_CHARS = 100_000
EPOCHS, RATE, RIDGE = 40, 0.3, 1e-3

#: HTML's element classes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template svg iframe textarea".split())

OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: What ends the plain part of a tag.
SPECIAL = re.compile("[>\"']")
#: End tags of HIDDEN_TAGS.
ENDING = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in HIDDEN_TAGS}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[a-z]+|[0-9]+")


class Node:
    """An open element: what its names add to those of its ancestors. Paths share their nodes, so
    that nesting costs no copies."""

    __slots__ = ("names", "score", "tag", "up")

    def __init__(self, tag: str, names: tuple[str, ...], up: Node | None):
        self.tag, self.names, self.up = tag, names, up
        self.score: tuple[float, float] | None = None

    def path(self) -> set[str]:
        found, node = set(), self
        while node:
            found.update(node.names)
            node = node.up
        return found


@dataclass
class Block:
    text: str
    node: Node
    linked: int  # characters inside links


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    found = ["in:" + tag]
    if "=" in attributes:
        for m in NAMED.finditer(attributes):
            found += ["cls:" + w for w in PART.findall((m[1] or m[2] or m[3] or "").lower())]
    return tuple(found)


class Scanner:
    """Finds the ends of tags and elements in a page. Places are asked for in ascending order, and
    what was found, or found missing, is remembered, so that all questions together take steps in
    proportion to the page."""

    def __init__(self, page: str):
        self.page = page
        self.special = self.gt = -1
        self.closing: dict[str, re.Match | None] = {}
        self.dead: set[int] = set()  # quotes from which no tag's end is reached

    def tag_end(self, at: int) -> int:
        """The ">" outside quotes that ends a tag whose name ends before ``at``, or -1."""
        if self.special < at:
            found = SPECIAL.search(self.page, at)
            self.special = found.start() if found else len(self.page)
        place, seen = self.special, []
        while place < len(self.page) and self.page[place] != ">" and place not in self.dead:
            seen.append(place)
            close = self.page.find(self.page[place], place + 1)
            found = SPECIAL.search(self.page, close + 1) if close >= 0 else None
            place = found.start() if found else len(self.page)
        if place < len(self.page) and self.page[place] == ">":
            return place
        self.dead.update(seen)
        return -1

    def next_gt(self, at: int) -> int:
        if self.gt < at:
            found = self.page.find(">", at)
            self.gt = found if found >= 0 else len(self.page)
        return self.gt if self.gt < len(self.page) else -1

    def element_end(self, tag: str, at: int) -> int:
        """Where the next end tag of this name after ``at`` ends, or -1."""
        known = self.closing.get(tag, self)
        if known is self or known is not None and known.start() < at:
            known = self.closing[tag] = ENDING[tag].search(self.page, at)
        return known.end() if known is not None else -1


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether an end tag, attributes) of the markup of a page; comments,
    declarations and hidden elements have no name.

    An element of HIDDEN_TAGS goes with its text; a self-closed svg is empty, and where an end tag
    is missing only the start tag goes, but for script and style, which then run to the end of the
    page. A "<" that nothing closes is text."""
    scanner, at = Scanner(page), page.find("<")
    while at >= 0:
        end, name, closes, attributes = -1, "", False, ""
        if page.startswith("<!--", at):
            found = page.find("-->", at + 4)
            end = found + 3 if found >= 0 else len(page)
        elif (m := OPENING.match(page, at)) and (gt := scanner.tag_end(m.end())) >= 0:
            end, name, closes, attributes = gt + 1, m[2].lower(), bool(m[1]), page[m.end() : gt]
            whole = not closes and name in HIDDEN_TAGS and (page[m.end()] in "/>" or page[m.end()].isspace())
            if whole and not (name == "svg" and attributes.endswith("/")):
                past = scanner.element_end(name, end)
                if past < 0 and name in ("script", "style"):
                    past = len(page)
                if past >= 0:
                    end, name = past, ""
            elif whole:
                name = ""
        elif page[at + 1 : at + 2] in ("!", "?", "/") and (gt := scanner.next_gt(at + 2)) >= 0:
            end = gt + 1
        if end >= 0:
            yield at, end, name, closes, attributes
        at = page.find("<", end if end >= 0 else at + 1)


def decoded(raw: str) -> str:
    """Text with its character references decoded; numbers of any length are read."""
    try:
        return entities.unescape(raw)
    except ValueError:  # more digits than int() takes
        short = re.sub(r"&#0+(?=[0-9])", "&#", raw)
        return entities.unescape(re.sub(r"&#[0-9]{8,}+;?", "\ufffd", short))


#: Tags that a tag of the same name closes.
ALIKE = frozenset(["li", "dt", "dd", "td", "th", "tr", "option"])


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, white space squeezed, references decoded."""
    out: list[Block] = []
    stack: list[Node] = []
    pieces: list[str] = []
    open_tags: Counter[str] = Counter()
    open_names: Counter[str] = Counter()
    root = Node("", (), None)
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            out.append(Block(text, stack[-1] if stack else root, linked))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = decoded(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text)

    def opened(tag: str, names: tuple[str, ...]) -> None:
        stack.append(Node(tag, tuple(n for n in dict.fromkeys(names) if not open_names[n]), stack[-1] if stack else None))
        open_names.update(stack[-1].names)
        open_tags[tag] += 1

    def closed() -> str:
        node = stack.pop()
        open_names.subtract(node.names)
        open_tags[node.tag] -= 1
        return node.tag

    at = 0
    for start, end, tag, closes, attributes in tags(page):
        if start > at:
            add(page[at:start])
        at = end
        if tag == "a":
            links = 0 if closes else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            if closes:
                while open_tags[tag] and closed() != tag:
                    pass
            elif tag not in VOID_TAGS:
                if stack and (stack[-1].tag == "p" or tag == stack[-1].tag and tag in ALIKE):
                    closed()
                opened(tag, _names(tag, attributes))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def path_features(block: Block) -> set[str]:
    return block.node.path() | {"tag:" + block.node.tag}


def text_features(block: Block, first: bool, last: bool) -> list[str]:
    text, n = block.text, len(block.text)
    found = [f"len:{min(8, n.bit_length())}", f"words:{min(6, (text.count(' ') + 1).bit_length())}", f"links:{min(3, 4 * block.linked // (n + 1))}"]
    if text[-1] in ".!?…»”\"'":
        found.append("ends:stop")
    if text[0] in "©&|»«•":
        found.append("starts:mark")
    if "," in text:
        found.append("has:comma")
    if first:
        found.append("first")
    if last:
        found.append("last")
    return found


#: Ancestors that mark an article, and those that are never part of its text.
MARKS = frozenset(["in:article", "in:main"])
OUTSIDE = frozenset("in:nav in:aside in:footer in:form in:header in:head in:button in:select in:menu in:dialog cls:ad cls:ads cls:advert cls:comment cls:comments cls:sidebar cls:cookie cls:notice cls:share cls:related cls:newsletter cls:promo cls:menu cls:nav cls:footer".split())

#: Hand-labelled layouts; content blocks begin with "+".
SEED_PAGES = [
    """<html><head><title>Old bridge opens</title></head><body><header><h1>The Daily</h1><p>News since 1901, every day.</p></header><nav><a href=/>Home</a><a href=/w>World</a></nav>
<div id="cookie-notice" class="notice">We use cookies, as all do. <button>Accept</button></div><main><h1>+Old bridge opens</h1><p>+The bridge, closed for years, opened again on Monday.</p>
<div class="ad">Buy two, pay for one, only today.</div><p>+Hundreds came to cross it, the mayor among them.</p><aside class="sidebar"><h3>Related</h3><ul><li><a href=/a>Ten more bridges</a></li></ul></aside>
<blockquote>+It is wider than I remember, she said.</blockquote></main><form><label>Your mail</label><p>Sign up for our letters, they are free.</p><button>Send</button></form>
<section class="comments" id="comments"><h2>Comments</h2><div class="comment"><p>I walked over it this morning, and it was fine.</p></div><div class="comment"><p>About time, I would say.</p></div></section>
<footer><p>All rights reserved, The Daily.</p></footer></body></html>""",
    """<html><body><div class="header"><h1>Kitchen notes</h1></div><div class="menu nav"><ul><li><a href=/1>Soups</a></li><li><a href=/2>Bread</a></li></ul></div>
<div class="content"><h1>+Plain bread</h1><p>+Flour, water, salt and time are all that is needed.</p><ul><li>+500 grams of flour, sifted</li><li>+350 grams of water</li></ul><p>+Wait until it has doubled.</p></div>
<div class="sidebar"><h3>Popular</h3><p>Our best soups of the year, in one place.</p></div><div class="ads advert"><p>Pans that last, now at half the price.</p></div><div class="promo newsletter"><p>Get one recipe a week, by mail.</p></div>
<div class="comments"><p>Mine did not rise, what did I do wrong?</p><p>Use warmer water, that helped me.</p></div><div class="footer"><p>Kitchen notes, made at home.</p></div></body></html>""",
    """<html><body><nav><ul><li><a href=/x>Start</a></li></ul></nav><article><header><h1>+On rivers</h1></header><p>+Rivers carve, carry and drop what they carry.</p><div class="notice">This page is shown without pictures.</div>
<h2>+Sources</h2><p>+A river begins where water gathers, often at a spring.</p><pre>+flow = width * depth * speed</pre><div class="share"><a href=/s>Share</a></div><form><p>Was this page of use to you?</p></form>
<aside><p>More on lakes and seas, in our other pages.</p></aside><table><tr><td>+Length, in km</td><td>+120</td></tr></table><section class="comment-list"><p>Thank you, this was a good read.</p></section></article><footer>&copy; Rivers</footer></body></html>""",
]


def seed() -> list[tuple[list[Block], list[int]]]:
    out = []
    for page in SEED_PAGES:
        found = blocks(page)
        labels = [int(b.text.startswith("+")) for b in found]
        for b in found:
            b.text = b.text.removeprefix("+")
        out.append((found, labels))
    return out


def marked(page: str) -> tuple[list[Block], list[int]]:
    """A page with the labels that its own mark-up gives."""
    found = blocks(page)
    paths = [b.node.path() for b in found]
    return found, [int(not OUTSIDE.intersection(p) and bool(MARKS.intersection(p))) for p in paths]


@dataclass
class Chain:
    """Weights of features by label, of labels by their predecessor, and of the first label."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def path_score(self, node: Node) -> tuple[float, float]:
        """The summed weights of a node's path; every node is added up once."""
        trail: list[Node] = []
        while node and node.score is None:
            trail.append(node)
            node = node.up
        x, y = node.score if node else (0.0, 0.0)
        for step in reversed(trail):
            for f in step.names:
                p, q = self.weights.get(f, (0.0, 0.0))
                x, y = x + p, y + q
            step.score = (x, y)
        return x, y

    def decode(self, found: list[Block]) -> list[int]:
        """Viterbi."""
        if not found:
            return []
        get, last, back = self.weights.get, len(found) - 1, []
        (s00, s01), (s10, s11) = self.steps.tolist()
        a = b = 0.0
        for i, block in enumerate(found):
            x, y = self.path_score(block.node)
            p, q = get("tag:" + block.node.tag, (0.0, 0.0))
            x, y = x + p, y + q
            for f in text_features(block, i == 0, i == last):
                p, q = get(f, (0.0, 0.0))
                x, y = x + p, y + q
            if i:
                back.append((a + s00 < b + s10, a + s01 < b + s11))
                a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
            else:
                a, b = x, y
        label = int(b > a)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(labelled: list[tuple[list[Block], list[int], bool]]) -> Chain:
    """Maximum likelihood by Adagrad; all sequences step together, padded. The third item of a
    labelled page says whether its mark is hidden."""
    ids: dict[str, int] = {}
    rows, cols, pages = [], [], [x for x in labelled if x[0]]
    if not pages:
        return Chain()
    longest = max(len(p[0]) for p in pages)
    y, live = np.zeros((len(pages), longest), np.int64), np.zeros((len(pages), longest), bool)
    for p, (found, labels, hidden) in enumerate(pages):
        for i, block in enumerate(found):
            features = path_features(block).union(text_features(block, i == 0, i == len(found) - 1))
            for f in sorted(features - MARKS if hidden else features):
                rows.append(p * longest + i)
                cols.append(ids.setdefault(f, len(ids)))
            y[p, i], live[p, i] = labels[i], True
    r, c = np.array(rows), np.array(cols)
    n = y.size
    w, steps = np.zeros((len(ids), 2)), np.zeros((2, 2))
    gw, gs = np.full_like(w, 1e-3), np.full_like(steps, 1e-3)
    truth, at = np.eye(2)[y], np.arange(len(pages))
    for _ in range(EPOCHS):
        e = np.stack([np.bincount(r, w[c, k], n) for k in (0, 1)], 1).reshape(len(pages), longest, 2)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for i in range(1, longest):
            on = _logsum(forward[:, i - 1, :, None] + steps[None], 1) + e[:, i]
            forward[:, i] = np.where(live[:, i, None], on, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            on = _logsum(steps[None] + (e[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            backward[:, i] = np.where(live[:, i + 1, None], on, 0.0)
        z = _logsum(forward[at, live.sum(1) - 1], 1)
        single = np.exp(forward + backward - z[:, None, None]) * live[:, :, None]
        pair = forward[:, :-1, :, None] + steps + (e + backward)[:, 1:, None, :] - z[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0)) * live[:, 1:, None, None]
        seen = (truth[:, :-1, :, None] * truth[:, 1:, None, :]) * live[:, 1:, None, None]
        lack = ((truth * live[:, :, None]) - single).reshape(n, 2)
        dw = np.stack([np.bincount(c, lack[r, k], len(ids)) for k in (0, 1)], 1) / len(pages) - RIDGE * w
        ds = (seen - pair).sum((0, 1)) / len(pages) - RIDGE * steps
        gw += dw**2
        gs += ds**2
        w += RATE * dw / np.sqrt(gw)
        steps += RATE * ds / np.sqrt(gs)
    return Chain({f: (float(w[i, 0]), float(w[i, 1])) for f, i in ids.items()}, steps)


def sampled(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES) -> list[str]:
    """At most ``fit_pages`` different marked pages of FIT_CHARS characters or fewer: those first
    in hash order. The hashes alone are ordered; only the pages chosen are fetched."""
    page = F.col(f"`{html_col}`")
    keyed = pages.where((F.length(page) <= FIT_CHARS) & page.rlike("(?i)<(article|main)[\\s>]")).select(F.xxhash64(F.col(f"`{id_col}`"), page).alias("h"), page.alias("html"))
    first = [r["h"] for r in keyed.select("h").distinct().orderBy("h").limit(fit_pages).collect()]
    if not first:
        return []
    rows = keyed.where(F.col("h").isin(first)).groupBy("h").agg(F.first("html").alias("html")).collect()
    return [r["html"] for r in sorted(rows, key=lambda r: r["h"])]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES) -> Chain:
    """The chain, trained on a bounded sample of marked pages and the seed pages."""
    labelled = [marked(page) for page in sampled(pages, id_col, html_col, fit_pages)]
    seeds = seed()
    again = max(1, len(labelled) // (6 * len(seeds)))
    return train([(*x, hidden) for x in labelled for hidden in (False, True)] + [(*x, hidden) for x in seeds for hidden in (False, True) for _ in range(again)])


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks): the main text of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(chain or fit(pages, id_col, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, counts = [], []
            for page in pc.fill_null(batch.column(2), ""):
                found = blocks(page.as_py())
                kept = [b.text for b, label in zip(found, model.decode(found)) if label]
                texts.append("\n\n".join(kept))
                counts.append(len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
