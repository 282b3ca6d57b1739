"""Main text of web pages by a linear-chain conditional random field over their blocks."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the table that the field learns from at most, each of so many characters at most, and made ones.
SAMPLE, SAMPLE_CHARS, MADE = 300, 100_000, 800
#: Steps, step size and penalty of the fit; a feature must occur in so many blocks.
STEPS, STEP, PENALTY, LEAST = 200, 0.1, 1e-3, 3
#: How often a training page hides what its tags and names say, so that the text has to tell.
HIDDEN = 0.15

# The elements that start a block, those without an end, and those whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe object svg math canvas audio video title head".split())
# Fixed value: elements that a start tag ends if they are open, up to the element that bounds the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that say what they hold even without a name.
APART = frozenset("article aside dialog footer form header main nav".split())
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Frame:
    """An open element, with what it and those around it say."""

    tag: str
    said: frozenset[str]
    near: frozenset[str]
    label: int | None
    number: int


@dataclass(slots=True)
class Block:
    """A stretch of text between block boundaries."""

    text: str
    said: frozenset[str]
    own: str
    parent: int
    linked: int
    label: int | None


class Page(HTMLParser):
    """Cuts a page into its leaf blocks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open = [Frame("", frozenset(), frozenset(), None, 0)]
        self.unseen: list[str] = []
        self.words: list[str] = []
        self.linked = self.links = self.count = 0
        self.feed(html)
        self.close()
        self._flush()

    def handle_data(self, data):
        if not self.unseen:
            self.words.append(data)
            if self.links:
                self.linked += len(data)

    def _flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            around = next((f for f in reversed(self.open) if f.tag in BLOCKS), self.open[0])
            self.blocks.append(Block(text, around.said, around.tag, around.number, self.linked, around.label))
        self.words, self.linked = [], 0

    def _pop(self, to: int):
        for frame in self.open[to:]:
            self.links -= frame.tag == "a"
        del self.open[to:]

    def _find(self, tags, bounds=frozenset()) -> int:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                return at
            if self.open[at].tag in bounds:
                return 0
        return 0

    def handle_starttag(self, tag, attrs):
        if self.unseen:
            if tag in UNSEEN and tag not in VOID:
                self.unseen.append(tag)
            elif tag == "body" and self.unseen[-1] == "head":
                self.unseen = []
            return
        if tag in UNSEEN:
            if tag != "head":
                self.unseen.append(tag)
            return
        block = tag in BLOCKS
        if block:
            self._flush()
            if at := self._find({"p"}, {"button", "table", "td", "th", "caption"}):
                self._pop(at)
            if tag in ENDS and (at := self._find(*ENDS[tag])):
                self._pop(at)
        elif tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        above = self.open[-1]
        said, label = set(), above.label
        if tag not in ("html", "body"):
            said.add(f"in:{tag}")
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for word in WORD.findall(value[:500]):
                    word = word.lower()
                    said.add(f"name:{word}")
                    said.add(f"start:{word[:4]}")
            elif name == "data-main":
                label = int(value)
        self.count += 1
        # What the innermost element with a name says counts once more: an advert in an article is no article.
        near = frozenset(f"near {word}" for word in said) if len(said) > 1 or tag in APART else above.near
        around = above.said - above.near
        whole = above.said if near <= above.said and said <= above.said else frozenset(around | said | near)
        self.open.append(Frame(tag, whole, near, label, self.count if block else above.number))
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in UNSEEN and tag not in VOID and self.unseen:
            self.unseen.pop()

    def handle_endtag(self, tag):
        if self.unseen:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
            return
        if tag in BLOCKS:
            self._flush()
        if at := self._find({tag}):
            self._pop(at)


def _step(value: float, edges) -> int:
    return sum(value >= edge for edge in edges)


def _share(data: bytes, of: bytes) -> float:
    return 1 - len(data.translate(None, of)) / len(data)


def _text_features(block: Block, mass: float, before: Block | None) -> list[str]:
    """What a block's text, its place and its share of the page say."""
    text = block.text
    words = text.split(" ")
    data, last = text.encode(), text[-1]
    found = [
        "always",
        f"own:{block.own}",
        f"words:{_step(len(words), (3, 6, 11, 21, 41, 81))}",
        f"links:{_step(block.linked / len(text), (0.01, 0.3, 0.7))}",
        f"commas:{_step(text.count(',') + text.count('.'), (1, 2, 4, 8))}",
        f"digits:{_step(_share(data, b"0123456789"), (0.05, 0.3))}",
        f"upper:{_step(_share(data, CAPITALS), (0.15, 0.5))}",
        f"mass:{_step(mass, (0.02, 0.1, 0.3, 0.6))}",
        "ends" if last in ".!?。…\"'”»)" else "open",
        "same" if before is not None and before.parent == block.parent else "other",
    ]
    if before is None:
        found.append("first")
    if "©" in text or "|" in text or "»" in text or "›" in text:
        found.append("marks")
    # Short texts of few words are mostly labels of the page; long ones may hold any word.
    if len(words) <= 12:
        found += [f"says:{word}" for word in {w.strip(".,:!?()").lower() for w in words} if word]
    return found


def features(blocks: list[Block]) -> list[tuple[frozenset[str], list[str]]]:
    """What is said around every block, and by its text and place."""
    total, held = 0, {}
    for block in blocks:
        held[block.parent] = held.get(block.parent, 0) + len(block.text)
        total += len(block.text)
    befores = [None, *blocks]
    return [(b.said, _text_features(b, held[b.parent] / total, before)) for b, before in zip(blocks, befores)]


class Field:
    """The conditional random field: a weight per feature for content over the rest, and one per change of label."""

    def __init__(self, weights: dict[str, float], change: list[list[float]]):
        self.weights, self.change = weights, change
        self.around: dict[frozenset[str], float] = {}

    def scores(self, blocks: list[Block]) -> list[float]:
        weigh, known = self.weights.get, self.around
        scores = []
        for said, own in features(blocks):
            if said not in known:
                if len(known) > 10_000:
                    known.clear()
                known[said] = sum(weigh(f, 0.0) for f in sorted(said))
            scores.append(known[said] + sum(weigh(f, 0.0) for f in own))
        return scores

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels of all blocks together, by Viterbi; of equal ones, less content."""
        (stay0, go), (leave, stay1) = self.change
        zero, one, back = 0.0, 0.0, []
        for at, score in enumerate(self.scores(blocks)):
            if at:
                from0 = (leave + one > stay0 + zero, stay1 + one > go + zero)
                zero, one = max(stay0 + zero, leave + one), max(go + zero, stay1 + one)
                back.append(from0)
            one += score
        labels = [int(one > zero)] if blocks else []
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def text(self, html: str | None) -> str:
        """The main text of a page, a block a line."""
        blocks = Page(html).blocks if html else []
        return "\n".join(block.text for block, label in zip(blocks, self.decode(blocks)) if label)


def fit(pages: list[list[Block]], seed: int = 12) -> Field:
    """Learns from blocks with labels, all pages at once by their likelihood.

    Every page also takes part without what its elements say (``HIDDEN`` of the pages), else the
    text would never be asked. Pages without a label in some block take no part.
    """
    dice = random.Random(seed)
    pages = [blocks for blocks in pages if blocks and all(block.label is not None for block in blocks)]
    told = []
    for blocks in pages:
        hide = dice.random() < HIDDEN
        told.append([([] if hide else sorted(said)) + own for said, own in features(blocks)])
    seen: dict[str, int] = {}
    for page in told:
        for found in page:
            for feature in found:
                seen[feature] = seen.get(feature, 0) + 1
    names = sorted(f for f, n in seen.items() if n >= LEAST)
    if not names:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]])
    number = {f: i for i, f in enumerate(names)}
    order = sorted(range(len(told)), key=lambda i: -len(told[i]))
    told, pages = [told[i] for i in order], [pages[i] for i in order]
    depth = len(told[0])
    # Blocks by their place in the page, longest pages first: a step of the recursions takes a prefix of the pages.
    alive = [sum(len(page) > t for page in told) for t in range(depth)]
    starts = np.concatenate([[0], np.cumsum(alive)])
    cells = [(starts[t] + p, number[f]) for p, page in enumerate(told) for t, found in enumerate(page) for f in found if f in number]
    row, column = np.array(cells, np.int64).T
    truth = np.zeros(starts[-1], np.int64)
    for p, blocks in enumerate(pages):
        for t, block in enumerate(blocks):
            truth[starts[t] + p] = block.label
    weights, change = np.zeros(len(names)), np.zeros((2, 2))
    pairs = np.zeros((2, 2))
    for t in range(1, depth):
        before, now = truth[starts[t - 1] : starts[t - 1] + alive[t]], truth[starts[t] : starts[t + 1]]
        np.add.at(pairs, (before, now), 1)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (weights, change)]
    for step in range(1, STEPS + 1):
        score = np.zeros((starts[-1], 2))
        score[:, 1] = np.bincount(row, weights[column], len(score))
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        for t in range(depth):
            now = slice(starts[t], starts[t + 1])
            forward[now] = score[now]
            if t:
                last = forward[starts[t - 1] : starts[t - 1] + alive[t]]
                forward[now] += np.logaddexp(last[:, :1] + change[0], last[:, 1:] + change[1])
        expected = np.zeros((2, 2))
        for t in range(depth - 1, 0, -1):
            now, last = slice(starts[t], starts[t + 1]), slice(starts[t - 1], starts[t - 1] + alive[t])
            ahead = score[now] + backward[now]
            joint = forward[last][:, :, None] + change[None] + ahead[:, None, :]
            backward[last] = np.logaddexp(joint[:, :, 0] - forward[last], joint[:, :, 1] - forward[last])
            expected += np.exp(joint - np.logaddexp.reduce(joint.reshape(len(joint), -1), axis=1)[:, None, None]).sum(axis=0)
        whole = forward + backward
        likely = 1 / (1 + np.exp(whole[:, 0] - whole[:, 1]))
        slope = np.bincount(column, (truth - likely)[row], len(weights)) / len(pages) - PENALTY * weights
        slopes = (slope, (pairs - expected) / len(pages) - PENALTY * change)
        for value, slope, (mean, square) in zip((weights, change), slopes, moments):
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope**2 - square)
            value += STEP * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(dict(zip(names, weights.tolist())), change.tolist())


def label_by_elements(blocks: list[Block]) -> bool:
    """Labels the blocks of a page that has its text in an article or main element; whether it has one."""
    boundary = {"in:nav", "in:header", "in:footer", "in:aside", "in:form"}
    for block in blocks:
        block.label = int(("in:article" in block.said or "in:main" in block.said) and not block.said & boundary)
    return any(block.label for block in blocks)


def train(pages: DataFrame, seed: int = 12) -> Field:
    """Fits on made pages, and on at most ``SAMPLE`` pages of the table that mark their article by an element.

    The pages are those of the smallest hash of page_id and html among about four times as many, of
    ``SAMPLE_CHARS`` characters at most. The rest is left out by its hash, so that tasks send few pages to the driver.
    """
    from caseloom.llm.layouts import made_pages

    share = min(1.0, 4 * SAMPLE / max(pages.count(), 1))
    few = F.pmod(F.xxhash64("page_id", F.xxhash64("html")), F.lit(1 << 30)) < int(share * (1 << 30))
    short = pages.filter(few).filter(F.length("html").between(1, SAMPLE_CHARS) & F.lower("html").rlike("<(article|main)[ >]")).select("page_id", "html")
    chosen = short.orderBy(F.xxhash64("page_id", "html"), "page_id", "html").limit(SAMPLE)
    found = [Page(row["html"]).blocks for row in chosen.collect()]
    found = [blocks for blocks in found if label_by_elements(blocks)]
    return fit(found + [Page(html).blocks for html in made_pages(MADE, seed)], seed)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    A page is cut at the starts and ends of block elements; character references are decoded, white
    space within a block becomes one space, ``br`` too, and blocks without text vanish. The field labels all
    blocks of a page together; those it calls content are the text, one a line. Scripts, styles
    and other content that isn't shown as text are never blocks.

    Null, empty and textless pages have an empty text. Broken markup is read as far as it goes. Rows that are equal
    or share a page_id each get a row. An empty table gives no rows. Other columns are ignored.
    """
    weights, change = field.weights, field.change

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Field(weights, change)
        for batch in batches:
            texts = [learned.text(html.as_py()) for html in batch["html"]]
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
