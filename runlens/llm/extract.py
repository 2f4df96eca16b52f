"""Main text of web pages: the maximum-scoring run of words and tags.

A page is labelled by its own article or main element. What labelled pages of a
sample hold inside and outside it gives log odds to each kind of tag (tag and
class, id or role token). The scan's weights are these log odds: tags score
negative, words positive, but negative by the log odds of a boilerplate element
around them, so that the run's borders are the scan's alone. Elements marked as
boilerplate are left out only where the run goes on before and after them. A list
of elements and tokens is only a prior for kinds that the sample tells little of.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, table

#: Labelled pages that fit the weights on average, chosen by a hash of page_id, and the times that a kind must be met in them.
SAMPLE, LEAST_MET = 4000, 3
#: Weights of tags lie between these; elements with log odds below MARKED are boilerplate, and their words weigh as much, without a bound.
LEAST, MOST, MARKED = -3.0, -0.02, -1.0
#: Pseudo-counts (inside, outside) of kinds on the list below, and of others.
LISTED, PLAIN = (0.5, 4.5), (0.5, 0.5)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>script|style|noscript|template|svg|textarea|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|[^<]+|<",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that set parts of a page apart, so that a mark on one without a class can be told; lists, links and the like only have weights.
PARTS = frozenset("head nav header footer aside section form dialog menu details select button".split())
#: Prior: elements, and whole tokens of class, id or role, whose content isn't the page's main text as a rule.
ASIDE = frozenset("head nav footer aside form button select menu dialog".split())
ASIDE_WORDS = frozenset("ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer menu nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())


def names(attrs: str) -> list[str]:
    """Whole tokens of class, id and role: 'has-sidebar' isn't 'sidebar'."""
    return [w for m in ATTR.finditer(attrs) for w in (m[2] or m[3] or m[4] or "").lower().split()]


@dataclass
class Element:
    """``words``: all in it; ``plain``: without those in marked elements inside; ``off``: marked as boilerplate, alone or by what holds it.

    ``pro`` and ``con``: log odds of its own kind, and the least of those that tell against it; ``inner``: within
    an article or main element; ``weight``: the scan's weight of one of its words.
    """

    tag: str
    up: int
    kinds: tuple[str, ...] = ()
    marked: bool = False
    pro: float = 0.0
    con: float = 0.0
    inner: bool = False
    weight: float = 1.0
    words: int = 0
    plain: int = 0
    off: bool = False


def listed(kind: str) -> bool:
    tag, _, token = kind.partition(".")
    return token in ASIDE_WORDS if token else tag in ASIDE or tag == "header"


def odds(kind: str, counts: dict[str, tuple[int, int]]) -> float:
    """Log odds that an element of this kind is in the content, from its counts (in, out of labelled content) and the prior."""
    (inside, outside), (a, b) = counts.get(kind, (0, 0)), LISTED if listed(kind) else PLAIN
    return log((inside + a) / (outside + b))


class Weights:
    """Log odds by kind of tag, kept once worked out."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts
        self.odds: dict[str, float] = {}

    def of(self, kind: str) -> float:
        got = self.odds.get(kind)
        if got is None:
            got = odds(kind, self.counts)
            if len(self.odds) < 100_000:
                self.odds[kind] = got
        return got

    def tag(self, kind: str) -> float:
        """The scan's weight of a tag: that of its kind, or of the bare tag where the kind wasn't met."""
        kind = kind.lstrip("/")
        return min(MOST, max(LEAST, self.of(kind if kind in self.counts or listed(kind) else kind.split(".")[0])))

    def weigh(self, e: Element) -> None:
        """Set ``pro``, ``con`` and ``marked``: by any token of its class, id or role, or by its tag if that is one of PARTS; a header in the main element isn't boilerplate."""
        e.pro = self.of(e.kinds[0])
        if e.tag in ("html", "body", "article", "main"):
            return
        named = [k for k in e.kinds if "." in k and not (e.inner and k.endswith(".header"))]
        bare = e.tag in PARTS and not (e.inner and e.tag == "header")
        e.con = min([*map(self.of, named), self.of(e.tag) if bare else 0.0])
        e.marked = e.con < MARKED


def settle(elements: list[Element]) -> None:
    """Set ``off`` and ``weight``: marks fall from what holds the main element, the greatest article or, on a page of neither, over half of the words.

    An article lifts the mark of an element only with half or more of its plain
    words, so that one of many comments doesn't. Nav, footer and the like keep
    theirs on a page of neither. Words of a marked element weigh its log odds,
    or nothing inside an article or main element, where they don't tell that it
    has ended; others weigh the log odds of their element, 1 at least.
    """
    total = sum(e.words for e in elements)
    for e in reversed(elements):
        e.plain += e.words
    for e in reversed(elements):
        if e.up >= 0:
            elements[e.up].words += e.words
            elements[e.up].plain += 0 if e.marked else e.plain
    cores = [max(found, key=lambda e: e.words) for tag in ("main", "article") if (found := [e for e in elements if e.tag == tag and e.words])]
    for core in cores:
        at = core.up
        while at >= 0:
            e = elements[at]
            e.marked = e.marked and core.tag == "article" and 2 * core.words < e.plain
            at = e.up
    for e in elements:
        if not cores and e.marked and (e.tag == "form" or e.tag not in ASIDE) and 2 * e.plain > total:
            e.marked = False
        up = elements[e.up] if e.up >= 0 else None
        e.off = e.marked or up is not None and up.off
        if up is not None and up.off:
            e.weight = up.weight
        elif e.marked:
            e.weight = 0.0 if e.inner else e.con
        else:
            e.weight = max(1.0, e.pro)


def parse(page: str, weights: Weights) -> tuple[list[tuple[str, str, int, bool]], list[Element]]:
    """(items, elements): items are (kind, text, element, block) of every tag and text run, kind '' for text, else the tag with its first token."""
    stack: list[tuple[str, str, int]] = []
    elements, out = [Element("", -1)], []
    mains = 0
    for m in TOKEN.finditer(page):
        tag = m["tag"] or m["tag2"]
        here = stack[-1][2] if stack else 0
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                elements[here].words += len(m[0].split())
                out.append(("", m[0], here, False))
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            kind = f"/{tag}"
            if any(t == tag for t, _, _ in stack):
                while stack:
                    t, k, _ = stack.pop()
                    mains -= t in ("article", "main")
                    if t == tag:
                        kind = f"/{k}"
                        break
            out.append((kind, "", stack[-1][2] if stack else 0, tag in BLOCKS))
            continue
        words = names(attrs) if attrs.strip("/ ") else []
        kind = f"{tag}.{words[0]}" if words else tag
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            out.append((kind, "", here, tag in BLOCKS))
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            here = stack[-1][2] if stack else 0
        e = Element(tag, here, tuple(f"{tag}.{w}" for w in words) or (tag,), inner=mains > 0)
        weights.weigh(e)
        elements.append(e)
        stack.append((tag, kind, len(elements) - 1))
        mains += tag in ("article", "main")
        out.append((kind, "", len(elements) - 1, tag in BLOCKS))
    return out, elements


def counted(page: str) -> Counter[tuple[str, bool]]:
    """Elements of a labelled page by kind and by whether they are in its article or main element.

    What holds that element counts as neither, nor does what the list marks
    inside it: there the label tells nothing.
    """
    _, elements = parse(page, Weights({}))
    out: Counter[tuple[str, bool]] = Counter()
    cores = [i for i, e in enumerate(elements) if e.tag in ("article", "main")]
    holds, inside, unsure = set(), set(cores), set()
    for i in cores:
        at = elements[i].up
        while at >= 0:
            holds.add(at)
            at = elements[at].up
    for i, e in enumerate(elements):
        if e.up in inside:
            (unsure if e.marked else inside).add(i)
        elif e.up in unsure:
            unsure.add(i)
        if cores and i not in holds and i not in unsure:
            out.update((k, i in inside) for k in e.kinds)
    return out


def main_text(page: str, weights: Weights) -> str:
    """Text of the best run: one scan over the weights of words and tags finds the run with the greatest sum, the first of equal ones.

    Marked elements are left out of it only between words that score above 0.
    """
    items, elements = parse(page, weights)
    settle(elements)
    scores = [len(text.split()) * elements[at].weight if not kind else MOST if elements[at].off and not elements[at].weight else weights.tag(kind) for kind, text, at, _ in items]
    start, stop = best_run(scores)
    above = [i for i in range(start, stop) if scores[i] > 0] or [start]
    blocks: list[str] = []
    held: list[str] = []
    for i, (kind, text, at, block) in [*enumerate(items[start:stop], start), (stop, ("p", "", 0, True))]:
        if block:
            if joined := " ".join("".join(held).split()):
                blocks.append(joined)
            held = []
        elif kind.startswith("br"):
            held.append(" ")
        elif not kind and not (elements[at].off and above[0] < i < above[-1]):
            held.append(html.unescape(text))
    return "\n".join(blocks)


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, stop) of the run with the greatest sum, the first and then shortest of equal ones; empty if no sum is above 0."""
    best, at, sum_, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += score
        if sum_ > best:
            best, at = sum_, (start, i + 1)
    return at


def fit(pages: DataFrame) -> dict[str, tuple[int, int]]:
    """Counts (in, out of content) of each kind of tag that is met LEAST_MET times in a bounded sample of the labelled pages (html)."""
    labelled = pages.where(F.lower("html").rlike("<(article|main)[\\s>]"))
    n = labelled.count()
    sample = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, n)) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                sums.update(counted(page))
        kinds = sorted({k for k, _ in sums})
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([sums[k, True] for k in kinds], pa.int64()), pa.array([sums[k, False] for k in kinds], pa.int64())], ["kind", "inside", "outside"])

    sums = sample.select("html").mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return {r.kind: (r.inside, r.outside) for r in sums.where(F.col("inside") + F.col("outside") >= LEAST_MET).collect()}


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    The text is that of the best run, without the elements that are marked as
    boilerplate (menus, headers and footers of the page, sidebars, notices,
    adverts, forms, comments) between its words, but not without the article that
    such an element itself wraps. Without labelled pages the prior alone decides.
    Null or empty html, and pages without words, give an empty text. Unclosed
    tags end with what holds them; a stray '<' is text. Repeated rows stay.
    """
    importable(df.sparkSession)
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    counts = fit(pages)  # kinds of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(counts)
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_max_subsequence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
