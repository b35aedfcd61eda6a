"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between tags that break lines. Each block has a tag path, from the
root to the block's element, with classes. Over all blocks of a path, text length, punctuation and link text
are added up. The ratios of text and of punctuation to the number of blocks are smoothed along the page,
averaged for each path and fused by a product that link text lowers. Paths above a share of the best fused
ratio are content. The deepest element that holds most of the selected text is the article; what it holds
beside, such as headings and short paragraphs, is content too unless it is mostly links.

Elements that say what they are - menus, footers, sidebars, forms, dialogs, hidden ones - have ratio zero. Words of a class, id or
role that name headers, notices, adverts or reader comments only lower the ratio of what is inside by a factor, so long text wins over a name; a name
does not count at all on an element that holds most of the page's text. The elements made for content double the ratio. Scripts,
styles and comments of the markup hold no text.

White space within a block becomes one space, blocks are joined by one space. Null and empty html give the
empty text, as do pages without content. Broken markup is read as browsers mostly do, in time linear in the page's length.
Each row gives a row, repeated ones too; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
# Elements by their role in HTML.
RAW = frozenset("script style noscript template iframe textarea title svg math object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS_IN = frozenset("ul ol dl table tr tbody thead div article section body html".split())
NEVER = frozenset("nav footer aside form menu dialog button head".split())
CONTENT = frozenset("article main".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets related recommended share "
    "sharing social comment comments reply replies respond discussion disqus footer masthead topbar toolbar pagination pager copyright legal disclaimer skip complementary contentinfo".split()
)
HEADERS = frozenset("header banner".split())
#: Factors of the ratio for names that speak against content, and for elements made for it.
NAMED_WEIGHT, CONTENT_WEIGHT = 0.05, 2.0
OWN = frozenset("article entry post content story body main".split())


class _Element:
    __slots__ = ("tag", "path", "parent", "never", "named", "content", "chars", "held", "number", "depth")

    def __init__(self, tag: str, path: int, parent: _Element | None, never: bool, named: bool, content: bool, number: int):
        self.tag, self.path, self.parent, self.never, self.named, self.content, self.chars, self.held, self.number = tag, path, parent, never, named, content, 0, 0, number
        self.depth = 0 if parent is None else parent.depth + 1


class _Block:
    __slots__ = ("text", "at", "links", "marks")

    def __init__(self, text: str, at: _Element, links: int):
        self.text, self.at, self.links, self.marks = text, at, links, len(MARKS.findall(text))


def blocks(page: str) -> tuple[list[_Block], list[_Element]]:
    """The text blocks of a page in their order, each with its element, and all elements, parents before children."""
    numbers: dict[tuple[int, str], int] = {}
    root = _Element("", 0, None, False, False, False, 0)
    stack, out, parts, elements = [root], [], [], [root]
    where: dict[str, list[int]] = {}  # places of each tag in the stack
    links, in_link, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(_Block(text, stack[-1], links))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            links += len(text.strip())

    def close(tags: tuple[str, ...], stop: frozenset) -> None:
        """Close the last open element of tags, and what is in it, unless a later one is in stop."""
        last = max((where[t][-1] for t in tags if where.get(t)), default=0)
        if last and all(not where.get(t) or where[t][-1] <= last for t in stop):
            for x in stack[last:]:
                where[x.tag].pop()
            del stack[last:]

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE and tag not in RAW:
            if tag == "a":
                in_link = 0 if m[1] else 1
            continue
        if m[1]:
            flush()
            if tag not in VOID:
                close((tag,), frozenset())
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = shut.end() if shut else end
            continue
        flush()
        if tag in VOID:
            continue
        in_link = 0 if tag in ENDS_P else in_link
        if tag in ENDS_P:
            close(("p",), KEEPS_IN)
        elif tag in ENDS_SELF:
            close(ENDS_SELF[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        named = {k.lower(): a or b or c or "" for k, a, b, c in NAMED.findall(m[3])} if m[3] else {}
        top = stack[-1]
        words = {w.lower() for k in ("class", "id", "role") for w in WORDS.findall(named.get(k, ""))}
        whole = tag in ("html", "body")
        header = tag == "header" or bool(words & HEADERS)
        by_name = not whole and bool(words & NAMES or header and not words & OWN and not top.content)
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        label = f"{tag}.{named.get('class', '')}"
        path = numbers.setdefault((top.path, label), len(numbers) + 1)
        where.setdefault(tag, []).append(len(stack))
        elements.append(_Element(tag, path, top, top.never or tag in NEVER or hidden, by_name, top.content or tag in CONTENT, len(elements)))
        stack.append(elements[-1])
    flush()
    return out, elements


def _smooth(values: list[float]) -> list[float]:
    """Gaussian window of five, on values of neighbouring blocks; at the ends of the page, of the part that is there."""
    weights = np.array([0.054, 0.242, 0.399, 0.242, 0.054])
    part = lambda x: np.convolve(x, weights)[2 : len(x) + 2]
    return (part(values) / part(np.ones(len(values)))).tolist() if values else []


def select(found: list[_Block], elements: list[_Element], least_share: float = 0.3) -> list[_Block]:
    """The content blocks."""
    for b in found:
        b.at.chars += len(b.text)
    for e in reversed(elements[1:]):  # children before parents
        e.parent.chars += e.chars
    total = elements[0].chars
    for e in elements[1:]:
        e.named = e.parent.named or (e.named and e.chars <= 0.6 * total)

    # A path counts apart where it is named and where it is not.
    key = lambda b: (b.at.path, b.at.named)
    weight = lambda e: 0.0 if e.never else (NAMED_WEIGHT if e.named else 1.0) * (CONTENT_WEIGHT if e.content else 1.0)
    sums: dict[tuple, list[float]] = {}
    weights: dict[tuple, float] = {}
    for b in found:
        s = sums.setdefault(key(b), [0, 0, 0, 0])
        for i, v in enumerate((1, len(b.text), b.marks, b.links)):
            s[i] += v
        weights[key(b)] = max(weights.get(key(b), 0.0), weight(b.at))
    smooth = [_smooth([sums[key(b)][i] / sums[key(b)][0] if not b.at.never else 0.0 for b in found]) for i in (1, 2)]
    means: dict[tuple, list[float]] = {}
    for b, t, p in zip(found, *smooth, strict=True):
        m = means.setdefault(key(b), [0.0, 0.0])
        m[0] += t / sums[key(b)][0]
        m[1] += p / sums[key(b)][0]
    fused = {k: weights[k] * math.log1p(t) * (0.3 + math.log1p(p)) * max(0.0, 1 - sums[k][3] / sums[k][1]) ** 2 for k, (t, p) in means.items()}
    most = max(fused.values(), default=0.0)
    chosen = {k for k, v in fused.items() if v >= least_share * most and v > 0}
    core = [b for b in found if key(b) in chosen]
    if not core:
        return []
    for b in core:
        b.at.held += len(b.text)
    for e in reversed(elements[1:]):
        e.parent.held += e.held
    need = 0.8 * elements[0].held
    article = max((e for e in elements if e.held >= need), key=lambda e: e.depth)  # these are one within the other
    if article.tag in ("p", "li", "td", "h1", "h2", "h3") and article.parent is not None:
        article = article.parent
    within = [False] * len(elements)
    for e in elements:
        within[e.number] = e is article or e.parent is not None and within[e.parent.number]
    whole = article.tag in ("", "html", "body")
    out = []
    for b in found:
        s = sums[key(b)]
        plain = not b.at.never and not (b.at.named and not article.named) and s[3] < 0.5 * s[1]
        beside = plain and within[b.at.number] and (not whole or b.at.tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
        if key(b) in chosen and (within[b.at.number] or whole) or beside:
            out.append(b)
    return out


def main_text(page: str | None, least_share: float = 0.3) -> str:
    return " ".join(b.text for b in select(*blocks(page or ""), least_share))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages."""
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    found = slim.mapInArrow(_extract, slim.select("page_id", "url", F.col("html").alias("text")).schema)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
