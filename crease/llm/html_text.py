"""Main text of web pages by two-pass block rules.

Pass one classifies each block on its own by link density, the density of stop words and length; short
blocks, headings and blocks that the densities say little of stay undecided. Pass two lets undecided
blocks inherit the label of their nearest decided neighbours.

Markup is one feature of a block: whether it stands in the part that the page marks as its article
(article or main), in a part marked as something else (menus, notices, adverts, comments, ...), or in
neither. A mark bounds where a block may look for neighbours - within its own part - and settles what the
rules leave open there: undecided blocks of an article without a decided one are good, of a part marked
as something else bad. Two things only the mark can tell, as the words are prose like any other: a notice
or a reader's comment is never good, and within an article neither a sparse paragraph is bad nor do links
speak for what stands beside them. Where no block of an unmarked page is good, it may be in a language
without known stop words: its long blocks are good then.

Null pages give empty text. Pages are processed whole, each on its own, in time linear in their length;
repeated rows give repeated results; other columns are not read. Ids may be of any type.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import col, pieces

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>", re.S)
#: Where quotes run to the page's end: tags without heed to them.
PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
STARTS = re.compile(r"[a-zA-Z!?/]")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)

#: Content that is never text, read up to the end tag as it stands. Without one, only SWALLOW reach to the page's end.
SWALLOW = frozenset(("script", "style", "textarea"))
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas")}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of the article.
BAD = frozenset("nav footer aside form menu select button fieldset dialog head option label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A word of a class, id or role that marks a part as something else.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promo\w*|recommend\w*|related|respond|replies|reply|search|share|sharing|sidebar|sidenav|signup|skip|social|sponsor\w*|subscribe|subscription|tags?|toolbar|topbar|widgets?|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|head)(?:$|[\s_-])", re.I)

#: Frequent words of the languages that the rules know.
STOP_WORDS = frozenset(
    """the of and to in is that it was for on are as with be by at from this or an not have had but they you which he she we his her their has were been
    le la les de des du un une et est en que qui dans pour pas sur au avec ce il elle ne se par plus son sont aux ou
    der die das und ist von den mit zu ein eine einer sich nicht auf als für im dem des auch es an werden aus bei nach wird sie er
    el los las del y en que un una es por con para no se su al lo como más pero sus le ha este""".split()
)
LONG, SHORT, STOPS, LINKS = 200, 70, 0.2, 0.35
WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("article", "bad", "heading", "linked", "parts")

    def __init__(self, bad: bool, article: bool, heading: bool):
        self.bad, self.article, self.heading, self.linked, self.parts = bad, article, heading, 0, []


def blocks(page: str) -> list[tuple[str, Block]]:
    """The page's blocks in order with their text (references decoded, white space made one space)."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, whether marked as something else, whether in an article, whether in a marked inline element
    links = 0
    open_block: Block | None = None
    heading = False
    bad = article = aside = False
    at = 0

    opened: Counter = Counter()  # how many of each tag are on the stack
    lists: list[int] = []  # where on the stack list items and lists are

    def shut(k: int) -> None:
        """Close all from place `k` of the stack on."""
        nonlocal bad, article, aside
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]
        while lists and lists[-1] >= k:
            lists.pop()
        bad, article, aside = stack[-1][1:] if stack else (False, False, False)

    def add(raw: str) -> None:
        nonlocal open_block
        if aside and not bad:  # only this part is something else, not its block
            return
        if open_block is None:
            if not raw.strip():
                return
            open_block = Block(bad, article, heading)
            out.append(open_block)
        open_block.parts.append(raw)
        if links:
            open_block.linked += len(raw.strip())

    n = len(page)
    token, last = TOKEN, page.rfind(">")
    endless: set[str] = set()  # raw elements without an end tag from here on: each is looked for once
    while at < n:
        begin, m = at, None
        while (begin := page.find("<", begin)) >= 0:
            if begin > last and not page.startswith("<!--", begin):
                begin = -1  # no tag can end any more
                break
            m = token.match(page, begin)
            if m is None and token is TOKEN and STARTS.match(page, begin + 1):
                token = PLAIN_TOKEN  # the attempt may have read to the end: not again
                m = token.match(page, begin)
            if m:
                break
            begin += 1
        if m is None:
            add(page[at:])
            break
        if begin > at:
            add(page[at:begin])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        closing = bool(m.group(1))
        if tag == "br":
            if open_block is not None:
                open_block.parts.append(" ")
            continue
        if not closing and tag in RAW:
            if not m.group(0).endswith("/>"):
                end = RAW[tag].search(page, at) if tag not in endless else None
                if end is None:
                    endless.add(tag)
                at = end.end() if end else n if tag in SWALLOW else at
            continue
        if tag in BLOCKS or tag in BAD:
            open_block = None
            if tag not in ("option",):
                links = 0
        if tag == "a":
            links = 0 if closing else 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = not closing
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                shut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
        elif tag in BLOCKS or tag in BAD or m.group(3).strip():
            mark = tag in BAD
            if tag == "header":
                mark = not article
            if not mark and (given := m.group(3)) and tag not in ("html", "body", "article", "main"):
                for name, a, b, c in ATTRIBUTE.findall(given):
                    name, value = name.lower(), a or b or c
                    if name in ("class", "id", "role"):
                        mark |= bool(HINT.search(value)) or (not article and bool(HEADER.search(value)))
                    elif name == "style":
                        mark |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                    else:
                        mark |= value.lower() != "false"
            if tag == "p":  # a paragraph ends one that is open
                k = len(stack)
                while k and stack[k - 1][0] in ("p", "b", "i", "em", "strong", "span", "u", "font"):
                    k -= 1
                shut(k)
            elif tag == "li" and lists and stack[lists[-1]][0] == "li":
                shut(lists[-1])
            if tag in BLOCKS or tag in BAD:
                bad = bad or mark
            else:
                aside = aside or mark
            article = article or tag in ("article", "main")
            if tag in ("li", "ul", "ol", "menu"):
                lists.append(len(stack))
            opened[tag] += 1
            stack.append((tag, bad, article, aside))
    done = []
    for b in out:
        text = " ".join(html.unescape("".join(b.parts)).split())
        if text:
            done.append((text, b))
    return done


def part(b: Block) -> str:
    """What the page marks a block as: `else`, `article` or, if nothing, ``."""
    return "else" if b.bad else "article" if b.article else ""


def first_pass(text: str, b: Block) -> tuple[bool | None, str]:
    """Good, bad, or undecided (None), and what decided."""
    if b.linked > LINKS * len(text) and not b.heading:
        return False, "links"
    if len(text) < SHORT or b.heading:
        return None, ""
    words = WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOPS:
        return (False, "mark") if b.bad else (True, "density")
    # without a known stop word it may be another language; an article's paragraph may be sparse
    if len(text) < LONG or not stops or b.article and not b.bad:
        return None, ""
    return (True, "density") if stops >= STOPS / 2 and not b.bad else (False, "density")


def second_pass(found: list[tuple[str, Block]], first: list[tuple[bool | None, str]]) -> list[tuple[bool, str]]:
    """Every block's label and what decided it: the first pass, a neighbour, or the mark where its part has no decided block."""
    labels = [x for x, _ in first]
    parts = [part(b) for _, b in found]
    runs, start = [], 0
    for i in range(1, len(found) + 1):
        if i == len(found) or parts[i] != parts[start]:
            runs.append((start, i))
            start = i
    reach: list[tuple[int | None, int | None]] = [(None, None)] * len(found)  # nearest decided before and after
    # unmarked blocks look over the whole page, marked ones within their run; in an article links say nothing of their neighbours
    for spans, kind in (([(0, len(found))], ""), ([r for r in runs if parts[r[0]]], None)):
        for a, z in spans:
            tells = [labels[i] is not None and not (parts[i] == "article" and first[i][1] == "links") for i in range(a, z)]
            before, last = [], None
            for i in range(a, z):
                before.append(last)
                last = i if tells[i - a] else last
            last = None
            for i in range(z - 1, a - 1, -1):
                if kind is None or not parts[i]:
                    reach[i] = before[i - a], last
                last = i if tells[i - a] else last
    out = []
    for i, (label, why) in enumerate(first):
        if label is None:
            a, z = reach[i]
            sides = [(abs(i - k), labels[k]) for k in (a, z) if k is not None]
            if found[i][1].heading and z is not None:
                label, why = labels[z], "neighbour"  # a heading belongs to what follows it
            elif sides:
                label, why = min(sides)[1], "neighbour"  # the nearer; bad of two as near
            else:
                label, why = parts[i] == "article", "mark" if parts[i] else "none"
        out.append((bool(label), why))
    return out


def decide(page: str | None) -> list[tuple[str, Block, bool, str]]:
    """Each block of the page in order: its text, the block, whether it is main text, and what decided that."""
    found = blocks(page or "")
    first = [first_pass(t, b) for t, b in found]
    if not any(x for x, _ in first) and not any(part(b) == "article" for _, b in found):  # perhaps a language without known stop words
        first = [(True, "length") if x is None and len(t) >= LONG and not b.heading and not b.bad else (x, why) for (x, why), (t, b) in zip(first, found)]
    return [(t, b, label, why) for (t, b), (label, why) in zip(found, second_pass(found, first))]


def main_text(page: str | None) -> str:
    return "\n".join(t for t, _, label, _ in decide(page) if label)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(col(page_id).alias("page_id"), col(url).cast("string").alias("url"), col(source).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
