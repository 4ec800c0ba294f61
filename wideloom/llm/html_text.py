"""Main text of web pages by two-pass block rules.

A page is cut at block elements.  First pass: blocks inside menus, footers, forms, adverts, notices, reader
comments and the like are bad; of the others, a block of mostly links is bad, a long one with enough stop
words is good, one with neither is undecided.  Second pass: undecided blocks take the label of the nearest
decided neighbours before and after within the same part of the page, of the nearer one if they differ; a
heading takes the label of what follows it.
If the page marks its article (``article``, ``main`` or the matching role), that is a part of its own, and
what lies outside of it is bad.  A part without a good block, such as a page in another language, in a script
without blanks or of short blocks, keeps its undecided blocks: the bad ones say nothing about them.

Kept blocks are joined in page order: references decoded, white space turned into single spaces, trimmed.
Null, empty and cut-off pages are read as far as they go (an open script, style or comment ends the page);
no text gives the empty string.  Repeated rows are extracted alike.  Only id, url and html are read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wideloom.llm.common import map_rows

LONG_WORDS = 10
STOP_SHARE = 0.15
LINK_SHARE = 0.5

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be but by for from had has have he his i in is it not of on or that the their this to was were which with you
als am auch auf aus bei das dem den der des die ein eine einen einer er es für im ist mit nicht sich sie sind und von war zu zum
au aux avec ce dans de des du elle en est et il la le les leur mais ne nous ou par pas pour que qui se son sont sur un une
al como con de del el en era es esta la las lo los más no o para pero por que se sin su sus un una y
""".split())
# Elements without readable text; of these the first four may hold anything up to their end tag.
SILENT = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title")
BOILER = frozenset("nav footer aside form button select textarea fieldset dialog menu label option".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NAMED = re.compile(r"""(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|popup|modal|alert|newsletter|subscribe
|signup|nav(?:bar|igation)?|menu|breadcrumbs?|side-?bar|footer|site-?header|page-?header|masthead|topbar|comments?|respond|disqus|replies|share|sharing|social|related|recommended
|pagination|pager|skip|login|search|widget|toolbar)(?:$|[\s_-]|\d)""".replace("\n", ""), re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</\Z|<\Z""", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "linked", "boiler", "article", "heading")

    def __init__(self, text: str, linked: int, boiler: bool, article: bool, heading: bool):
        self.text, self.linked, self.boiler, self.article, self.heading = text, linked, boiler, article, heading


def _traits(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate and whether it is the article."""
    values: dict[str, str] = {}
    if attributes and attributes.strip():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            values[name.lower()] = a or b or c
    role = values.get("role", "").lower()
    named = f"{values.get('class', '')} {values.get('id', '')}".strip()
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true"
    bad = tag in BOILER or tag == "header" and not in_article or hidden or role in ROLES or (tag not in ("html", "body", "article", "main") and bool(NAMED.search(named)))
    return bad, tag in ("article", "main") or role in ("main", "article")


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []   # open elements: name, boilerplate, article
    boiler = article = links = silent = 0
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                inside = len(SPACE.sub(" ", html.unescape("".join(linked))).strip())
                out.append(Block(text, inside, boiler > 0, article > 0, bool(stack) and stack[-1][0] in HEADINGS))
            parts.clear()
            linked.clear()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not silent:
            parts.append(page[at:m.start()])
            if links:
                linked.append(page[at:m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK or tag in SILENT:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if not m.group(2):
            bad, main = _traits(tag, m.group(4), article > 0)
            if tag in BLOCK or tag in SILENT or bad or main or tag == "a":
                if bad and tag not in BLOCK:
                    flush()
                if tag == "p" and stack and stack[-1][0] == "p":
                    _, b, a = stack.pop()
                    boiler, article = boiler - b, article - a
                stack.append((tag, bad, main))
                boiler, article = boiler + bad, article + main
                links, silent = links + (tag == "a"), silent + (tag in SILENT)
        elif any(name == tag for name, *_ in stack):
            while True:
                name, b, a = stack.pop()
                if b and name not in BLOCK:
                    flush()
                boiler, article = boiler - b, article - a
                links, silent = links - (name == "a"), silent - (name in SILENT)
                if name == tag:
                    break
    if at < len(page) and not silent:
        parts.append(page[at:])
    flush()
    return out


def first_pass(b: Block) -> bool | None:
    """True good, False bad, None undecided."""
    if b.boiler:
        return False
    if b.linked > LINK_SHARE * len(b.text):
        return None if b.article else False
    words = b.text.lower().split()
    if len(words) >= LONG_WORDS and sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) >= STOP_SHARE * len(words):
        return True
    return None


def second_pass(found: list[Block], label: list[bool | None]) -> list[bool]:
    """Undecided blocks inherit from the nearest decided ones of their part of the page."""
    marked = any(b.article and not b.boiler for b in found)
    keep = [False] * len(found)
    for part in (True, False):
        own = [i for i, b in enumerate(found) if (b.article and not b.boiler) == part]
        if marked and not part:
            continue
        if not any(label[i] for i in own):
            for i in own:
                keep[i] = label[i] is None
            continue
        before: list[tuple[int, bool] | None] = []
        last = None
        for j, i in enumerate(own):
            if label[i] is not None:
                last = (j, label[i])
            before.append(last)
        last = None
        for j in reversed(range(len(own))):
            i = own[j]
            if label[i] is not None:
                last = (j, label[i])
                keep[i] = label[i]
                continue
            near = [x for x in (before[j], last) if x]
            if found[i].heading and last:
                keep[i] = last[1]
            elif not near:
                keep[i] = part
            elif len({v for _, v in near}) == 1:
                keep[i] = near[0][1]
            else:
                gaps = [abs(p - j) for p, _ in near]
                keep[i] = near[0][1] if gaps[0] < gaps[1] else near[1][1] if gaps[1] < gaps[0] else part
    return keep


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = second_pass(found, [first_pass(b) for b in found])
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row, in Arrow batches without a shuffle."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("text"))

    def run(c):
        got = [main_text(t) for t in c["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(c["page_id"], pa.int64()), pa.array(c["url"], pa.string()), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])
    return map_rows(rows, run, "page_id bigint, url string, text string, n_chars bigint")
