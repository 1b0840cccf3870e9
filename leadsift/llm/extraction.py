"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadsift.llm.common import with_results

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
#: One attribute with its value, so that no word of a value passes for a name.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw content up to the end tag; none of it is text of the page.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas title".split())
#: Never part of the article, whatever their class.
SIDE = frozenset("nav footer aside form button select dialog menu head".split())
#: Hold blocks; a leaf block's text is one block.
HOLDERS = frozenset("html body main article section div header td table tbody tr center".split())
BLOCKS = HOLDERS | SIDE | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption address th thead tfoot caption hr details summary fieldset hgroup".split())
#: Words of class, id or role that mark what is beside the article.
SIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|header|masthead|banner|footer|contentinfo|sidebar|side|aside|complementary"
    r"|ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert"
    r"|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|form|share|sharing|social|related|recommended|recommendations"
    r"|breadcrumb|breadcrumbs|pagination|pager|comment|comments|commentlist|respond|replies|disqus|widget|toolbar|copyright|hidden|tags)(?:$|[\s_-])",
    re.IGNORECASE,
)
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？—¿¡]")
#: Weights of the neighbours of a block when scores are smoothed (a Gaussian).
SMOOTH = np.exp(-0.5 * np.arange(-2, 3) ** 2)
#: A container that holds such a share of the selected text is entered.
SHARE = 0.75
#: Headings go with what they head, also when they are links.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Element:
    tag: str
    path: str
    parent: Element | None
    side: bool
    named: bool = False
    weight: float = 0.0
    children: list[Element] = field(default_factory=list)


@dataclass
class Block:
    element: Element
    text: str
    links: int


def _is_side(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is beside the article for sure, and whether its name says so (or it is a form)."""
    if (tag in SIDE and tag != "form") or (tag == "header" and not in_article):
        return True, False
    named = tag == "form"
    if not attrs.strip() or tag in ("html", "body", "main", "article"):
        return False, named
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if name in ("class", "id", "role") and SIDE_NAMES.search(re.sub(r"([a-z])([A-Z])", r"\1-\2", value)):
            named = True
    return False, named


def _settle_names(root: Element, blocks: list[Block]) -> None:
    """Mark what lies below side names and forms, but not those that wrap the page.

    One that holds over half of the page's unlinked text counts as a wrapper if the article, main
    or h1 element is in it, or if it holds `SHARE` of the text and none of these is elsewhere.
    """
    text, heads = defaultdict(int), defaultdict(int)
    for b in blocks:
        e = b.element
        while e is not None and not b.element.side:
            text[id(e)] += max(0, len(b.text) - b.links)
            e = e.parent
    order = [root]
    for e in order:
        order += e.children
    for e in reversed(order):
        heads[id(e)] += e.tag in ("article", "main", "h1") and not e.side
        if e.parent is not None:
            heads[id(e.parent)] += heads[id(e)]
    whole = text[id(root)]
    for e in order:
        if e.parent is not None and e.parent.side:
            e.side = True
        elif e.named and not e.side:
            size = text[id(e)]
            wraps = 2 * size > whole and (heads[id(e)] > 0 or (size >= SHARE * whole and not heads[id(root)]))
            e.side = not wraps


def blocks_of(page: str) -> tuple[Element, list[Block]]:
    """The page's blocks of text in order, each with its innermost block element."""
    root = Element("", "", None, False)
    stack, blocks, text, links, anchors = [root], [], [], 0, 0

    def flush() -> None:
        nonlocal links
        if joined := " ".join("".join(text).split()):
            blocks.append(Block(stack[-1], joined, links))
        text.clear()
        links = 0

    def close(to: int) -> None:
        flush()
        del stack[to:]

    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        if (chunk := m["text"]) is not None:
            decoded = entities.unescape(chunk)
            if stack[-1].tag == "head" and not decoded.isspace():
                close(len(stack) - 1)
            text.append(decoded)
            links += len(decoded) * (anchors > 0)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in BLOCKS:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if depth:
                    close(depth)
                else:
                    flush()
        elif tag in RAW and not m["attrs"].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            if tag == "title":
                text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            anchors = min(anchors + 1, 1)
        elif tag in BLOCKS:
            anchors = 0
            flush()
            if stack[-1].tag == "p":
                close(len(stack) - 1)
            if stack[-1].tag == "head":  # its end tag may be left out
                close(len(stack) - 1)
            if tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].tag == tag:
                close(len(stack) - 1)
            if tag not in VOID:
                above = stack[-1]
                inside = any(e.tag in ("article", "main") for e in stack)
                side, named = _is_side(tag, m["attrs"], inside)
                new = Element(tag, f"{above.path}/{tag}", above, above.side or side, named)
                above.children.append(new)
                stack.append(new)
    flush()
    _settle_names(root, blocks)
    return root, blocks


def _line(e: Element | None) -> list[Element]:
    """An element and all that it lies in, innermost first."""
    line = []
    while e is not None:
        line.append(e)
        e = e.parent
    return line


def _kept(blocks: list[Block], node: Element, accepted: set[str]) -> list[Block]:
    """Blocks of the container `node` on accepted tag paths, and those that go with them.

    A block on a rejected path goes if the text of that path is mostly links, headings apart. It
    also goes if it lies before the first or after the last accepted block and its group, the
    innermost holder around it, holds neither an accepted block nor the page's h1. Short
    paragraphs, lists and headings beside accepted text or between it stay. Without any accepted
    path in the container all of it is kept.
    """
    good = [b.element.path in accepted for b in blocks]
    if not any(good):
        return blocks
    linked, text = defaultdict(int), defaultdict(int)
    groups = {id(node)}
    for b, ok in zip(blocks, good, strict=True):
        linked[b.element.path] += b.links
        text[b.element.path] += len(b.text)
        if ok or b.element.tag == "h1":
            groups |= {id(e) for e in _line(b.element)}
    first, last = good.index(True), len(good) - 1 - good[::-1].index(True)

    def belongs(i: int, b: Block) -> bool:
        path = b.element.path
        if good[i]:
            return True
        if 2 * linked[path] > text[path] and b.element.tag not in HEADINGS:
            return False
        group = next((e for e in _line(b.element) if e.tag in HOLDERS and e.tag not in ("td", "tr", "tbody")), node)
        return first < i < last or id(group) in groups

    return [b for i, b in enumerate(blocks) if belongs(i, b)]


def main_text(page: str) -> str:
    """The article of a page: blocks below the container that holds most text of selected paths.

    Length and punctuation of all text outside links are added up by tag path and divided by the
    blocks of that path; both ratios are smoothed along the page, fused by their product and held
    against a threshold. The container is the deepest one with most of the selected text (an
    article or main element is not entered further). Of its blocks, those that `_kept` finds to
    belong to the selected paths are text.
    """
    root, blocks = blocks_of(page)
    blocks = [b for b in blocks if not b.element.side]
    if not blocks:
        return ""
    totals = defaultdict(lambda: np.zeros(3))
    for b in blocks:
        totals[b.element.path] += (max(0, len(b.text) - b.links), len(PUNCTUATION.findall(b.text)), 1)
    ratios = np.array([totals[b.element.path][:2] / totals[b.element.path][2] for b in blocks])
    weights = np.convolve(np.ones(len(blocks)), SMOOTH, "full")[2 : 2 + len(blocks)]
    smooth = np.stack([np.convolve(r, SMOOTH, "full")[2 : 2 + len(blocks)] / weights for r in ratios.T])
    fused = smooth[0] * (1 + smooth[1])
    chosen = fused >= fused.std() if len(blocks) > 1 else np.ones(1, bool)
    if not chosen.any():
        chosen[:] = True
    for b, good in zip(blocks, chosen, strict=True):
        if good:
            size, e = max(0, len(b.text) - b.links), b.element
            while e is not None:
                e.weight += size
                e = e.parent
    node = root
    while node.tag not in ("article", "main"):
        best = max((c for c in node.children if c.tag in HOLDERS and c.tag != "section" and not c.side), key=lambda c: c.weight, default=None)
        if best is None or best.weight <= 0 or best.weight < SHARE * root.weight:
            break
        node = best

    inside = [b for b in blocks if node in _line(b.element)]
    threshold = fused.std() if len(blocks) > 1 else 0.0
    accepted = {path for path, (size, marks, n) in totals.items() if size / n * (1 + marks / n) >= threshold}
    return " ".join(b.text for b in _kept(inside, node, accepted))


def extracted(pages: DataFrame, html: str = "html", keep_html: bool = False) -> DataFrame:
    """`pages` with `text` and `n_chars` (code points) of the main text of each whole page.

    Null and empty pages give an empty text; broken markup is read as far as it goes, plain text
    is its own article; repeated rows give equal results; an empty table gives an empty result;
    an input column named `text` or `n_chars` is replaced.
    """
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def fn(values: list[str]) -> list[list]:
        texts = [main_text(v) for v in values]
        return [texts, [len(t) for t in texts]]

    return with_results(pages, html, fields, fn, drop_text=not keep_html)
