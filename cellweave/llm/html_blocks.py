"""Leaf blocks of HTML pages: runs of text between the edges of block elements, with their open elements."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: elements without content
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no text of the page
UNSEEN = frozenset("script style template noscript iframe object svg math title textarea canvas audio video noframes".split())
#: of these the content is read up to the end tag, whatever it holds
RAW = frozenset("script style title textarea noscript noframes iframe".split())
#: elements that end a block where they begin and end
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
#: which open elements a start tag ends, and where the search for them stops
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"optgroup"}, {"select"}),
}
#: start tags that leave an open paragraph open
WITHIN_P = frozenset({"label", "button", "select", "option", "optgroup"})
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
KEPT = ("class", "id", "role", "itemprop")


class Element(NamedTuple):
    tag: str
    #: lower-case words of class, id and role
    words: tuple[str, ...]
    marked: bool


class Block(NamedTuple):
    text: str
    path: tuple[Element, ...]
    #: characters inside links
    linked: int


def _element(tag: str, attributes: str) -> Element:
    if not attributes.strip():
        return Element(tag, (), False)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    words = tuple(w.lower() for name in KEPT for w in _WORD.findall(html.unescape(found.get(name, ""))))
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        words += ("hidden",)
    return Element(tag, words, "data-main" in found)


def blocks(page: str | None) -> tuple[list[Block], str]:
    """The page's leaf blocks in order, and its title. White space of any kind inside a block becomes one space."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[tuple[str, bool]] = []
    at_text: tuple[Element, ...] = ()
    title, unseen, links = "", 0, 0
    page = page or ""

    def flush() -> None:
        if parts:
            text = " ".join("".join(x for x, _ in parts).split())
            if text:
                out.append(Block(text, at_text, sum(len("".join(x.split())) for x, linked in parts if linked)))
            parts.clear()

    def pop(n: int) -> None:
        nonlocal unseen, links
        for e in stack[n:]:
            unseen -= e.tag in UNSEEN
            links -= e.tag == "a"
        if any(e.tag in BLOCK for e in stack[n:]):
            flush()
        del stack[n:]

    def text(x: str) -> None:
        nonlocal at_text
        if x and not unseen:
            x = html.unescape(x)
            if x.strip() and not any(y.strip() for y, _ in parts):
                at_text = tuple(stack)
            parts.append((x, links > 0))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if k is not None:
                pop(k)
            elif tag in BLOCK or tag == "br":
                flush() if tag in BLOCK else text(" ")
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            if tag not in WITHIN_P:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p"), None)
                if k is not None:
                    pop(k)
            if tag in ENDS:
                which, stop = ENDS[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in stop:
                        break
                    if stack[i].tag in which:
                        pop(i)
                        break
            flush()
        if tag in VOID or attributes.endswith("/") and tag in UNSEEN:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag == "title" and not title:
                title = " ".join(html.unescape(page[at : close.start() if close else end]).split())
            at = close.end() if close else end
            continue
        stack.append(_element(tag, attributes))
        unseen += tag in UNSEEN
        links += tag == "a"
    flush()
    return out, title
