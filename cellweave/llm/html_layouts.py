"""Labelled pages to learn from: texts of real pages set again in layouts whose main blocks are known.

A page that names its article by a semantic element is labelled by that alone. Its texts are also set in layouts
of other makes: with and without semantic elements, with class names that sites use or with none that mean
anything, with menus, notices, adverts, sidebars, forms, related links and reader comments around and inside the
article. Main blocks carry the attribute ``data-main``, which no feature reads.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

from cellweave.llm.html_blocks import Block, blocks

#: fixed values: names that sites give to parts of a page, by part
NAMES = {
    "main": ["article", "content", "post", "entry", "entry-content", "post-body", "story", "main", "main-content", "article-body", "text", "page-content", "post-content"],
    "header": ["header", "masthead", "site-header", "top-bar", "page-header", "branding", "topbar"],
    "menu": ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumbs", "breadcrumb", "tabs", "pagination", "toc"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner-ad", "sponsored", "promo", "ad-slot", "adsbox", "sponsor", "adsbygoogle", "promotion"],
    "notice": ["cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "banner", "privacy-notice", "cookies", "paywall", "popup", "modal", "announcement"],
    "side": ["sidebar", "side", "widget", "right-col", "rail", "aside", "secondary", "widget-area", "most-read"],
    "form": ["newsletter", "subscribe", "signup", "login", "search", "search-form", "contact-form", "subscription"],
    "comments": ["comments", "comment", "comment-list", "comment-body", "replies", "responses", "discussion", "disqus-thread", "reader-comments", "respond", "comment-text"],
    "more": ["related", "share", "social", "share-buttons", "tags", "recommended", "read-more", "author-box", "more-stories", "see-also"],
    "footer": ["footer", "site-footer", "colophon", "copyright", "bottom", "legal", "page-footer"],
}
#: fixed values: the elements that HTML has for a part
ELEMENTS = {"main": ["article", "main"], "header": ["header"], "menu": ["nav"], "side": ["aside"], "form": ["form"], "footer": ["footer"], "ad": ["aside", "ins"], "more": ["aside"], "comments": ["section"], "notice": ["dialog", "section"]}
#: fixed values: what such parts often say
SAYS = {
    "notice": ["We use cookies to improve your experience on this site.", "By continuing you accept our privacy policy.", "This site uses cookies. Read our policy.", "Please enable JavaScript.", "Accept all", "Reject", "You have 2 free articles left this month."],
    "form": ["Subscribe to our newsletter", "Your email address", "Sign up", "Search", "Log in", "Password", "Remember me", "Send", "Name", "Message"],
    "comments": ["Comments", "3 comments", "Reply", "Leave a comment", "Report", "Posted by guest on 3 May", "anna says:", "Like"],
    "more": ["Share this", "Related articles", "Read more", "Tweet", "Tags:", "Follow us", "You may also like"],
    "side": ["Most read", "Recent posts", "Archive", "Categories", "About us", "Weather", "Latest news"],
    "footer": ["© 2024 All rights reserved.", "Terms of use", "Privacy", "Imprint", "Contact", "Copyright by the authors.", "Powered by"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer: 50 % off", "Anzeige", "Ad"],
    "header": ["Home", "The Daily Page", "News for everyone", "Log in", "Menu", "Skip to content"], "menu": ["Home", "News", "Sport", "About", "Contact", "Next", "Previous"],
}
_FILL = "river stone light market number people water story garden after between small across winter paper morning village under given several answer measure bridge often carry".split()


def _prose(r: random.Random) -> str:
    return " ".join(" ".join(r.choices(_FILL, k=r.randrange(5, 16))).capitalize() + "." for _ in range(r.randrange(1, 5)))


class Layout:
    """One way to set pages: which parts there are, how they are named and where they stand."""

    def __init__(self, r: random.Random, prose: list[str]):
        self.r, self.prose = r, prose
        #: semantic elements, telling names, or neither for boilerplate that its text and place give away
        self.style = r.choices(["semantic", "named", "both", "bare"], [3, 4, 3, 1])[0]

    def open(self, part: str) -> tuple[str, str]:
        r = self.r
        tag = r.choice(ELEMENTS[part]) if part in ELEMENTS and self.style in ("semantic", "both") else r.choice(["div", "div", "section", "td" if part in ("side", "main") else "div"])
        name = "" if self.style == "bare" or self.style == "semantic" and part in ("main", "header", "menu", "side", "form", "footer") else r.choice(NAMES[part])
        if part in ("ad", "comments", "notice", "more") and not name:
            name = r.choice(NAMES[part])  # without a name nothing tells them from the article
        if self.style == "bare" and r.random() < 0.5 and not name:
            name = "c" + "".join(r.choices("bcdfghklmn", k=4))
        attribute = f' {r.choice(["class", "class", "id"])}="{name}{r.choice(["", "", " box", " col-3", " wrap"])}"' if name else ""
        return f"<{tag}{attribute}>", f"</{tag}>"

    def say(self, part: str, often: float = 0.6) -> str:
        said = SAYS.get(part)
        return html.escape(self.r.choice(said) if said and self.r.random() < often else self.r.choice(self.prose))

    def links(self, part: str) -> str:
        r = self.r
        items = [f'<a href="/{k}">{html.escape(" ".join(r.choice(self.prose).split()[: r.randrange(1, 9)]))}</a>' for k in range(r.randrange(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else r.choice([" | ", " ", " &middot; "]).join(items)

    def part(self, part: str) -> str:
        r = self.r
        a, b = self.open(part)
        if part == "menu":
            body = self.links(part)
        elif part in ("side", "more"):
            body = (f"<h3>{self.say(part, 0.9)}</h3>" if r.random() < 0.7 else "") + (self.links(part) if r.random() < 0.7 else "".join(f"<p>{self.say(part, 0.3)}</p>" for _ in range(r.randrange(1, 4))))
        elif part == "form":
            body = f"<label>{self.say(part, 1)}</label><input name=q><button>{self.say(part, 1)}</button>" + (f"<p>{self.say(part, 0.5)}</p>" if r.random() < 0.5 else "") + ("<select><option>A<option>B</select>" if r.random() < 0.2 else "")
            if not a.startswith("<form"):
                a, b = a + "<form action=/s>", "</form>" + b
        elif part == "comments":
            one, end = r.choice([("<div class=comment>", "</div>"), ("<li>", "</li>"), ('<div class="comment-body">', "</div>"), ("<article>", "</article>"), ("", "")])
            body = (f"<h3>{self.say(part, 1)}</h3>" if r.random() < 0.7 else "") + "".join(f"{one}{f'<span>{self.say(part, 1)}</span>' if r.random() < 0.5 else ''}<p>{self.say(part, 0.1)}</p>{end}" for _ in range(r.randrange(1, 6)))
        elif part == "footer":
            body = self.say(part, 0.7) + (self.links(part) if r.random() < 0.5 else "") + (f"<p>{self.say(part, 0.5)}</p>" if r.random() < 0.4 else "")
        elif part == "header":
            body = r.choice([f"<h1>{self.say(part, 1)}</h1>", f"<a href=/>{self.say(part, 1)}</a>", f"<p>{self.say(part, 0.8)}</p>", f"<div>{self.say(part, 0.8)}</div>"]) + (self.part("menu") if r.random() < 0.4 else "") + (self.part("form") if r.random() < 0.2 else "")
        else:
            body = "".join(r.choice([f"<p>{x}</p>", f"{x}<br>", f"<div>{x}</div>", f"<p>{x} <a href=/x>{self.say(part, 1)}</a></p>"]) for x in [self.say(part) for _ in range(r.randrange(1, 3))])
        return a + body + b

    def main(self, texts: list[str]) -> str:
        """The article's blocks, with an advert, a notice or related links between some of them."""
        r, out = self.r, []
        for k, text in enumerate(texts):
            x = html.escape(text, quote=False)
            words = x.split(" ")
            if r.random() < 0.15 and len(words) > 4:
                at = r.randrange(len(words) - 2)
                x = " ".join([*words[:at], f"<a href=/l>{words[at]} {words[at + 1]}</a>", *words[at + 2 :]])
            elif r.random() < 0.15:
                x = f"<b>{x}<br>"
            kind = "h1" if k == 0 and r.random() < 0.8 else r.choices(["p", "p-open", "h2", "li", "blockquote", "td", "pre", "div", "dd", "figcaption"], [60, 8, 5, 6, 4, 3, 2, 4, 1, 1])[0]
            m = " data-main"
            out.append({"p-open": f"<p{m}>{x}", "li": f"<ul><li{m}>{x}</ul>", "td": f"<table><tr><td{m}>{x}</table>", "dd": f"<dl><dd{m}>{x}</dl>", "figcaption": f"<figure><img src=i.png><figcaption{m}>{x}</figcaption></figure>"}.get(kind) or f"<{kind}{m}>{x}</{kind}>")
            if kind == "h1" and r.random() < 0.25:
                out[-1] = f"<header>{out[-1]}</header>"
            if k and r.random() < 0.06:
                out.append(self.part(r.choice(["ad", "ad", "more", "form", "side", "notice"])))
        return "".join(out)

    def page(self, texts: list[str]) -> str:
        r = self.r
        before = [p for p, often in (("notice", 0.4), ("header", 0.6), ("menu", 0.7), ("ad", 0.4), ("side", 0.2), ("form", 0.15), ("notice", 0.2)) if r.random() < often]
        after = [p for p, often in (("ad", 0.3), ("more", 0.4), ("comments", 0.5), ("form", 0.3), ("side", 0.4), ("menu", 0.1), ("footer", 0.85), ("notice", 0.2)) if r.random() < often]
        if r.random() < 0.15:
            before, after = before[:1] * (r.random() < 0.3), after[-1:] * (r.random() < 0.3)  # little but the article
        if r.random() < 0.3:
            r.shuffle(before)
        a, b = self.open("main")
        inside = [p for p in after if p in ("comments", "more", "form", "ad") and r.random() < 0.3]
        body = a + self.main(texts) + "".join(map(self.part, inside)) + b
        for _ in range(r.randrange(0, 3)):
            name = r.choice(["", ' class="wrap"', ' class="container"', ' id="page"', ' class="row"'])
            body = f"<div{name}>{body}</div>"
        title = html.escape(texts[0][: r.randrange(20, 80)]) if texts else ""
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>t('</p>')</script></head><body>" + "".join(map(self.part, before)) + body + "".join(self.part(p) for p in after if p not in inside) + "</body></html>"


#: inside an article these are no part of it
_APART = {"nav", "aside", "footer", "form", "button", "dialog"}


def by_article(page: str) -> list[tuple[Block, bool]] | None:
    """The labels that a page's single article gives, if it has one that doesn't hold all of the page."""
    held, _ = blocks(page)
    if len({id(e) for b in held for e in b.path if e.tag in ("article", "main")}) != 1:
        return None
    labelled = [(b, any(e.tag in ("article", "main") for e in b.path) and not any(e.tag in _APART for e in b.path)) for b in held]
    kinds = {y for _, y in labelled}
    return labelled if len(kinds) == 2 else None


def marked(page: str) -> list[tuple[Block, bool]]:
    return [(b, any(e.marked for e in b.path)) for b in blocks(page)[0]]


def labelled(pages: list[str], layouts: int, seed: int = 13, most: int = 60) -> Iterator[tuple[list[tuple[Block, bool]], str]]:
    """Labelled blocks and titles of the pages themselves, and of their texts in ``layouts`` layouts each, of at most so many main blocks."""
    r = random.Random(seed)
    known = [(p, y) for p in pages if (y := by_article(p))]
    prose = [b.text for _, y in known for b, main in y if len(b.text) < 600] or [_prose(r) for _ in range(200)]
    texts = [[b.text for b, main in y if main][:most] for _, y in known] or [[_prose(r) for _ in range(r.randrange(1, 9))] for _ in range(100)]
    for p, y in known:
        yield y, blocks(p)[1]
    for own in texts:
        for _ in range(layouts):
            # texts of any length: some pages lose blocks, some blocks are cut to a line
            cut = [x if r.random() < 0.85 else " ".join(x.split()[: r.randrange(1, 8)]) for x in own if r.random() < 0.8] or own[:1]
            if r.random() < 0.1:
                cut = cut[: r.randrange(1, 3)]
            page = Layout(r, prose).page(cut)
            yield marked(page), blocks(page)[1]
