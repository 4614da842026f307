"""Labelled pages to train the field on: made by rule from a seed, each block of a page with its label."""

from __future__ import annotations

import random

from .html_blocks import Block, leaf_blocks, title_of

_SYLLABLES = "ka lo mi ren tas vor eil dun pra sel ti mo gar es in on ber lu fa che der un ly st er an".split()
_MARK = "\ue000"  # starts every block of main text, so that labels can be read off the parsed page


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b))).capitalize()

    def sentence(self, a: int = 4, b: int = 18) -> str:
        return self.words(a, b) + self.r.choice("....?!")

    def prose(self) -> str:
        odd = self.r.random()
        if odd < 0.04:
            return " | ".join(self.word() for _ in range(self.r.randint(3, 60)))
        if odd < 0.08:
            return " ".join(f"{self.word()}{self.r.choice('#*$%&!')}" for _ in range(self.r.randint(3, 60))).replace("&", "&amp;")
        if odd < 0.16:
            return self.words(1, self.r.choice((2, 4, 30)))
        text = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 9))))
        if self.r.random() < 0.25:
            text += f' <a href="/{self.word()}">{self.words(1, 3)}</a> {self.sentence()}'
        return text

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 4)}</a>'

    def links(self) -> str:
        n = self.r.randint(2, 9)
        return self.r.choice((
            lambda: "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>",
            lambda: " | ".join(self.link() for _ in range(n)),
            lambda: "".join(f"<div>{self.link()}</div>" for _ in range(n)),
            lambda: " ".join(self.link() for _ in range(n)),
        ))()

    def named(self, tag: str, names: tuple[str, ...], body: str, plain: float = 0.1) -> str:
        if self.r.random() < plain:
            return f"<{tag}>{body}</{tag}>"
        name = self.r.choice(names)
        if self.r.random() < 0.3:
            name += self.r.choice(("-wrap", " clearfix", "-box", "_1", "-inner"))
        return f'<{tag} {self.r.choice(("class", "class", "id"))}="{name}">{body}</{tag}>'

    def paragraphs(self, a: int, b: int) -> str:
        return "".join(f"<p>{self.prose()}</p>" for _ in range(self.r.randint(a, b)))

    def clutter(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return f"<nav>{self.links()}</nav>" if r.random() < 0.5 else self.named("div", ("nav", "menu", "main-menu", "navbar", "breadcrumbs", "top-nav"), self.links())
        if kind == "header":
            body = r.choice((self.words(1, 3), f"<h1>{self.words(1, 3)}</h1><p>{self.sentence(3, 8)}</p>", f"<p>{self.link()}</p>" + self.links(), f"<div>{self.words(1, 3)}</div>"))
            return f"<header>{body}</header>" if r.random() < 0.6 else self.named("div", ("header", "site-header", "masthead", "topbar", "branding"), body, 0)
        if kind == "footer":
            body = r.choice((f"&copy; {self.word()}.example &middot; {self.sentence()}", f"<p>Copyright 2020 {self.words(2, 5)}</p>" + self.links(), f"<p>{self.sentence()}</p>", self.links() + f"<div>&copy; {self.words(2, 6)}</div>"))
            return f"<footer>{body}</footer>" if r.random() < 0.7 else self.named("div", ("footer", "site-footer", "copyright", "colophon"), body, 0)
        if kind == "side":
            body = f"<h3>{self.words(1, 3)}</h3>" * r.randint(0, 1) + r.choice((self.links, lambda: self.paragraphs(1, 3), lambda: f"<p>{self.sentence()}</p>{self.links()}"))()
            return f"<aside>{body}</aside>" if r.random() < 0.5 else self.named("div", ("sidebar", "side-bar", "widget", "right-rail"), body, 0)
        if kind == "ad":
            body = r.choice((self.sentence(), self.words(2, 6), f"<p>{self.prose()}</p>", f"{self.link()} {self.sentence()}"))
            return self.named(r.choice(("div", "div", "section", "aside")), ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner", "ad-banner"), body, 0)
        if kind == "notice":
            body = r.choice((self.sentence(), f"<p>{self.prose()}</p>", f"{self.sentence()} <button>OK</button>", f"<p>{self.sentence()}</p><button>{self.words(1, 2)}</button>"))
            return self.named(r.choice(("div", "div", "section", "aside")), ("cookie", "cookie-notice", "notice", "consent", "gdpr-banner", "popup", "modal", "alert"), body, 0)
        if kind == "comments":
            one = lambda: r.choice((f"<p>{self.prose()}</p>", f'<div class="{r.choice(("comment", "reply", "c"))}"><b>{self.word()}</b><p>{self.prose()}</p></div>', f"<li>{self.prose()}</li>"))
            body = f"<h{r.randint(2, 4)}>{self.words(1, 3)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6)))
            return self.named(r.choice(("div", "section", "section", "ol")), ("comments", "comment-list", "user-comments", "responses", "discussion", "disqus_thread"), body, 0)
        if kind == "form":
            body = f"<label>{self.words(1, 3)}</label><input type=text><button>{self.words(1, 2)}</button>" + f"<p>{self.sentence()}</p>" * r.randint(0, 1)
            return f"<form>{body}</form>" if r.random() < 0.7 else self.named("div", ("newsletter", "subscribe", "login-form", "search"), f"<form>{body}</form>", 0)
        if kind == "share":
            return self.named("div", ("share", "social", "tags", "post-meta", "byline"), r.choice((self.links(), self.words(1, 4))), 0)
        return self.named(r.choice(("div", "section")), ("related", "recommended", "more-stories", "popular"), f"<h3>{self.words(1, 3)}</h3>" + self.links(), 0)

    def body_part(self) -> str:
        r, m = self.r, _MARK
        kind = r.random()
        if kind < 0.62:
            return f"<p>{m}{self.prose()}</p>" if r.random() < 0.85 else f"<p>{m}<b>{self.prose()}<br>"
        if kind < 0.74:
            return f"<h{r.choice((2, 2, 3, 4))}>{m}{self.words(1, 7)}</h2>"
        if kind < 0.82:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{m}{r.choice((self.sentence(2, 12), self.words(1, 5)))}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.87:
            return f"<blockquote>{m}{self.prose()}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{m}{self.prose()}</p></blockquote>"
        if kind < 0.91:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.words(1, 4)}</td>" for _ in range(r.randint(2, 4))) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.94:
            return f"<pre>{m}{self.words(3, 20)}</pre>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{m}{self.sentence()}</figcaption></figure>"
        return f"<div>{m}{self.prose()}</div>"

    def page(self) -> str:
        r = self.r
        title = self.words(3, 10)
        head = f"<h1>{_MARK}{title}</h1>"
        if r.random() < 0.3:
            head = f"<header>{head}{self.clutter('share') * r.randint(0, 1)}</header>"
        parts = [self.body_part() for _ in range(r.choice((1, 2, 4, 6, 10, 16, 40)))]
        inside = ("ad", "share", "side", "notice", "form", "related", "comments")
        for kind in r.sample(inside, r.choice((0, 0, 0, 1, 1, 2))):
            at = len(parts) if kind in ("comments", "related", "share") else r.randint(0, len(parts))
            parts.insert(at, self.clutter(kind))
        main = "\n".join([head, *parts]) if r.random() < 0.9 else "\n".join(parts)
        style = r.random()
        if style < 0.5:
            main = f"<article>{main}</article>"
        elif style < 0.65:
            main = f"<main>{main}</main>"
        elif style < 0.92:
            main = self.named("div", ("content", "post-content", "entry", "article-body", "main", "story", "post"), main, 0.2)
        if r.random() < 0.25:
            main = f"<main>{main}</main>" if r.random() < 0.5 else f'<div id="{r.choice(("page", "wrapper", "container", "content"))}">{main}</div>'
        before = [self.clutter(k) for k in r.sample(("nav", "header", "ad", "notice", "form", "side", "nav"), r.randint(0, 4))]
        after = [self.clutter(k) for k in r.sample(("comments", "side", "related", "ad", "form", "notice", "share"), r.randint(0, 4))]
        if r.random() < 0.8:
            after.append(self.clutter("footer"))
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>" + "".join(before) + main + "".join(after) + "</body></html>"


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[list[Block], str, list[int]]]:
    """n pages as blocks, title and labels (1 text, 0 clutter)."""
    out = []
    for k in range(n):
        page = _Page(seed * 100_003 + k).page()
        blocks = leaf_blocks(page)
        labels = [int(_MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(_MARK, "")
        out.append((blocks, title_of(page), labels))
    return out
