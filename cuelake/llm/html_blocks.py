"""HTML to leaf blocks: runs of text between block-level tags, with what is known of their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg|select|noembed|noframes)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.DOTALL | re.IGNORECASE)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCK_TAGS = frozenset(
    "html body head p div section article main header footer nav aside ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 "
    "blockquote pre form fieldset legend figure figcaption address details summary hr center menu dialog button label option video audio".split()
)
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: A start tag of the key ends an open element of these tags.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCK_TAGS - {"button", "label", "option", "video", "audio", "td", "th", "tr", "html", "body", "head"}

#: Words of class, id and role that tell what an element is for; a longer word counts by its beginning.
HINTS = {
    "nav": ("nav", "menu", "breadcrumb", "pagination", "pager", "toc", "skip"),
    "head": ("header", "masthead", "topbar", "branding", "logo"),
    "foot": ("footer", "copyright", "colophon", "legal"),
    "side": ("sidebar", "aside", "widget", "rail", "complementary"),
    "ad": ("advert", "sponsor", "promo", "banner", "outbrain", "taboola", "commercial"),
    "notice": ("cookie", "notice", "consent", "gdpr", "popup", "modal", "alert", "overlay", "toast", "paywall", "disclaimer"),
    "comment": ("comment", "disqus", "respon", "repl", "discussion", "feedback", "review"),
    "share": ("share", "sharing", "social", "follow", "tag", "meta", "byline"),
    "related": ("related", "recommend", "more", "popular", "trending", "teaser", "also"),
    "form": ("form", "newsletter", "subscribe", "signup", "login", "search", "register", "contact"),
    "content": ("article", "post", "entry", "content", "main", "story", "body", "text", "prose"),
}
_EXACT = {"contentinfo": "foot", "ad": "ad", "ads": "ad", "adv": "ad", "adslot": "ad", "navigation": "nav"}
ANCESTORS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "list", "table", "figure", "blockquote", "button", "pre", "details")
_GROUP = {"ul": "list", "ol": "list", "dl": "list", "menu": "list", "figcaption": "figure", "label": "button", "option": "button", "fieldset": "form", "legend": "form", "dialog": "nav"}
BITS = {name: 1 << i for i, name in enumerate((*(f"in_{a}" for a in ANCESTORS), *(f"is_{h}" for h in HINTS), "hidden", "header_in_article", "footer_in_article", "aside_in_article"))}


@dataclass
class Block:
    text: str
    tag: str
    bits: int
    links: int  # characters inside links


def _own_bits(tag: str, attrs: str) -> int:
    bits = BITS.get(f"in_{_GROUP.get(tag, tag)}", 0)
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and value == "true":
                bits |= BITS["hidden"]
            elif name in ("class", "id", "role"):
                for word in _TOKENS.findall(value):
                    bits |= _hint(word.lower())
    return bits


def _hint(word: str) -> int:
    if word in _EXACT:
        return BITS[f"is_{_EXACT[word]}"]
    for group, words in HINTS.items():
        if word.startswith(words) and (len(word) > 2):
            return BITS[f"is_{group}"]
    return 0


def title_of(page: str) -> str:
    m = _TITLE.search(page)
    return " ".join(html.unescape(m[1]).split()) if m else ""


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks of text in order. Character references are decoded and white space becomes single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open block elements, each with the bits of all that are open around it
    n_open: Counter[str] = Counter()  # of each tag; the end of one that isn't open costs nothing
    parts: list[str] = []
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            tag, bits = stack[-1] if stack else ("body", 0)
            out.append(Block(text, tag, bits, min(links, len(text))))
        parts.clear()
        links = 0

    for m in _TOKEN.finditer(page):
        tag = m["tag"]
        if tag is None:
            token = m[0]
            if m["raw"] is None and not (token[0] == "<" and len(token) > 1):
                parts.append(token)
                if in_link:
                    links += len(token)
            continue
        tag = tag.lower()
        if tag not in BLOCK_TAGS:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if m["close"] else 1
            elif tag in ("input", "img"):
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if tag in _VOID:
            continue
        if m["close"]:
            while n_open[tag]:
                last = stack.pop()[0]
                n_open[last] -= 1
                if last == tag:
                    break
            continue
        if stack and tag in _ENDS_P and stack[-1][0] == "p":
            n_open[stack.pop()[0]] -= 1
        ends = _CLOSES.get(tag)
        while ends and stack and (stack[-1][0] in ends or stack[-1][0] == "p"):
            n_open[stack.pop()[0]] -= 1
        around = stack[-1][1] if stack else 0
        bits = around | _own_bits(tag, m["attrs"])
        if around & BITS["in_article"] and tag in ("header", "footer", "aside"):
            bits |= BITS[f"{tag}_in_article"]
        stack.append((tag, bits))
        n_open[tag] += 1
    flush()
    return out
