"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Features are the tags and names of a block's ancestors and figures of its text; labels are text and clutter. The
field is trained by maximum likelihood on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, utf8
from .html_blocks import BITS, Block, leaf_blocks, title_of
from .html_pages import labelled_pages

_TAGS = ("p", "h1", "h2", "h3", "li", "td", "div", "pre", "blockquote", "dd", "figcaption", "article", "section", "body", "button", "footer", "other")
_TEXT = ("bias", "words<4", "words<10", "words<25", "words>=25", "links=0", "links<.3", "links<.8", "links>=.8", "ends", "copyright", "title", "first", "last", "short_link", "long_text", "plain", "plain_long", "any_clutter", "dots")
FEATURES = (*BITS, *_TAGS, *_TEXT)
_CLUTTER = BITS["in_nav"] | BITS["in_footer"] | BITS["in_aside"] | BITS["in_form"] | BITS["hidden"] | sum(BITS[f"is_{h}"] for h in ("nav", "head", "foot", "side", "ad", "notice", "comment", "share", "related", "form"))
_GOOD = BITS["in_article"] | BITS["in_main"] | BITS["is_content"]


def features(blocks: Sequence[Block], title: str) -> np.ndarray:
    """A row of zeros and ones per block."""
    x = np.zeros((len(blocks), len(FEATURES)), np.float32)
    n_bits, n_tags = len(BITS), len(_TAGS)
    for k, b in enumerate(blocks):
        for i in range(n_bits):
            if b.bits >> i & 1:
                x[k, i] = 1
        tag = {"h4": "h3", "h5": "h3", "h6": "h3", "th": "td", "dt": "dd"}.get(b.tag, b.tag)
        x[k, n_bits + (_TAGS.index(tag) if tag in _TAGS else n_tags - 1)] = 1
        n = b.text.count(" ") + 1
        share = b.links / len(b.text)
        plain = not b.bits & (_CLUTTER | _GOOD)
        x[k, n_bits + n_tags :] = (
            1, n < 4, 4 <= n < 10, 10 <= n < 25, n >= 25, share == 0, 0 < share < 0.3, 0.3 <= share < 0.8, share >= 0.8, b.text[-1] in ".!?…:;\"”»)",
            "©" in b.text or "copyright" in b.text.lower(), bool(title) and (b.text.startswith(title) or title.startswith(b.text)), k < 3, k >= len(blocks) - 3, n < 10 and share > 0.5,
            n >= 25 and share < 0.3, plain, plain and n >= 10 and share < 0.3, bool(b.bits & _CLUTTER), "·" in b.text,
        )
    return x


class Field:
    """weights: features x 2 labels (0 clutter, 1 text); moves: 2 x 2 weights of label pairs."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels (Viterbi); ties go to clutter."""
        unary = (x @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = unary[0]
        back = []
        for u, v in unary[1:]:
            back.append((0 if a + m00 >= b + m10 else 1, 0 if a + m01 >= b + m11 else 1))
            a, b = max(a + m00, b + m10) + u, max(a + m01, b + m11) + v
        y = [0 if a >= b else 1]
        for pointer in reversed(back):
            y.append(pointer[y[-1]])
        return np.array(y[::-1], np.int8)


def train(pages: Sequence[tuple[np.ndarray, np.ndarray]], rounds: int = 160, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood with a ridge, by Adam over all pages at once; forward-backward gives the marginals."""
    n, longest, width = len(pages), max(len(y) for _, y in pages), pages[0][0].shape[1]
    x, y, on = np.zeros((n, longest, width), np.float32), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (a, b) in enumerate(pages):
        x[i, : len(b)], y[i, : len(b)], on[i, : len(b)] = a, b, True
    flat, seen = x[on], y[on]
    truth_w = flat.T @ np.eye(2, dtype=np.float32)[seen]
    pair = on[:, 1:] & on[:, :-1]
    truth_m = np.zeros((2, 2))
    np.add.at(truth_m, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    w, m = np.zeros((width, 2)), np.zeros((2, 2))
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, m)]
    for t in range(1, rounds + 1):
        u = np.zeros((n, longest, 2))
        u[on] = flat @ w
        fwd, bwd = np.zeros_like(u), np.zeros_like(u)
        fwd[:, 0] = u[:, 0]
        for k in range(1, longest):
            step = np.logaddexp(fwd[:, k - 1, 0, None] + m[0], fwd[:, k - 1, 1, None] + m[1]) + u[:, k]
            fwd[:, k] = np.where(on[:, k, None], step, fwd[:, k - 1])
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        for k in range(longest - 2, -1, -1):
            ahead = u[:, k + 1] + bwd[:, k + 1]
            step = np.logaddexp(m[:, 0] + ahead[:, 0, None], m[:, 1] + ahead[:, 1, None])
            bwd[:, k] = np.where(on[:, k + 1, None], step, bwd[:, k])
        p = np.exp(fwd + bwd - total[:, None, None])[on]
        joint = np.exp(fwd[:, :-1, :, None] + m + (u + bwd)[:, 1:, None, :] - total[:, None, None, None])
        grads = (flat.T @ p - truth_w) / n + ridge * w, (joint[pair].sum(0) - truth_m) / n + ridge * m
        for v, g, (g1, g2) in zip((w, m), grads, state):
            g1 += 0.1 * (g - g1)
            g2 += 0.01 * (g * g - g2)
            v -= rate * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-8)
    return Field(w, m)


@functools.cache
def default_field() -> Field:
    return train([(features(b, t), np.array(y)) for b, t, y in labelled_pages()])


def main_text(page: str | None, field: Field) -> str:
    """The blocks labelled as text, in page order, joined by line ends; empty for a page without any."""
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, y in zip(blocks, field.decode(features(blocks, title_of(page)))) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row of pages.

    A null or empty html gives an empty text, whatever the page_id; rows that repeat a page_id are extracted one
    by one. Bytes that are no UTF-8 count as U+FFFD. Other columns are left out. An empty table gives an empty result.
    """
    field = field or default_field()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(None if h is None else bytes(h).decode("utf-8", "replace"), field) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pick(pages, "page_id", "url", "html").withColumn("html", utf8(F.col("html"))).mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
