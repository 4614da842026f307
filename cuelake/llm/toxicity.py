"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick over folded text.

Folding maps accents, homoglyphs of other scripts, digits and signs that stand for letters to one letter each, in
lexicon and text alike. Entries are word beginnings. An exception is a longer phrase around an entry that is found
in clean documents; the matcher takes the longest pattern at a place, so an exception silences its entry. The
weights found, also divided by the document's length, go through a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, utf8, written

#: The model is fitted on at most so many labelled rows, those with the smallest hash of doc_id.
MAX_LABELLED = 8_000
THRESHOLD = 0.7
SHORTEST, LONGEST = 4, 12
#: Risk that any of the candidates tested is an entry by chance alone, least weight (log odds), and least toxic documents.
RISK, LEAST_WEIGHT, LEAST_TOXIC = 0.05, 1.5, 3

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
_INNER = re.compile(r"(?<=\w)[@$!|]+(?=\w)")


def _folding() -> dict[int, str]:
    """By rule: compatibility forms and accents to their base letter, other ASCII signs to space, invisible marks to nothing."""
    out: dict[int, str] = {}
    ranges = [(0xC0, 0x250), (0x1E00, 0x1F00), (0x2100, 0x2150), (0x2460, 0x2500), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)]
    for low, high in ranges:
        for c in range(low, high):
            base = "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))
            if base and base.isascii():
                out[c] = "".join(SIGNS.get(x, x) for x in base)
    for c in range(128):
        if not chr(c).isalnum():
            out[c] = " "
    for k, v in HOMOGLYPHS.items():
        out[ord(k)] = SIGNS.get(v, v)
    for k, v in SIGNS.items():
        if k.isalnum():
            out[ord(k)] = v
    return out | dict.fromkeys([*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


_FOLD = _folding()
_SIGNS = str.maketrans({k: v for k, v in SIGNS.items() if not k.isalnum()})


def fold(text: str | None) -> str:
    """Words of folded lower-case letters, each after one or more spaces."""
    t = _INNER.sub(lambda m: m[0].translate(_SIGNS), (text or "").lower())
    return f" {t.translate(_FOLD)} "


def plain(text: str | bytes | None) -> str | None:
    """A text from its bytes; what is no UTF-8 counts as U+FFFD."""
    return bytes(text).decode("utf-8", "replace") if isinstance(text, bytes | bytearray) else text


def _counted(entries: tuple[str, ...]):
    """The matcher of these patterns, each with its number."""
    a = ahocorasick.Automaton()
    for k, e in enumerate(entries):
        a.add_word(e, (k, len(e)))
    a.make_automaton()
    return a


@dataclass(frozen=True)
class Lexicon:
    """Patterns (each begins with a space) and their weights, 0 for exceptions; and the logistic curve's parameters."""

    patterns: tuple[str, ...]
    weights: tuple[float, ...]
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def score(self, found: float, n_words: int) -> float:
        z = sum(b * x for b, x in zip(self.curve, _features(found, n_words)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def scorer(self):
        matcher = _counted(self.patterns) if self.patterns else None

        def score(text: str | bytes | None) -> float:
            t = fold(plain(text))
            found = sum(self.weights[k] for _, (k, _) in matcher.iter_long(t)) if matcher else 0.0
            return self.score(found, len(t.split()))

        return score


def _features(found: float, n_words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(found), 100 * found / (n_words + 25)


def _prefix_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: dict[str, list[int]] = {}
        for text, label in zip(pdf["text"], pdf["label"]):
            words = set(fold(plain(text)).split())
            seen = {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w for w in words if len(w) == 3}
            for s in seen:
                counts.setdefault(s, [0, 0])[label] += 1
        if counts:
            yield pd.DataFrame({"entry": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]})


def _phrase_counts(entries: tuple[str, ...]):
    """For each document, what stands around its matches: the whole word, and it with a neighbour."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _counted(entries)
        for pdf in batches:
            out: dict[str, list[int]] = {}
            for text, label in zip(pdf["text"], pdf["label"]):
                words = fold(plain(text)).split()
                seen = set()
                for k, w in enumerate(words):
                    hits = list(matcher.iter_long(f" {w}"))
                    if hits:
                        seen.add(f" {w} ")
                        seen.update(f" {a} {b} " for a, b in zip(words[max(0, k - 1) : k + 1], words[max(0, k - 1) + 1 : k + 2]))
                for s in seen:
                    out.setdefault(s, [0, 0])[label] += 1
            if out:
                yield pd.DataFrame({"entry": list(out), "clean": [c[0] for c in out.values()], "toxic": [c[1] for c in out.values()]})

    return run


def _match_counts(entries: tuple[str, ...], weights: tuple[float, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _counted(entries)
        for pdf in batches:
            texts = [fold(plain(t)) for t in pdf["text"]]
            found = [sum(weights[k] for _, (k, _) in matcher.iter_long(t)) for t in texts]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "found": found, "n_words": [len(t.split()) for t in texts]})

    return run


def _log_odds(clean: float, toxic: float, n_clean: int, n_toxic: int) -> float:
    return math.log((toxic + 0.25) / (n_toxic + 0.5)) - math.log((clean + 0.25) / (n_clean + 0.5))


def _surprise(clean: int, toxic: int, n_clean: int, n_toxic: int) -> float:
    """Log-likelihood ratio that the entry's documents are toxic more often than others."""
    n, out = n_clean + n_toxic, 0.0
    for got, share in ((clean, n_clean / n), (toxic, n_toxic / n)):
        if got:
            out += 2 * got * math.log(got / ((clean + toxic) * share))
    return out


def _evidence(n_clean: int, n_toxic: int) -> tuple[Column, Column]:
    """_surprise and _log_odds as columns, so that only entries with enough of both come to the driver."""
    n = n_clean + n_toxic
    part = lambda got, share: F.when(F.col(got) > 0, 2 * F.col(got) * F.log(F.col(got) / ((F.col("clean") + F.col("toxic")) * share))).otherwise(0.0)
    odds = F.log((F.col("toxic") + 0.25) / (n_toxic + 0.5)) - F.log((F.col("clean") + 0.25) / (n_clean + 0.5))
    return part("clean", n_clean / n) + part("toxic", n_toxic / n), odds


def least_evidence(tested: int, risk: float = RISK) -> float:
    """The log-likelihood ratio that one of so many candidates reaches by chance with this risk (chi-squared, one degree).

    So the bound follows the labels: few of them give few candidates, and entries that few documents prove.
    """
    return NormalDist().inv_cdf(1 - risk / max(tested, 1) / 2) ** 2


def _choose(rows: list[tuple[str, int, int]], n_clean: int, n_toxic: int, least: float) -> dict[str, float]:
    """Entries by falling evidence; what an entry already says, its own beginnings and continuations don't repeat."""
    scored = [(round(_surprise(c, t, n_clean, n_toxic), 6), len(e), e, c, t) for e, c, t in rows if t / n_toxic > c / n_clean]
    chosen: dict[str, float] = {}
    beginnings: set[str] = set()
    for g, _, e, c, t in sorted(scored, key=lambda x: (-x[0], -x[1], x[2])):
        w = _log_odds(c, t, n_clean, n_toxic)
        if g < least or w < LEAST_WEIGHT or e in beginnings or any(e[:n] in chosen for n in range(1, len(e))):
            continue
        chosen[e] = w
        beginnings.update(e[:n] for n in range(1, len(e) + 1))
    return chosen


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with halved steps."""
    b, penalty = np.zeros(x.shape[1]), np.array([0.001] + [ridge] * (x.shape[1] - 1))

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * v * v).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -60, 60)))
        grad = x.T @ (p - y) + penalty * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return tuple(b.tolist())


def held_out():
    """Whether a row's labels are never seen in training: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """Learns entries, exceptions and the curve. Labels that are held out, null or without document play no part.

    With no toxic or no clean label there are no entries, and every score is that of an empty text.
    """
    chosen = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out())
    chosen = chosen.select("doc_id", (F.col("toxic") == 1).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    # at most max_labelled rows of two numbers
    rows = written(pick(docs, "doc_id", "text").withColumn("text", utf8(F.col("text"))).join(F.broadcast(chosen), "doc_id"), "labelled")
    classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_clean, n_toxic = classes.get(0, 0), classes.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon((), ())
    counts = lambda f: rows.select("text", "label").mapInPandas(f, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # what comes to the driver has evidence in the labelled sample, so its number is bounded by that of the sample's words
    evidence, odds = _evidence(n_clean, n_toxic)
    tested = written(counts(_prefix_counts).where(F.col("toxic") >= LEAST_TOXIC), "tested")
    least = least_evidence(tested.count())
    telling = tested.where((evidence >= least - 1e-3) & (odds >= LEAST_WEIGHT - 1e-3))
    entries = _choose([(r["entry"], r["clean"], r["toxic"]) for r in telling.collect()], n_clean, n_toxic, least)
    patterns = {f" {e}": w for e, w in entries.items()}
    if not patterns:
        return Lexicon((), ())
    around = counts(_phrase_counts(tuple(patterns))).where("clean >= 3").where(F.col("clean") / n_clean > F.col("toxic") / n_toxic)
    for r in sorted(around.collect(), key=lambda r: (-r["clean"], r["entry"])):
        patterns[r["entry"].rstrip()] = 0.0
    keys, weights = tuple(patterns), tuple(patterns.values())
    seen = rows.mapInPandas(_match_counts(keys, weights), "doc_id long, label int, found double, n_words long").collect()
    seen.sort(key=tuple)
    x = np.array([_features(r["found"], r["n_words"]) for r in seen])
    return Lexicon(keys, weights, _fit_curve(x, np.array([r["label"] for r in seen], float)))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score per row of docs. Null and empty texts score as a text without matches. Other columns are left out."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = lexicon.scorer()
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    return pick(docs, "doc_id", "text").select("doc_id", F.pandas_udf(_typed(run), "double")(utf8(F.col("text"))).alias("score"))


def _typed(run):
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
