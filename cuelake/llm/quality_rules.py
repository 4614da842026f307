"""Quality rules: a learned decision list over text statistics, applied as one ordered conditional expression.

Statistics are DataFrame expressions over the whole text. Rules are grown and pruned by sequential covering on
the statistics of a bounded sample of labelled documents, and become CASE WHEN rule THEN reject ... ELSE keep.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, pick, table, words_of

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: Rules are learned from at most so many labelled rows, those with the smallest hash of doc_id.
MAX_LABELLED = 20_000
FEATURES = ("n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "shout_rate", "distinct_rate", "words_per_line")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Number of words inside any 3-word window that occurs twice or more; windows are compared by 64-bit hash."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def of(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, among))

    def among(s: Column) -> Column:
        alike = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: alike(x, j - 1) | alike(x, j + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, of))


def statistics(text: Column) -> Column:
    """A struct of counts of the whole text; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    word_counts = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"),
            _repeat_words(w).cast("long").alias("repeat"), F.size(F.array_distinct(w)).cast("long").alias("distinct"),
        ),
    )
    return F.struct(word_counts.alias("w"), line_counts.alias("l"), without(SYMBOLS).alias("symbols"), without(r"\p{Lu}").alias("upper"), without("!").alias("shout"))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) as struct column all, with struct column s of counts and struct column f of features.

    The counts come through a generator of one row each: a filter or join above can't be moved below it, where the
    optimizer would state, and compute, the counts anew for every test on them.
    """
    d = docs.select(F.struct("*").alias("all"))
    d = d.select("all", F.explode(F.array(statistics(F.col("all.text")))).alias("s"))
    n, chars = F.greatest(F.col("s.w.n"), F.lit(1)), F.greatest(F.col("s.w.chars"), F.lit(1))
    values = {
        "n_words": F.col("s.w.n").cast("double"), "word_length": F.col("s.w.chars") / n, "symbol_rate": F.col("s.symbols") / n,
        "dup_line_rate": F.col("s.l.dup") / F.greatest(F.col("s.l.n"), F.lit(1)), "repeat_rate": F.col("s.w.repeat") / n, "upper_rate": F.col("s.upper") / chars,
        "shout_rate": F.col("s.shout") / n, "distinct_rate": F.col("s.w.distinct") / n, "words_per_line": F.col("s.w.n") / F.greatest(F.col("s.l.n"), F.lit(1)),
    }
    return d.withColumn("f", F.struct(*[values[k].cast("double").alias(k) for k in FEATURES]))


def base_failed() -> Column:
    return (F.col("s.w.n") < MIN_WORDS) | (100 * F.col("s.w.repeat") > MAX_REPEAT_PERCENT * F.col("s.w.n"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        f = F.col(f"f.{self.feature}")
        return f > self.threshold if self.above else f <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction of tests and the number of its training rows; what matches one is rejected."""

    rules: list[list[Test]] = field(default_factory=list)

    def keeps(self) -> Column:
        """CASE WHEN rule THEN false ... ELSE true, over the struct f of with_statistics."""
        if not self.rules:
            return F.lit(True)
        out = F
        for rule in self.rules:
            cond = rule[0].column()
            for t in rule[1:]:
                cond = cond & t.column()
            out = out.when(cond, F.lit(False))
        return out.otherwise(F.lit(True))

    def rejects(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= _holds(rule, x)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) + "\nelse keep"


def _holds(rule: Sequence[Test], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _best_test(x: np.ndarray, bad: np.ndarray) -> tuple[float, Test | None]:
    """The threshold with the largest information gain for bad among the rows that the rule still covers."""
    p0, n0 = bad.sum(), (~bad).sum()
    if not p0 or not n0:
        return 0.0, None
    before, best = math.log2(p0 / (p0 + n0)), (0.0, None)
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        p = np.cumsum(b)
        n = np.arange(1, len(b) + 1) - p
        cut = np.flatnonzero(v[1:] > v[:-1])  # thresholds lie halfway between neighbours that differ
        for above, pc, nc in ((False, p[cut], n[cut]), (True, p0 - p[cut], n0 - n[cut])):
            if not len(cut):
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pc > 0, pc * (np.log2(pc / np.maximum(pc + nc, 1)) - before), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Test(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    return best


def _worth(rule: Sequence[Test], x: np.ndarray, bad: np.ndarray) -> float:
    hit = _holds(rule, x)
    p, n = bad[hit].sum(), (~bad)[hit].sum()
    return float((p - n) / (p + n)) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 16, max_tests: int = 4, min_precision: float = 0.9, min_cover: int = 3) -> DecisionList:
    """Sequential covering. Each rule is grown on two thirds of the rows, pruned on the rest, then its rows are removed.

    A rule is accepted, pruned or else as grown, if at least min_precision of all remaining rows that it covers are
    bad, and min_cover are.
    One class, or no rows: no rules.
    """
    out, left = DecisionList(), np.arange(len(x))
    for _ in range(max_rules):
        xs, ys = x[left], bad[left]
        if ys.sum() < min_cover:
            break
        grow = left % 3 != 2
        gx, gy, rule = xs[grow], ys[grow], []
        for _ in range(max_tests):
            _, t = _best_test(gx, gy)
            if t is None:
                break
            rule.append(t)
            hit = t.holds(gx)
            gx, gy = gx[hit], gy[hit]
        if not rule:
            break
        px, py, grown = xs[~grow], ys[~grow], rule
        while len(rule) > 1 and _worth(rule[:-1], px, py) >= _worth(rule, px, py):
            rule = rule[:-1]
        good = [x for x in (rule, grown) if ys[hit := _holds(x, xs)].sum() >= min_cover and ys[hit].mean() >= min_precision]
        if not good:
            break
        rule = good[0]
        hit = _holds(rule, xs)
        out.rules.append(rule)
        left = left[~hit]
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learns the list from quality labels (1 good, 0 bad) of documents that pass the base rules.

    Labels whose doc_id or quality is null, or whose document is missing, are left out; a document labelled
    twice counts twice.
    """
    chosen = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    chosen = chosen.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    # at most max_labelled rows of two numbers: small enough for every task
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = with_statistics(rows).where(~base_failed()).select("all.doc_id", "all.quality", "f.*").collect()
    stats = sorted(found, key=tuple)
    x = np.array([[r[k] for k in FEATURES] for r in stats], float).reshape(len(stats), len(FEATURES))
    return learn(x, np.array([r["quality"] == 0 for r in stats], bool))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, and features.

    A null or empty text has no words, fails the base rules and isn't kept. Other columns of docs are left out.
    """
    d = with_statistics(pick(docs, "doc_id", "text"))
    failed = base_failed()
    return d.select(
        F.col("all.doc_id").alias("doc_id"), F.col("s.w.n").alias("n_words"), F.col("s.w.chars").alias("word_chars"), F.col("s.symbols").alias("n_symbols"), F.col("s.l.dup").alias("n_dup_lines"),
        F.col("s.w.repeat").alias("n_repeat_words"), failed.alias("base_failed"), (~failed & rules.keeps()).alias("kept"), F.col("f").alias("features"),
    )


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    A null, empty or blank text fails the base rules and goes. Rows are judged one by one, so rows that repeat a doc_id
    and rows without one stay or go with their own text. An empty table stays empty.
    """
    d = with_statistics(docs).where(~base_failed() & rules.keeps())
    return d.select("all.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
