"""Cue text: cleaning and wrapping, bilingual lines, previews, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends of a text or line, as str.strip takes it off.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_EDGE = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def strip(text: Column) -> Column:
    """Trimming reads each end once; a pattern for the end would be tried anew at every place of a run of blanks."""
    return F.btrim(text, F.lit(BLANKS))


def _wrapped(line: Column, width: int) -> Column:
    """The lines that greedy filling makes of one line; a word longer than the width stands alone.

    A pattern takes the longest run of whole words that fits, so a line costs its length, however many words it has.
    """
    words = F.array_join(F.filter(F.split(line, _EDGE), lambda w: w != ""), " ")
    fits = "" if width < 2 else f"(?:.{{0,{width - 2}}}[^ ])?"
    return F.regexp_extract_all(words, F.lit(f"(?s)[^ ]{fits}(?= |$)|[^ ]+"), F.lit(0))


def clean_text(text: Column, width: int = 80) -> Column:
    """Lines stripped, runs of spaces made one, lines beyond the width filled anew; null and empty give "".

    Tabs inside a line stay, blank lines inside the text stay, and a line without white space never breaks.
    """
    lines = F.transform(F.split(strip(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.regexp_replace(strip(x), " +", " "))
    return F.array_join(F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > width, _wrapped(x, width)).otherwise(F.array(x)))), "\n")


def bilingual_pair(text: Column) -> Column:
    """struct<target,source>: the first two lines; a single line is both."""
    lines = F.split(strip(F.coalesce(text, F.lit(""))), "\n", -1)
    first = strip(F.get(lines, F.lit(0)))
    return F.struct(first.alias("target"), F.coalesce(strip(F.get(lines, F.lit(1))), first).alias("source"))


def has_two_lines(text: Column) -> Column:
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)) == 2


def exact_pair(text: Column) -> Column:
    """struct<first,second> of a text of exactly two lines; else the text and an empty string."""
    lines = F.split(text, "\n", -1)
    two = has_two_lines(text)
    return F.struct(F.when(two, F.get(lines, F.lit(0))).otherwise(text).alias("first"), F.when(two, F.get(lines, F.lit(1))).otherwise(F.lit("")).alias("second"))


def join_pair(target: Column, source: Column) -> Column:
    return F.concat_ws("\n", target, source)


NO_SOURCE, NO_TARGET = "[Source transcription failed]", "[Translation failed]"


def compose(target: Column, source: Column, bilingual: bool = True) -> Column:
    """Text of a cue from a translation and a transcription, either of which may be missing (null or empty); null: drop it."""
    t, s = F.when(target != "", target), F.when(source != "", source)
    if not bilingual:
        return t
    return F.when(t.isNotNull() & s.isNotNull(), join_pair(t, s)).when(t.isNotNull(), join_pair(t, F.lit(NO_SOURCE))).when(s.isNotNull(), join_pair(F.lit(NO_TARGET), s))


def preview(text: Column, pair_width: int = 45, width: int = 95) -> Column:
    """One line for a list: two lines side by side, each cut to pair_width; anything else cut to width."""
    cut = lambda x, n: F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)
    lines = F.split(text, "\n", -1)
    return F.when(has_two_lines(text), F.concat(cut(F.get(lines, F.lit(0)), pair_width), F.lit(" | "), cut(F.get(lines, F.lit(1)), pair_width))).otherwise(cut(text, width))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def base64_bytes(text: Column) -> Column:
    """Bytes of a base64 text; null if it isn't one."""
    return F.try_to_binary(text, F.lit("base64"))
