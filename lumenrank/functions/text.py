"""Tokens, stems, counts and formatters: pure Column -> Column functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V


def words(values: Iterable[str] | Column) -> Column:
    """The words as an array; an array column (of a policy table) stays as it is."""
    if isinstance(values, Column):
        return values
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once per row: a one-row generator keeps the optimizer from
    copying their expressions into every later use."""
    kept = df.drop(*columns)
    return kept.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """White space off both ends, which is all of the text that it looks at."""
    return F.btrim(text(col), F.lit(" \t\n\x0b\f\r"))


def ascii_only(col: Column) -> Column:
    return F.octet_length(text(col)) == F.length(text(col))


def alnum_runs(col: Column, said: Column | None = None) -> Column:
    """Lower-case ASCII letter-digit runs. ``said``: ``dictionary.whole_words`` of the text, where that is a column
    already; they are the same in ASCII texts without underscores."""
    runs = F.regexp_extract_all(F.lower(text(col)), F.lit("[a-z0-9]+"), F.lit(0))
    return runs if said is None else F.when(ascii_only(col) & ~F.contains(text(col), F.lit("_")), said).otherwise(runs)


def _kept(t: Column) -> Column:
    return (F.length(t) >= 3) & ~t.isin(V.STOPWORDS)


def tokens_alnum(col: Column) -> Column:
    """Lower-case ASCII letter-digit runs of three or more that aren't stopwords (repeats kept)."""
    return F.filter(alnum_runs(col), _kept)


def tokens_word(col: Column) -> Column:
    """Lower-case letter runs with at most one inner hyphen or apostrophe part (o-ring, don't)."""
    return F.transform(F.regexp_extract_all(text(col), F.lit("[a-zA-Z]+(?:[-'][a-zA-Z]+)?"), F.lit(0)), F.lower)


def tokens_lower(low: Column) -> Column:
    """``tokens_word`` of a text that is in lower case."""
    return F.regexp_extract_all(low, F.lit("[a-z]+(?:[-'][a-z]+)?"), F.lit(0))


def same_in_lower(col: Column) -> Column:
    """Whether the text has no letter outside ASCII whose lower case is, or begins with, one inside (K, \u0130)."""
    return ~F.contains(text(col), F.lit("\u212a")) & ~F.contains(text(col), F.lit("\u0130"))


def tokens_letters(col: Column) -> Column:
    """Distinct lower-case letter runs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(col)), F.lit("[a-zA-Z]+"), F.lit(0)))


def stem(token: Column) -> Column:
    """The first of -ing, -ed, -es, -s that fits taken off, where more than two letters stay."""
    low = F.lower(token)
    out = low
    for suffix in ("s", "es", "ed", "ing"):
        out = F.when(low.endswith(suffix) & (F.length(low) > len(suffix) + 2), F.substring(low, 1, F.length(low) - len(suffix))).otherwise(out)
    return out


def canonical(token: Column, synonyms: Mapping[str, str] | Column) -> Column:
    """The stem, or the word that the synonym map (of literals, or a map column) has for it."""
    base = stem(token)
    if isinstance(synonyms, Column):
        return F.coalesce(F.try_element_at(synonyms, base), base)
    if not synonyms:
        return base
    table = F.create_map(*[F.lit(x) for pair in sorted(synonyms.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, base), base)


def keyword_set(col: Column, synonyms: Mapping[str, str] | Column, expansion: Mapping[str, Iterable[str]] | None = None, said: Column | None = None) -> Column:
    """Distinct canonical tokens, each token looked at once; ``expansion`` (off by default) adds each token's related
    words. ``said``: see ``alnum_runs``."""
    base = F.array_distinct(F.transform(F.filter(F.array_distinct(alnum_runs(col, said)), _kept), lambda t: canonical(t, synonyms)))
    if not expansion:
        return base
    table = F.create_map(*[x for k, vs in sorted(expansion.items()) for x in (F.lit(k), words(sorted(vs)))])
    more = F.flatten(F.transform(base, lambda t: F.coalesce(F.try_element_at(table, t), words([]))))
    return F.array_distinct(F.concat(base, more))


def any_of(tokens: Column, values: Iterable[str] | Column) -> Column:
    if isinstance(values, Column):
        return F.arrays_overlap(tokens, values)
    values = list(values)
    return F.arrays_overlap(tokens, words(values)) if values else F.lit(False)


def contains_any(col: Column, phrases: Iterable[str]) -> Column:
    """Whether any phrase is a substring."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(col, F.lit(p))
    return out


def contained(col: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases are substrings."""
    out = F.lit(0)
    for p in phrases:
        out = out + F.contains(col, F.lit(p)).cast("int")
    return out


def word_pattern(terms: Iterable[str]) -> str:
    """A case-insensitive pattern that finds any of the terms as whole words; letters outside ASCII are
    letters here too. Longer terms first."""
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    return r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(re.escape(t).replace(r"\ ", " ") for t in ordered) + r")(?![\p{L}\p{N}_])"


def matches_any(col: Column, terms: Iterable[str]) -> Column:
    """Whole-word, case-insensitive match of any term; false without terms."""
    terms = list(terms)
    return text(col).rlike(word_pattern(terms)) if terms else F.lit(False)


def overlap_count(a: Column, b: Column, tokens: Column | None = None) -> Column:
    """Distinct shared word tokens of three letters or more that aren't stopwords. ``tokens``: ``tokens_word`` of b, where
    that is a column already."""
    keep = lambda c: F.filter(tokens_word(c), lambda t: (F.length(t) >= 3) & ~t.isin(V.OVERLAP_STOPWORDS))
    return F.size(F.array_intersect(keep(a), tokens_word(b) if tokens is None else tokens))


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def truncate(col: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(text(col), 1, n)


def trim_middle(col: Column, most: int = 800, head: int = 600, tail: int = 200) -> Column:
    """Longer texts than ``most`` as their head, a mark, and their tail."""
    t = text(col)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, head), F.lit(" [...] "), F.right(t, F.lit(tail)))).otherwise(t)


def snippet(col: Column, limit: int = 80) -> Column:
    """One line, ellipsis at the limit."""
    t = strip(F.regexp_replace(text(col), "\n", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def match_flag(matched: Column) -> Column:
    """+ for true, x for false, ? for unknown."""
    return F.when(matched, "+").when(~matched, "x").otherwise("?")


def loose_number(col: Column) -> Column:
    """A score from anything: a number, else the first lone digit 0 to 3, else minus infinity."""
    t = strip(col.cast("string"))
    digit = F.regexp_extract(t, r"\b(3|2|1|0)\b", 1)
    return F.coalesce(t.try_cast("double"), F.when(digit != "", digit.cast("double")), F.lit(float("-inf")))
