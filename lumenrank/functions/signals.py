"""Text-quality signals, document kinds, query intents and their fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .text import any_of, ascii_only, clamp01, computed, contained, contains_any, let, same_in_lower, strip, text, tokens_letters, tokens_lower, tokens_word


def count_in(tokens: Column, values: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(values)))


#: All words that a document's quality, kind and action score look for.
DOC_WORDS = sorted({
    *V.ACTION_VERBS, *V.PART_WORDS, *(p + "s" for p in V.PART_WORDS), *V.SCHEDULE_TOKENS, *V.KIND_REPAIR_TOKENS, *V.KIND_MAINTENANCE_TOKENS, *V.INTENT_DIAGNOSE, *V.INTENT_OVERVIEW,
})


def step_marker(low: Column) -> Column:
    """A numbered item, or any marker as a substring (of lower-case text)."""
    return contains_any(low, V.STEP_MARKERS) | low.rlike(r"(^|\s)\d+[.)]\s")


def step_bullets(col: Column) -> Column:
    return F.regexp_count(text(col), F.lit(V.STEP_BULLET))


def distinct_verbs(col: Column, said: Column | None = None) -> Column:
    """How many different procedure verbs occur as whole words. ``said``: ``dictionary.whole_words`` of the text, where that
    is a column already; ASCII texts are not searched again."""
    found = F.regexp_extract_all(text(col), F.lit(r"(?i)\b(" + "|".join(V.PROCEDURE_VERBS) + r")\b"), F.lit(1))
    searched = F.size(F.array_distinct(F.transform(found, F.lower)))
    if said is None:
        return searched
    return F.when(ascii_only(col), F.size(F.array_distinct(F.filter(said, lambda t: t.isin(list(V.PROCEDURE_VERBS)))))).otherwise(searched)


def separators(col: Column) -> Column:
    return F.regexp_count(text(col), F.lit(V.STEP_SEPARATOR))


def procedure_signal(col: Column, said: Column | None = None) -> Column:
    """4 x bullets + 2 x different verbs + separators, at most 8 of these."""
    return step_bullets(col) * 4 + distinct_verbs(col, said) * 2 + F.least(separators(col), F.lit(8))


def step_summary(col: Column) -> Column:
    """struct: bullets, verbs, step_words, water_off."""
    low = F.lower(text(col))
    return F.struct(
        step_bullets(col).alias("bullets"), distinct_verbs(col).alias("verbs"),
        low.rlike(r"\b(" + "|".join(V.STEP_WORDS) + r")\b").alias("step_words"), contains_any(low, ["turn off", "shut off"]).alias("water_off"),
    )


def quality_signals(col: Column, tokens: Column | None = None, low: Column | None = None, hits: Column | None = None) -> Column:
    """struct: action_verbs, has_step_markers, length_chars, length_tokens, punct_signals, explanatory_hints. The
    stripped lower-case text and its tokens are made once unless they are given; ``hits``: the tokens that are DOC_WORDS."""
    if low is None:
        return let(F.lower(strip(col)), lambda x: quality_signals(col, tokens, x))
    if tokens is None:
        return let(tokens_lower(low), lambda x: quality_signals(col, x, low))
    raw = text(col)
    return F.struct(
        count_in(tokens if hits is None else hits, V.ACTION_VERBS).alias("action_verbs"), step_marker(low).alias("has_step_markers"), F.length(raw).alias("length_chars"),
        F.size(tokens).alias("length_tokens"), F.regexp_count(raw, F.lit("[,;]")).alias("punct_signals"), contained(low, V.EXPLANATORY_HINTS).alias("explanatory_hints"),
    )


def part_terms(col: Column, tokens: Column | None = None) -> Column:
    """Tokens that are part words, or are after one s is taken off."""
    tokens = tokens_word(F.lower(strip(col))) if tokens is None else tokens
    return count_in(tokens, sorted({*V.PART_WORDS, *(p + "s" for p in V.PART_WORDS)}))


def gated_quality(col: Column, signals: Column | None = None, parts: Column | None = None) -> Column:
    """``quality_signals`` with part_terms, procedural and quality_score. Signals and parts that are columns already
    are not computed again; see ``with_quality``."""
    if signals is None and parts is None:
        low = F.lower(strip(col))
        both = lambda x: let(tokens_word(x), lambda w: F.struct(quality_signals(col, w, x).alias("s"), part_terms(col, w).alias("p")))
        return let(let(low, both), lambda f: gated_quality(col, f["s"], f["p"]))
    s = quality_signals(col) if signals is None else signals
    parts = part_terms(col) if parts is None else parts
    part = lambda x, most: F.least(x, F.lit(most)) / float(most)
    score = (
        part(s["action_verbs"], 4) * 0.25 + part(parts, 4) * 0.25 + F.when(s["has_step_markers"], 0.20).otherwise(0.0)
        + part(s["length_tokens"], 40) * 0.20 + part(s["punct_signals"], 6) * 0.10 - part(s["explanatory_hints"], 3) * 0.10
    )
    procedural = s["has_step_markers"] | (s["action_verbs"] >= 2) | ((s["action_verbs"] >= 1) & (parts >= 1))
    kept = [s[f].alias(f) for f in ("action_verbs", "has_step_markers", "length_chars", "length_tokens", "punct_signals", "explanatory_hints")]
    return F.struct(*kept, parts.alias("part_terms"), procedural.alias("procedural"), clamp01(score).alias("quality_score"))


def with_words(rows: DataFrame, doc: str = "text") -> DataFrame:
    """``rows`` with the stripped lower-case text of the column ``doc`` (_low), its tokens (_words) and those of them that are
    DOC_WORDS (_hits), each made once per row."""
    rows = computed(rows, _low=F.lower(strip(F.col(doc))))
    rows = computed(rows, _words=tokens_lower(F.col("_low")))
    return computed(rows, _hits=F.filter("_words", lambda t: t.isin(DOC_WORDS)))


def with_quality(rows: DataFrame, doc: str = "text", name: str = "q") -> DataFrame:
    """``rows`` with ``gated_quality`` of the column ``doc`` and the columns of ``with_words``."""
    d = F.col(doc)
    rows = with_words(rows, doc)
    rows = computed(rows, _s=quality_signals(d, F.col("_words"), F.col("_low"), F.col("_hits")), _parts=part_terms(d, F.col("_hits")))
    return computed(rows, **{name: gated_quality(d, F.col("_s"), F.col("_parts"))}).drop("_s", "_parts")


def action_score(col: Column, quality: Column, said: Column | None = None) -> Column:
    """0.5, more for procedural hits, schedule words and parts, less for a year. ``said``: the text's lower-case tokens, or
    those of them that are DOC_WORDS, where that is a column already."""
    tokens = tokens_word(col) if said is None else F.when(same_in_lower(col), said).otherwise(tokens_word(col))
    year = (F.contains(text(col), F.lit("19")) | F.contains(text(col), F.lit("20"))) & text(col).rlike(V.YEAR)
    hits = quality["action_verbs"] + F.when(quality["has_step_markers"], 2).otherwise(0) + F.least(quality["punct_signals"], F.lit(3))
    score = (
        F.lit(0.5) + F.when(hits >= 5, 0.2).when(hits >= 3, 0.1).otherwise(0.0) + F.when(any_of(tokens, V.SCHEDULE_TOKENS), 0.1).otherwise(0.0)
        + F.when(quality["part_terms"] > 0, 0.1).otherwise(0.0) - F.when(year, 0.1).otherwise(0.0)
    )
    return clamp01(score)


def query_intent(col: Column) -> Column:
    t = tokens_word(F.lower(text(col)))
    return (
        F.when(any_of(t, V.INTENT_HOWTO), "HOWTO").when(any_of(t, V.INTENT_DIAGNOSE), "DIAGNOSE").when(any_of(t, V.INTENT_OVERVIEW), "OVERVIEW")
        .when(any_of(t, V.INTENT_INFO), "INFO").otherwise("UNKNOWN")
    )


def is_howto(col: Column) -> Column:
    return any_of(tokens_word(F.lower(text(col))), V.INTENT_HOWTO)


def kind_gated(col: Column, quality: Column, tokens: Column | None = None, low: Column | None = None) -> Column:
    """The kind of a document under a policy's gates; its lower-case text is made once unless it is given."""
    if low is None:
        return let(F.lower(text(col)), lambda x: kind_gated(col, quality, tokens, x))
    if tokens is None:
        return let(tokens_word(low), lambda x: kind_gated(col, quality, x, low))
    t = tokens
    maintained = any_of(t, V.KIND_MAINTENANCE_TOKENS) | contains_any(low, V.KIND_OIL_PHRASES)
    return (
        F.when(contains_any(low, V.KIND_HOWTO_PHRASES) | (any_of(t, V.KIND_REPAIR_TOKENS) & (quality["action_verbs"] >= 1)), "PROCEDURAL")
        .when(maintained & ((quality["action_verbs"] >= 2) | quality["has_step_markers"]), "PROCEDURAL").when(maintained, "OVERVIEW")
        .when(contains_any(low, V.KIND_INFO_PHRASES), "INFORMATIONAL").when(any_of(t, V.INTENT_DIAGNOSE) | contains_any(low, ["symptoms", "signs of"]), "DIAGNOSTIC")
        .when(any_of(t, V.INTENT_OVERVIEW), "OVERVIEW").otherwise("UNKNOWN")
    )


def kind_generic(col: Column, signals: Column, tokens: Column | None = None, low: Column | None = None) -> Column:
    if low is None:
        return let(F.lower(text(col)), lambda x: kind_generic(col, signals, tokens, x))
    tokens = tokens_word(low) if tokens is None else tokens
    return (
        F.when(contains_any(low, V.KIND_INFO_PHRASES), "INFORMATIONAL").when(contains_any(low, ["symptoms", "signs of"]), "DIAGNOSTIC")
        .when((signals["action_verbs"] >= 2) | signals["has_step_markers"], "PROCEDURAL").when(any_of(tokens, V.INTENT_OVERVIEW), "OVERVIEW").otherwise("UNKNOWN")
    )


def kind_client(col: Column, letters: Column | None = None, low: Column | None = None) -> Column:
    if low is None:
        return let(F.lower(text(col)), lambda x: kind_client(col, letters, x))
    if letters is None:
        return let(tokens_letters(col), lambda x: kind_client(col, x, low))
    t = letters
    return (
        F.when(low.startswith("how to") | F.contains(low, F.lit("steps to")) | (count_in(t, V.CLIENT_VERBS) >= 2), "PROCEDURAL")
        .when(any_of(t, V.CLIENT_MAINTENANCE), "OVERVIEW").when(contains_any(low, V.KIND_INFO_PHRASES), "INFORMATIONAL")
        .when(contains_any(low, ["symptoms", "signs of"]), "DIAGNOSTIC").otherwise("UNKNOWN")
    )


def _fit(matrix: dict[str, tuple[float, ...]], intent: Column, kind: Column, default: float) -> Column:
    table = F.create_map(*[x for i, row in matrix.items() for k, v in zip(V.KINDS, row, strict=True) for x in (F.lit(f"{i}|{k}"), F.lit(v))])
    known = F.when(intent.isin(list(matrix)), intent).otherwise("UNKNOWN")
    return F.coalesce(F.try_element_at(table, F.concat(known, F.lit("|"), kind)), F.lit(default))


def fit_generic(intent: Column, kind: Column) -> Column:
    return _fit(V.INTENT_FIT, intent, kind, 0.5)


def fit_gated(intent: Column, kind: Column) -> Column:
    """The same table, with 0.15 more (to 1) for broad queries and broad documents."""
    base = fit_generic(intent, kind)
    broad = intent.isin("OVERVIEW", "INFO", "UNKNOWN") & kind.isin("OVERVIEW", "INFORMATIONAL")
    return F.when(broad, F.least(F.lit(1.0), base + 0.15)).otherwise(base)


def fit_client(intent: Column, kind: Column) -> Column:
    return _fit(V.CLIENT_INTENT_FIT, intent, kind, 0.7)


def client_intent(query: Column) -> Column:
    return F.when(any_of(tokens_letters(query), V.CLIENT_MAINTENANCE), "OVERVIEW").otherwise("UNKNOWN")


def lexical_bonus(col: Column, letters: Column | None = None) -> Column:
    t = tokens_letters(col) if letters is None else letters
    return F.least(F.lit(0.3), F.when(any_of(t, V.CLIENT_MAINTENANCE), 0.2).otherwise(0.0) + F.when(any_of(t, ["how", "steps"]), 0.1).otherwise(0.0))
