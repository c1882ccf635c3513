"""From model output to numbers: bucket, fine score, fallback score, response shapes, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, text


def _braced(t: Column) -> Column:
    """The text from the first brace to the last, or empty."""
    return F.when(F.contains(t, F.lit("{")), F.regexp_extract(t, r"(?s)^[^{]*(\{.*\})", 1)).otherwise("")


def _parsed(braced: Column) -> Column:
    """JSON of ``_braced``, or null. A failing parse throws inside, so texts without braces don't get there."""
    return F.when(braced != "", F.try_parse_json(braced))


def _number(doc: Column, keys: list[str]) -> Column:
    """The value of the first key that is there, if it is a number or a boolean."""
    out = F.lit(None).cast("double")
    for k in reversed(keys):
        value = F.try_variant_get(doc, f"$.{k}", "variant")
        kind = F.schema_of_variant(value)
        flag = F.try_variant_get(doc, f"$.{k}", "boolean").cast("double")
        number = F.when(kind == "BOOLEAN", flag).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(doc, f"$.{k}", "double"))
        out = F.when(value.isNotNull(), number).otherwise(out)
    return out


def nearest_bucket(x: Column) -> Column:
    """Of the old scale 0, 3, 7, 10 the nearest step's number (ties: the lower)."""
    return F.when(x <= 1.5, 0).when(x <= 5, 1).when(x <= 8.5, 2).otherwise(3)


def legacy_bucket(x: Column) -> Column:
    """0, 1, 2 stay, 3, 7 and 10 are steps 1, 2 and 3; others null."""
    return F.when(x == 0, 0).when(x == 1, 1).when(x == 2, 2).when(x == 3, 1).when(x == 7, 2).when(x == 10, 3)


def few_shot_bucket(score: Column) -> Column:
    """An example's score as a bucket: 0 to 3 stay, from there on each step of the old scale counts."""
    return F.when(score.isin(0, 1, 2, 3), score.cast("int")).when(score < 3, 0).when(score < 7, 1).when(score < 10, 2).otherwise(3)


def parse_bucket(raw: Column) -> Column:
    """0 to 3 or null. A JSON score counts as a bucket (7 and 10 as steps, others to the nearest step);
    otherwise the rightmost integer that the old scale knows. Quotes and back-ticks around change neither."""

    def of_json(n: Column) -> Column:
        return let(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)), lambda x: F.when(x.between(0, 3), x).when(x == 7, 2).when(x == 10, 3).otherwise(nearest_bucket(x)).cast("int"))

    def scan(t: Column) -> Column:
        return let(F.regexp_extract(t, r"(?s)^.*(?<!\d)0*(10|[01237])(?!\d)", 1), lambda x: F.when(x != "", legacy_bucket(x.cast("int"))))

    def both(t: Column, braced: Column) -> Column:
        said = F.when(braced != "", let(_parsed(braced), lambda d: _number(d, ["score", "SCORE", "Score"])))
        return let(said, lambda n: F.when(n.isNotNull(), of_json(n)).otherwise(scan(t)))

    return let(text(raw), lambda t: F.when(t != "", let(_braced(t), lambda b: both(t, b))))


def percent(x: Column) -> Column:
    """Rounded half to even, 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(x).cast("int")))


def parse_fine(raw: Column) -> Column:
    """struct(score int, error string): JSON, a labelled number, a percentage, or the rightmost number, in
    this order; numbers up to 1 without a percent sign are shares. What a text doesn't need is not looked for."""
    label = r"(?i)(?:fine[_ ]?score|score|tie)\s*(?:\"\s*)?[:=]\s*(-?\d+(?:\.\d+)?%?)"
    within = lambda x: percent(F.greatest(F.lit(-1.0), F.least(F.lit(100.0), x)))
    share = lambda x: within(F.when(x <= 1, x * 100).otherwise(x))

    def last(t: Column) -> Column:
        return let(F.try_element_at(F.regexp_extract_all(t, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1)).try_cast("double"), lambda x: F.when(x.isNotNull(), share(x)))

    def signed(t: Column) -> Column:
        part = F.when(F.contains(t, F.lit("%")), F.regexp_extract(t, r"(-?\d+(?:\.\d+)?)\s*%", 1)).otherwise("")
        return let(part, lambda p: F.when(p != "", within(p.try_cast("double"))).otherwise(last(t)))

    def plain(t: Column) -> Column:
        said = lambda m: F.when(m.endswith("%"), within(F.rtrim(m, F.lit("%")).try_cast("double"))).otherwise(let(m.try_cast("double"), share))
        return let(F.regexp_extract(t, label, 1), lambda m: F.when(m != "", said(m)).otherwise(signed(t)))

    def ended(score: Column) -> Column:
        return let(score, lambda x: F.struct(x.alias("score"), F.when(x.isNull(), "parse_failed").alias("error")))

    def failed(error: str) -> Column:
        return F.struct(F.lit(None).cast("int").alias("score"), F.lit(error).alias("error"))

    def found(t: Column, braced: Column, d: Column) -> Column:
        said = F.when(d.isNotNull(), _number(d, ["fine_score", "score", "tie"]))
        score = let(said, lambda n: F.when(n.isNotNull(), share(n)).otherwise(plain(t)))
        return F.when(t == "", failed("empty_output")).when((braced != "") & d.isNull(), failed("json_parse_failed")).otherwise(ended(score))

    return let(strip(raw), lambda t: let(_braced(t), lambda b: let(_parsed(b), lambda d: found(t, b, d))))


def fallback_fine(fit: Column, similarity: Column) -> Column:
    """70 % fit and 30 % similarity as a percentage; nulls count as 0."""
    return percent((F.coalesce(fit, F.lit(0.0)) * 0.7 + F.coalesce(similarity, F.lit(0.0)) * 0.3) * 100)


def parse_legacy_scale(raw: Column) -> Column:
    """struct(score, reason): a model output on the old scale 0, 3, 7, 10: JSON, a labelled score, or the
    first bare one."""
    t = text(raw)
    n = F.floor(let(let(_braced(t), _parsed), lambda d: F.when(d.isNotNull(), _number(d, ["score", "SCORE", "Score"]))))
    tag = F.regexp_extract(t, r"(?i)\bscore\s*[:=]\s*(10|7|3|0)\b", 1)
    bare = F.regexp_extract(t, r"\b(10|7|3|0)\b", 1)
    found = F.when(text(raw) == "", F.lit("empty_output")).when(n.isin(0, 3, 7, 10), "json").when(tag != "", "score_tag").when(bare != "", "bare_token").otherwise("no_match")
    score = F.when(found == "json", n.cast("int")).when(found == "score_tag", tag.try_cast("int")).when(found == "bare_token", bare.try_cast("int"))
    return F.struct(score.alias("score"), found.alias("reason"))


def _shape(data: Column) -> Column:
    get = lambda p: F.when(F.schema_of_variant(F.try_variant_get(data, p, "variant")) == "STRING", F.try_variant_get(data, p, "string"))
    return F.coalesce(*[get(p) for p in ("$.response", "$.message.content", "$.choices[0].message.content", "$.choices[0].text", "$.text")])


def response_text(raw: Column) -> Column:
    """The answer in a model server's reply, whichever of the usual shapes it has; of JSON lines the first
    line with one; else the reply itself."""
    t = strip(raw)
    whole = _shape(F.try_parse_json(t))
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: _shape(F.try_parse_json(x))), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(whole, F.try_element_at(lines, F.lit(1)), F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), F.lit("")), t)


def compact_json(struct: Column) -> Column:
    """Compact JSON that keeps nulls."""
    return F.to_json(struct, {"ignoreNullFields": "false"})
