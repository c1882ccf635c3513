"""Prompts for model-backed scorers, as expressions. The wording is this package's own; the facts travel as compact JSON
that keeps nulls, examples come from the policy, and the cache key is of model, prompt, clipped document and query."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.policies import Policy
from .facts import identity
from .parsers import compact_json
from .text import text

OUTPUT = 'Answer with one JSON object, {"score": n}, n being 0, 1, 2 or 3, and nothing else.'
RULES = "\n".join([
    "Put the document into a relevance bucket. Rely on FACTS for what query and document are about.",
    OUTPUT,
    "3: the same item, with at least two concrete steps. 2: the same item, partly helpful. 1: the same domain, another item. 0: another domain.",
    "Without a query_item: 2 if domain_match holds and the document is about maintenance or repair, 1 if domain_match holds, else 0.",
    "With a query_item: 2 or 3 if same_item holds; else 1 if domain_match holds, else 0.",
])
FINE = "How well does the document answer the query, from 0 to 100? 100: fully, with correct steps. 70: in part. 40: related only. 0: not at all. Answer with one line, <number>%."


def _bucket(score: float) -> int:
    """``parsers.few_shot_bucket`` for a policy's own examples."""
    return int(score) if score in (0, 1, 2, 3) else 0 if score < 3 else 1 if score < 7 else 2 if score < 10 else 3


def examples(spark: SparkSession, policies: Iterable[Policy]) -> dict[str, str]:
    """The examples of each policy's prompt, by its name: query, document, their facts under that policy, and bucket. The
    facts of all of a policy's examples are one small job; policies without examples need none."""
    out = {}
    for p in policies:
        shots = [(i, str(x["query"]), str(x["doc"]), json.dumps({"score": _bucket(x["score"])})) for i, x in enumerate(p.few_shot)]
        rows = spark.createDataFrame(shots, "i int, query string, doc string, output string").select("*", compact_json(identity(F.col("query"), F.col("doc"), p)).alias("facts")).orderBy("i").collect() if shots else []
        out[p.name] = "".join(f"EXAMPLE\nQUERY: {r['query']}\nDOCUMENT: {r['doc']}\nFACTS: {r['facts']}\nOUTPUT: {r['output']}\n---\n" for r in rows)
    return out


def bucket_prompt(query: Column, doc: Column, facts: Column, shots: str | Column | Policy) -> Column:
    """``shots``: the examples, or the policy that has them."""
    shots = examples(SparkSession.active(), [shots])[shots.name] if isinstance(shots, Policy) else shots
    shots = F.lit(shots) if isinstance(shots, str) else shots
    return F.concat(F.lit(f"{RULES}\n"), shots, F.lit("QUERY: "), text(query), F.lit("\nDOCUMENT: "), text(doc), F.lit("\nFACTS: "), compact_json(facts), F.lit("\nOUTPUT:"))


def retry_prompt(facts: Column) -> Column:
    """The facts alone."""
    return F.concat(F.lit(f"{OUTPUT}\nFACTS: "), compact_json(facts), F.lit("\nOUTPUT:"))


def fine_prompt(query: Column, doc: Column, most: int = 1600) -> Column:
    return F.concat(F.lit(f"{FINE}\nQUERY: "), text(query), F.lit("\nDOCUMENT: "), F.substring(text(doc), 1, most))


#: Asks for a number alone, without query or document.
FINE_RETRY = "Answer with one whole number from 0 to 100 and a percent sign, on one line, and nothing else."


def cache_key(model: str, doc: Column, query: Column, most: int = 1600) -> Column:
    """Model, and SHA-1 of the whole fine prompt, of the document as it is clipped for it, and of the query."""
    return F.concat_ws(":", F.lit(model), F.sha1(fine_prompt(query, doc, most)), F.sha1(F.substring(text(doc), 1, most)), F.sha1(text(query)))
