"""Policies as rows: a table of word arrays that joins its policy to each request row.

One plan serves any number of policies: what a function reads of a policy are columns. The rows of a policy are as
many as the requests that ask for it, so the table is broadcast while its bytes are known to be few; a larger one is
joined by shuffle, where adaptive execution splits the rows of a policy that many ask for.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from .policies import Policy

#: Bytes of a policy table that is broadcast.
BROADCAST_BYTES = 8 << 20
SCHEMA = (
    "policy_name string, policy_synonyms map<string,string>, policy_tier_a array<string>, policy_domain array<string>, policy_triggers array<string>, "
    "policy_items array<struct<item:string,names:array<string>>>, policy_shots string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class PolicyColumns:
    """What functions read of a policy, as columns of the row. ``terms`` are the item names of all policies: texts are
    searched for them once, whatever the row's policy."""

    terms: tuple[str, ...]

    name = property(lambda self: F.col("policy_name"))
    synonym_map = property(lambda self: F.col("policy_synonyms"))
    tier_a = property(lambda self: F.col("policy_tier_a"))
    domain_keywords = property(lambda self: F.col("policy_domain"))
    ambiguous_triggers = property(lambda self: F.col("policy_triggers"))
    items = property(lambda self: F.col("policy_items"))
    shots = property(lambda self: F.col("policy_shots"))
    intent_keywords = property(lambda self: V.CONTEXT_INTENT)


def _row(p: Policy, shots: str) -> tuple:
    items = [(item, sorted({n.lower() for n in names})) for item, names in p.item_aliases.items()]
    return (p.name, p.synonym_map, list(p.tier_a), list(p.domain_keywords), list(p.ambiguous_triggers), items, shots)


def policy_table(spark: SparkSession, policies: Iterable[Policy], shots: dict[str, str] | None = None) -> tuple[DataFrame, PolicyColumns]:
    """(one row a policy, what functions read of it). ``shots``: the examples of a policy's prompt, by its name."""
    rows = [_row(p, (shots or {}).get(p.name, "")) for p in policies]
    table = spark.createDataFrame(rows, SCHEMA)
    if len(json.dumps(rows)) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return table, PolicyColumns(tuple(sorted({n for r in rows for _, names in r[5] for n in names})))


def with_policy(rows: DataFrame, name: Column, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of the policy that ``name`` says; rows of no known policy are left out."""
    return rows.withColumn("policy_name", name).join(table, "policy_name")
