"""Connected components of a link table, by alternating large-star and small-star rounds.

Links never leave the cluster; every round is a written table, so lineage stays short and a lost executor
repeats one round at most. Minima are pre-aggregated before their shuffle, and the joins back to the links
can be split by adaptive execution where one node holds many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Links (u, v), v < u. Large star (``both``): each larger neighbour of u is linked to the least node
    about u; small star: u and its smaller neighbours are."""
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else links
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if both:
        out = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): component is the least node that it reaches."""
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.count_distinct("u")).first()
        if found[0] == 0 or tuple(found) == mark:
            break
        mark = tuple(found)
        before, now = now, stored(_star(_star(now, True), False), "links")
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
