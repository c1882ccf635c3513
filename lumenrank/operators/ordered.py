"""Running sums and ranks along an order, without a task that holds a whole key.

Rows are range-partitioned by key and order, so a key with many rows lies in several neighbouring partitions. A
running sum is the sum of the key's partitions before, a few numbers, plus the running sum inside the partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


def _named(order: list[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def running(rows: DataFrame, sums: dict[str, Column], order: list[str | Column], keys: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with columns named in ``sums``: the sum of that expression over the key's rows before, 0 for the first.

    ``order`` must tell the rows of a key apart; rows of equal order lie in one partition, and come in any order. Without keys
    the table is one sequence. Null keys are a key; a null expression adds nothing. ``parts``: range partitions
    (default: ``spark.sql.shuffle.partitions``).
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order, values = _named(order), {f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    cut = rows.withColumns(values).repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    cut = stored(cut, "ordered")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    totals = cut.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a partition
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    out = local.join(offsets, same).withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums})
    return out.select(*rows.columns, *sums)


def exact_rank(rows: DataFrame, order: list[str | Column], keys: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their rank from 1 along ``order``, per key, as ``row_number`` has it."""
    return running(rows, {name: F.lit(1).cast("long")}, order, keys, parts).withColumn(name, F.col(name) + 1)
