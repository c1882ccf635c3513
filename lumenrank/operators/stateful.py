"""Operators over time, in batch: failure breaker, expiring cache, latency budget. Their streaming forms are in
``streaming.stateful``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running
from .tables import stored


def breaker(events: DataFrame, failed: str, window: str, threshold: int, ts: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """failures (in the trailing window, this event included) and open (at least ``threshold``).

    Events are dealt by ``keys``. Without keys the whole series is one sequence: it is counted in buckets of
    the window's length, each with the bucket before it, so no task gets the whole series.
    """
    keys = keys or []
    rows = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_b", F.floor(F.col("_t") / _micros(window)))
    fails = rows.where(F.col(failed)).select(*keys, "_t", F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"), F.lit(1).alias("_f"), F.lit(None).cast(events.schema[ts].dataType).alias(ts))
    both = rows.withColumn("_f", F.lit(0)).unionByName(fails, allowMissingColumns=True)
    over = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(-_micros(window), 0)
    out = both.withColumn("failures", F.sum("_f").over(over)).where("_f = 0").drop("_f", "_t", "_b")
    return out.withColumn("open", F.col("failures") >= threshold)


def _micros(window: str) -> int:
    n, unit = window.split()
    size = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(float(n) * size * 1_000_000)


#: Distinct times of a key up to which they are folded as one array.
FOLD_TIMES = 100_000


def ttl_cache(requests: DataFrame, keys: list[str], ttl_seconds: float, ts: str = "ts", order: str | None = None, fold_times: int = FOLD_TIMES) -> DataFrame:
    """hit: whether an earlier request of the same key is stored and unexpired. An entry lives ``ttl_seconds``
    from when it was written; a hit doesn't renew it, a miss writes a new one.

    The times of a key (not its rows) are folded in order; those of a key with more than ``fold_times`` different ones
    aren't brought together, see ``hot_writes``. Null times are misses.
    """
    rows = requests.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    limit = int(ttl_seconds * 1_000_000)
    times = stored(rows.select(*keys, "_t").where("_t is not null").distinct(), "times")
    hot = times.groupBy(*keys).count().where(F.col("count") > fold_times).drop("count")
    hot = stored(_null_safe(hot, keys), "hot")
    if hot.isEmpty():
        writes = _folded(times, keys, limit)
    else:
        writes = _folded(times.join(hot, _same(keys), "left_anti"), keys, limit).unionByName(hot_writes(times.join(hot, _same(keys), "left_semi"), keys, limit))
    first = F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(order or "_t"))
    marked = writes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_t").alias("_w"))
    out = rows.withColumn("_first", first).join(marked, _same(keys) & (F.col("_t") == F.col("_w")), "left")
    return out.withColumn("hit", ~((F.col("_w").isNotNull() & (F.col("_first") == 1)) | F.col("_t").isNull())).select(*requests.columns, "hit")


def _same(keys: list[str]):
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])


def _null_safe(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def _folded(times: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, _t) of the writes, each key's times in one array."""
    zero = F.struct(F.lit(None).cast("long").alias("at"), F.array().cast("array<bigint>").alias("writes"))
    step = lambda s, x: F.when(s["at"].isNull() | (x - s["at"] >= limit), F.struct(x.alias("at"), F.concat(s["writes"], F.array(x)).alias("writes"))).otherwise(s)
    few = times.groupBy(*keys).agg(F.array_sort(F.collect_list("_t")).alias("ts"))
    return few.select(*keys, F.explode(F.aggregate("ts", zero, step)["writes"]).alias("_t"))


def hot_writes(times: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, _t) of the writes among distinct times, with no key's times in one place.

    Every time links to the first at or after its expiry. That lies in the next span of the life's length, or begins
    the next span that isn't empty: so links come from windows over one span of a key, and over a key's spans, which are
    as many as its lives at most. The writes are what the links reach from a key's first time: the set of reached
    times and the links double their stride each round.
    """
    span = F.floor(F.col("_t") / limit)
    events = times.select(*keys, span.alias("_b"), F.col("_t").alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_from"))
    asks = times.select(*keys, F.floor((F.col("_t") + limit) / limit).alias("_b"), (F.col("_t") + limit).alias("_x"), F.lit(0).alias("_kind"), F.col("_t").alias("_from"))
    after = Window.partitionBy(*keys, "_b").orderBy("_x", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    within = events.unionByName(asks).withColumn("_to", F.min(F.when(F.col("_kind") == 1, F.col("_x"))).over(after)).where("_kind = 0").select(*keys, "_b", "_from", "_to")
    begins = events.groupBy(*keys, "_b").agg(F.min("_x").alias("_first"))
    spans = begins.unionByName(begins.select(*keys, (F.col("_b") + 1).alias("_b"), F.lit(None).cast("long").alias("_first"))).groupBy(*keys, "_b").agg(F.min("_first").alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    spans = _null_safe(spans.withColumn("_next", F.min("_first").over(later)), keys).select(*[f"_k_{k}" for k in keys], F.col("_b").alias("_span"), "_next")
    links = within.join(spans, _same(keys) & (F.col("_b") == F.col("_span"))).select(*keys, F.col("_from").alias("_t"), F.coalesce("_to", "_next").alias("_to")).where("_to is not null")
    links, reached = stored(links, "links"), stored(times.groupBy(*keys).agg(F.min("_t").alias("_t")), "reached")
    while True:
        jump = _null_safe(links, keys).withColumnRenamed("_t", "_at")
        new = reached.join(jump, _same(keys) & (F.col("_t") == F.col("_at"))).select(*keys, F.col("_to").alias("_t"))
        grown = stored(reached.unionByName(new).distinct(), "reached")
        if grown.count() == reached.count():
            return grown
        far = jump.withColumnRenamed("_to", "_far")
        links, reached = stored(links.join(far, _same(keys) & (F.col("_to") == F.col("_at"))).select(*keys, "_t", F.col("_far").alias("_to")), "links"), grown


def budget(rows: DataFrame, latency: str, most: float, order: list[str], keys: list[str]) -> DataFrame:
    """spent (latency of the rows before, per key; without keys of the whole series) and skipped (spent is over the
    budget). No task holds a whole key: sums run over range partitions, see ``ordered.running``."""
    return running(rows, {"spent": F.col(latency).cast("double")}, order, keys).withColumn("skipped", F.col("spent") > most)


def memoised(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(one row per key for an expensive step, the rows themselves to join its results back on the key)."""
    return rows.dropDuplicates([key]), rows
