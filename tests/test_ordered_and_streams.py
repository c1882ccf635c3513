"""Ranks, sums and caches of keys too large for a task, and streams whose rows come in any order."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenrank.operators import ordered, stateful
from lumenrank.streaming import stateful as live


def test_ranks_of_one_huge_key_need_no_task_that_holds_it(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 7 == 0, F.lit("b")).otherwise("a").alias("k"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("s"), "id")
    order = [F.desc("s"), "id"]
    got = ordered.exact_rank(rows, order, ["k"], parts=16)
    want = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert got.columns == ["k", "s", "id", "rank"] and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    sizes = [r["count"] for r in rows.repartitionByRange(16, "k", *order).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 4000  # of 20,000, 17,000 of one key
    assert ordered.exact_rank(rows.limit(0), order, ["k"]).count() == 0 and sorted(r["rank"] for r in ordered.exact_rank(rows.limit(30), ["id"], []).collect()) == list(range(1, 31))


def test_running_sums_take_nulls(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 1.5), (None, 1, 4.0), (None, 5, 1.0)], "k string, t int, v double")
    got = ordered.running(rows, {"v_before": F.col("v"), "n": F.lit(1)}, ["t"], ["k"]).orderBy("k", "t").collect()
    assert [(r["k"], r["v_before"], r["n"]) for r in got] == [(None, 0.0, 0), (None, 4.0, 1), ("a", 0.0, 0), ("a", 2.0, 1), ("a", 2.0, 2)]
    spent = stateful.budget(rows, "v", 1.9, ["t"], ["k"]).where("skipped").count()
    assert spent == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_a_cache_with_one_key_by_links_equals_the_fold(spark, seed):
    rng, t0 = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), t0 + dt.timedelta(seconds=rng.choice([rng.randint(0, 600), rng.randint(0, 20_000)]))) for i in range(400)] + [(999, "a", None)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz")
    a, b = ({r["id"]: r["hit"] for r in stateful.ttl_cache(df, ["k"], 90, order="id", fold_times=n).collect()} for n in (10**6, 20))
    written, want = {}, {999: False}
    for i, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        want[i] = k in written and t - written[k] < dt.timedelta(seconds=90)
        if not want[i]:
            written[k] = t
    assert a == want and b == want and set(want.values()) == {True, False}


def test_streams_of_shuffled_rows_equal_batch(spark, tmp_path):
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice("kmn"), t0 + dt.timedelta(seconds=7 * (i // 2)), rng.random() < 0.4, rng.choice([None, float(rng.randint(1, 90))])) for i in range(240)]
    form = "id int, k string, ts timestamp, failed boolean, ms double"
    rows.sort(key=lambda r: r[2].timestamp() + rng.uniform(-200, 200))  # late by less than the delay
    parts = [rows[i : i + 60] for i in range(0, 240, 60)] + [[(-1, "k", t0 + dt.timedelta(days=9), False, 0.0)], [(-2, "k", t0 + dt.timedelta(days=10), False, 0.0)]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, form).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame(rows, form)
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cases = {
        "cache2": (live.ttl_cache(stream(), "k", 100, delay="10 minutes"), stateful.ttl_cache(batch, ["k"], 100, order="id"), ["hit"]),
        "breaker2": (live.breaker(stream(), "failed", "60 seconds", 2, "k"), stateful.breaker(batch, "failed", "60 seconds", 2, keys=["k"]), ["failures", "open"]),
        "budget2": (live.budget(stream(), "ms", 500.0, "k"), stateful.budget(batch, "ms", 500.0, ["ts"], ["k"]), ["spent"]),
    }
    for name, (df, want, cols) in cases.items():
        usual = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "1")  # state stores, started one by one
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(170)
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        # rows of one time and key may change places: compare what a time's rows have between them
        shape = lambda d: sorted((r["k"], r["ts"], *(str(round(r[c], 6) if isinstance(r[c], float) else r[c]) for c in cols)) for r in d.where("id >= 0").collect())
        got = spark.table(name)
        assert got.where("id >= 0").count() == 240 and len(q.recentProgress) > 4
        if name == "budget2":
            least = lambda d: {(r["k"], r["ts"]): round(r["s"], 6) for r in d.where("id >= 0").groupBy("k", "ts").agg(F.min("spent").alias("s")).collect()}
            assert least(got) == least(want)
        else:
            assert shape(got) == shape(want)
