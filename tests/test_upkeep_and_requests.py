"""Index upkeep, the request source, counters that are taken in passing."""

import json

import pytest
from pyspark.sql import functions as F

from lumenrank import queries as Q
from lumenrank.operators import score
from lumenrank.plans.api import Options, rerank, update_index
from lumenrank.sources.requests import RequestFiles
from lumenrank.streaming import stateful as live


def embedder(log):
    def make():
        def ask(texts):
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            if any(t == "bad" for t in texts):
                raise RuntimeError
            return [[float(len(t)), 1.0] for t in texts]

        return ask

    return make


def test_an_index_embeds_only_what_changed(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "index")
    form = "doc_id long, text string, at int"
    asked = lambda: sorted(open(log).read().splitlines())
    docs = [(i, f"text {i}", 1) for i in range(300)] + [(5, "older", 0), (None, "no id", 1), (300, None, 1), (301, "bad", 1)]
    n = update_index(spark.createDataFrame(docs, form), embedder(log), 2, path, F.col("at"))
    assert n == {"embedded": 302, "removed": 0, "kept": 0} and "older" not in asked() and "no id" not in asked()
    open(log, "w").close()
    docs = [(i, f"text {i}", 1) for i in range(300) if i not in (7, 8)] + [(3, "changed", 2), (400, "new", 1), (300, None, 1), (301, "good", 1)]
    n = update_index(spark.createDataFrame(docs, form), embedder(log), 2, path, F.col("at"))
    assert n == {"embedded": 3, "removed": 2, "kept": 298} and asked() == ["changed", "good", "new"]
    got = {r["doc_id"]: r for r in spark.read.parquet(path).collect()}
    assert len(got) == 301 and got[3]["embedding"] == [7.0, 1.0] and got[5]["embedding"] == [6.0, 1.0] and got[301]["ok"] and 7 not in got and got[300]["embedding"] == [0.0, 1.0]
    open(log, "w").close()
    assert update_index(spark.createDataFrame(docs, form), embedder(log), 2, path, F.col("at")) == {"embedded": 0, "removed": 0, "kept": 301} and asked() == []
    assert update_index(spark.createDataFrame(docs[:1], form), embedder(log), 2, path)["removed"] == 300 and spark.read.parquet(path).count() == 1


def request(folder, name, **body):
    (folder / f".{name}.part").write_text(json.dumps(body) if body else "{broken")
    (folder / f".{name}.part").rename(folder / f"{name}.json")


def test_requests_of_a_spool_in_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(RequestFiles)
    spool = tmp_path / "spool"
    spool.mkdir()
    texts = [t for _, _, t in Q.X.CORPUS]
    request(spool, "001", query="how to fix a leaky shower", documents=texts, policy_id="howto_plumbing_v1")
    request(spool, "002", query="chain", documents=[{"text": "a chain", "original_index": 9, "similarity": 0.5}], top_n=1)
    request(spool, "003")
    rows = spark.read.format("rerank_requests").load(str(spool))
    got = {r["query_id"]: r for r in rows.orderBy("query_id", F.desc("request_index")).collect()}
    assert rows.count() == len(texts) + 2 and got["002"]["original_index"] == 9 and got["002"]["top_n"] == 1 and got["003"]["error"].startswith("JSONDecodeError") and got["001"]["policy_id"] == "howto_plumbing_v1"
    seen = []

    def run():
        stream = spark.readStream.format("rerank_requests").load(str(spool)).where("error is null").drop("top_n", "error")
        sink = lambda df, n: seen.extend((r["query_id"], r["policy_id"], r["original_index"], r["rank"]) for r in df.select("query_id", "policy_id", "original_index", "rank").collect())
        live.rerank_stream(stream, lambda b: rerank(b, Options()), sink, str(tmp_path / "cp")).awaitTermination(150)

    run()
    assert len(seen) == len(set(seen)) == len(texts) + 1 and {s[1] for s in seen if s[0] == "001"} == {"howto_plumbing_v1"}
    request(spool, "004", query="oil change", documents=["oil change steps"])
    run()
    assert [s[0] for s in seen[len(texts) + 1 :]] == ["004"]
    run()
    assert len(seen) == len(texts) + 2


def test_counters_are_taken_in_passing(spark):
    prepared = score.prepare(Q.howto(spark), Q.plumbing())
    rows, seen = score.watched(prepared, score.gate_counters())
    n = rows.count()
    totals = score.gate_stats(prepared).agg(*[F.sum(c).alias(c) for c in score.gate_counters()]).first()
    assert seen.get == totals.asDict() and 0 < sum(seen.get.values()) <= n
    outputs = spark.createDataFrame([(None, 1, False), ("circuit_open", 0, False), ("fine_score_timeout", 1, False), (None, 2, True)], "error string, attempts int, cached boolean")
    rows, seen = score.watched(outputs, score.fine_counters(), "fine")
    rows.collect()
    assert seen.get == score.fine_metrics(outputs).first().asDict()


@pytest.mark.parametrize("name", ["keyword_tiers", "prompt_hash", "fine_outputs", "corpus_gated"])
def test_queries_take_an_empty_benchmark(spark, sf_dir, tmp_path, name):
    for t in ("documents", "benchmark"):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        (df.limit(0) if t == "benchmark" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = Q.QUERIES[name](spark, str(tmp_path))
    assert got.where("query_id >= 0" if "query_id" in got.columns else "true").count() == 0
