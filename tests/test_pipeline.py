import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank import fixtures as X
from lumenrank import queries as Q
from lumenrank.functions import text as T
from lumenrank.operators import evaluate, fallback, rank, retrieve, score, stateful, tiles
from lumenrank.plans.api import FineLimits, Options, build_index, cache_rows, fine_pass, rerank, search
from lumenrank.sources import corpora
from lumenrank.sources.policies import Policy
from lumenrank.streaming import stateful as live


def test_howto_goldens(spark):
    got = {r["original_index"]: r for r in rank.client_order(rank.final_order(rank.gated(score.score(Q._facts(spark), Q.plumbing()), Q.plumbing()).withColumn("fine_score", F.lit(None).cast("int")))).where("query_id = 1").collect()}
    want = {0: (3, None, "ACCEPT", 0.8), 2: (2, None, "ACCEPT", 0.42), 4: (0, "item_mismatch", "REJECT_TIER_0", 0), 6: (0, "no_item_found", "REJECT_TIER_1", 0)}
    want |= {i: (0, "domain_mismatch", "REJECT_TIER_2", 0) for i in (1, 5, 9, 3, 7, 8)}
    for i, (tier, reason, decision, score_) in want.items():
        r = got[i]
        assert (r["tier"], r["zero_reason"], r["decision"]) == (tier, reason, decision) and r["rank_score"] == pytest.approx(score_), i
    assert sorted(got, key=lambda i: got[i]["rank"]) == [0, 2, 4, 1, 6, 5, 9, 3, 7, 8]
    assert sorted(got, key=lambda i: got[i]["client_rank"]) == [0, 2, 4, 6, 1, 5, 9, 3, 7, 8]
    assert got[6]["score"] == pytest.approx(0.04)


def test_ranking_invariants(spark):
    one = Q._gated(spark).collect()
    assert {r["bucket"] for r in one} <= {0, 1, 2, 3} and all(0 <= r["score_norm"] <= 1 for r in one)
    for q, _ in X.QUERIES:
        mine = sorted((r for r in one if r["query_id"] == q), key=lambda r: r["policy_rank"])
        assert [r["policy_rank"] for r in mine] == list(range(1, 11)) and sorted(r["original_index"] for r in mine) == list(range(10))
        kinds = [r["decision"] == "ACCEPT" for r in mine]
        assert kinds == sorted(kinds, reverse=True)


def test_scorer_never_sees_gated_rows(spark):
    rows = score.prepare(Q.howto(spark).where("query_id = 1"), Q.plumbing())

    def make():
        def ask(prompts):
            if any("Winter" in p for p in prompts):
                raise RuntimeError("gated row")
            return ['{"score": 2}' if "FACTS" in p else "?" for p in prompts]

        return ask

    got = score.score(rows, Q.plumbing(), make, F.concat(F.col("text"), F.lit(" FACTS")), F.lit("FACTS")).collect()
    assert len(got) == 10 and all(r["bucket"] == 0 and r["warning"] is None for r in got if r["gate"]) and {r["bucket"] for r in got if not r["gate"]} <= {1, 2}


def _client(answers):
    def make():
        import time

        def ask(prompts):
            said = answers[prompts[0]]
            if said == "slow":
                time.sleep(0.6)
                return ["1"]
            if said in ("TimeoutError", "ConnectionError", "KeyError"):
                raise {"TimeoutError": TimeoutError, "ConnectionError": ConnectionError, "KeyError": KeyError}[said]
            return [said]

        return ask

    return make


def test_generate_bounds_calls(spark):
    rows = spark.createDataFrame([(1, 0, "good"), (1, 1, "slow"), (1, 2, "good"), (2, 0, None), (2, 1, "bad")], "q int, i int, p string").coalesce(1)
    make = _client({"good": "1", "slow": "slow", "bad": "KeyError"})
    got = {(r["q"], r["i"]): r for r in score.generate(rows, "p", make, timeout=0.3).collect()}
    assert [(got[k]["raw"], got[k]["attempts"], got[k]["error"]) for k in sorted(got)] == [("1", 1, None), (None, 1, "TimeoutError"), ("1", 1, None), (None, 0, None), (None, 1, "KeyError")]
    got = {(r["q"], r["i"]): r["error"] for r in score.generate(rows, "p", make, budget=("q", 0.5)).collect()}
    assert got[1, 1] is None and got[1, 2] == "skipped_total_budget" and got[2, 1] == "KeyError"


def test_scorer_is_asked_again_by_the_parsers_verdict(spark):
    """Retried: no bucket in the answer (even if it has digits), timeouts, lost connections. Other errors warn at once."""
    made = [(i, p, f"{p} again", "tier_0" if p == "gated" else None) for i, p in enumerate(["2", "score 85", "TimeoutError", "ConnectionError", "KeyError", "never", "gated"])]
    rows = spark.createDataFrame(made, "request_index int, p string, r string, gate string").withColumns({"query": F.lit("q"), "text": F.lit("t"), "facts": F.lit(None)})
    answers = {p: p for _, p, _, _ in made} | {f"{p} again": '{"score": 3}' for _, p, _, _ in made} | {"never": "none", "never again": "none at all"}
    got = {r["p"]: (r["bucket"], r["warning"] and tuple(r["warning"])) for r in score.score(rows, Policy(), _client(answers), F.col("p"), F.col("r")).collect()}
    assert got == {"2": (2, None), "score 85": (3, None), "TimeoutError": (3, None), "ConnectionError": (3, None), "KeyError": (0, ("KeyError", None)), "never": (0, ("score parse failed", "none at all")), "gated": (0, None)}


def test_fine_pass_statuses(spark):
    def text_of(answers):
        plain = _client(answers)

        def make():
            inner = plain()
            return lambda ps: inner([next((a for a in answers if f"DOCUMENT: {a}" in ps[0]), "retry")])

        return make

    said = {"good": "60%", "bad": "none", "empty": " ", "slow": "TimeoutError", "boom": "KeyError", "retry": "33%"}
    texts = ["good", "bad", "empty", "slow", "boom", "good"]
    rows = spark.createDataFrame([(1, i, "q", t, i) for i, t in enumerate(texts)], "query_id int, original_index int, query string, text string, policy_rank int")
    now = F.lit(dt.datetime(2024, 1, 1, 12)).cast("timestamp")
    out = fine_pass(text_of(said), "m", now=now)(rows).cache()
    got = {r["original_index"]: (r["raw"], r["error"], r["attempts"], r["cached"]) for r in out.collect()}
    assert got == {0: ("60%", None, 1, False), 1: ("33%", None, 2, False), 2: (" ", "empty_output", 1, False), 3: (None, "fine_score_timeout", 1, False), 4: (None, "fine_score_exc:KeyError", 1, False), 5: ("60%", None, 1, False)}
    assert score.fine_metrics(out).first().asDict() == {"requested": 6, "cache_hits": 0, "parse_errors": 1, "retries": 1, "retry_errors": 0, "timeouts": 1, "skipped_budget": 0, "circuit_open": 0, "empty": 1}
    kept = cache_rows(out, now=now).cache()
    assert kept.count() == 5
    again = {r["original_index"]: (r["raw"], r["error"], r["cached"]) for r in fine_pass(text_of({**said, "good": "1%"}), "m", cache=kept, now=now)(rows).collect()}
    assert again == {i: (v[0], v[1], True) for i, v in got.items()}  # errors are remembered, too
    late = now + F.expr("interval 1 hour")
    assert {r["cached"] for r in fine_pass(text_of(said), "m", cache=kept, now=late)(rows).collect()} == {False}
    worse = fine_pass(text_of({**said, "retry": "none"}), "m", now=now)(rows).where("original_index = 1").first()
    assert worse["error"].startswith("percent_retry_parse:") and worse["attempts"] == 2
    fails = spark.createDataFrame([(dt.datetime(2024, 1, 1, 11, 59, 30 + i),) for i in range(5)], "at timestamp")
    assert {r["error"] for r in fine_pass(text_of(said), "m", failures=fails, now=now)(rows).collect()} == {"circuit_open"}
    assert "circuit_open" not in {r["error"] for r in fine_pass(text_of(said), "m", failures=fails, now=late)(rows).collect()}


def test_a_scorer_that_dies_midway_opens_the_circuit(spark):
    def make():
        asked = []

        def answer(prompts):
            asked.extend(prompts)
            if len(asked) > 6:
                raise ConnectionError
            return ["60%"] * len(prompts)

        return answer

    rows = spark.createDataFrame([(1, i, "q", f"text {i}", i) for i in range(30)], "query_id int, original_index int, query string, text string, policy_rank int")
    limits = FineLimits(concurrency=1, threshold=3, trip=True)
    got = {r["original_index"]: (r["error"], r["attempts"]) for r in fine_pass(make, "m", limits)(rows).collect()}
    assert [got[i] for i in range(30)] == [(None, 1)] * 6 + [("fine_score_exc:ConnectionError", 1)] * 3 + [("circuit_open", 0)] * 21
    assert {e for e, _ in {r["original_index"]: (r["error"], 0) for r in fine_pass(make, "m", FineLimits(concurrency=1, threshold=3))(rows).collect()}.values()} == {None, "fine_score_exc:ConnectionError"}


def test_a_job_makes_no_more_calls_at_once_than_it_may(spark, tmp_path):
    log = str(tmp_path / "calls")

    def make():
        import time

        def answer(prompts):
            began = time.time()
            time.sleep(0.05)
            with open(log, "a") as f:
                f.write(f"{began} {time.time()}\n")
            return ["60%"] * len(prompts)

        return answer

    def most():
        times = [tuple(map(float, line.split())) for line in open(log)]
        open(log, "w").close()
        return max(sum(a <= at < b for a, b in times) for at, _ in times)

    rows = spark.range(0, 60, 1, 12).select((F.col("id") % 20).alias("query_id"), F.col("id").alias("original_index"), F.lit("q").alias("query"), F.concat(F.lit("t"), "id").alias("text"), F.col("id").alias("policy_rank"), F.concat(F.lit("p"), "id").alias("prompt"))
    assert score.generate(rows, "prompt", make, concurrency=2).count() == 60 and most() > 4
    assert score.generate(rows, "prompt", make, concurrency=2, most_calls=4).where("raw = '60%'").count() == 60 and most() <= 4
    assert fine_pass(make, "m", FineLimits(concurrency=2, most_calls=4))(rows).where("error is null").count() == 60 and most() <= 4
    with pytest.raises(ValueError):
        score.generate(rows, "prompt", make, concurrency=4, most_calls=3)


def test_fine_scores_merge(spark):
    got = {r["original_index"]: r for r in Q._final(spark).where("query_id = 1").collect()}
    assert got[0]["fine_score"] == 77 and got[0]["tie_breaker_error"] is None
    assert got[2]["tie_breaker_error"] == "json_parse_failed|fallback" and got[2]["fine_score"] == 69
    assert got[4]["fine_score"] is None and not got[4]["tie_breaker_used"]


def test_rerank_end_to_end(spark):
    rows = Q.howto(spark)
    got = rerank(rows.where("query_id in (1, 3)"), Options(top_n=2), fine=fine_pass(lambda: lambda ps: ["60%"] * len(ps))).collect()
    assert {(r["query_id"], r["policy_id"]) for r in got} == {(1, "howto_plumbing_v1"), (3, "howto_automotive_v1")} and all(r["rank"] <= 2 for r in got)
    assert all(r["fine_score"] == 60 for r in got if r["decision"] == "ACCEPT")
    kept = rerank(spark.createDataFrame([(1, "help", 0, 7, "nothing here", 0.5)], "query_id long, query string, request_index int, original_index long, text string, similarity double"), Options(policy_id="generic")).first()
    assert kept["decision"] == "KEEP_LOW_SIGNAL"


def test_search_splits_ambiguous(spark):
    docs = spark.createDataFrame([(i, t) for i, _, t in X.CORPUS], "doc_id long, text string")
    index = spark.createDataFrame([(i, [float(i == 0), float(i % 3), 1.0]) for i, _, _ in X.CORPUS], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "fix shower", [1.0, 0.0, 0.0]), (2, "maintenance", [0.0, 1.0, 0.0])], "query_id long, query string, embedding array<float>")
    ranked, other = search(queries, index, docs, Options(top_k_retrieval=3))
    assert {r["query_id"] for r in ranked.collect()} == {1} and {r["query_id"] for r in other.collect()} == {2}


def test_top_k_edges(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>")
    got = retrieve.top_k(q, corpus, 5).orderBy("rank").collect()
    assert [(r["doc_id"], r["sim"]) for r in got] == [(1, 1.0), (2, 1.0), (3, None), (5, None)]
    assert retrieve.top_k(q.limit(0), corpus, 5).count() == 0
    both = corpus.crossJoin(q.select(F.col("embedding").alias("q"))).select("doc_id", retrieve.cosine(F.col("embedding"), F.col("q")).alias("c")).collect()
    assert {r["doc_id"]: r["c"] for r in both} == {1: 1.0, 2: 1.0, 3: None, 4: None, 5: None}


def test_every_vector_is_a_query(spark, sf_dir, monkeypatch):
    rows = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect())
    ids, label = np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows])
    m = np.array([r["embedding"] for r in rows], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    sims = m @ m.T
    np.fill_diagonal(sims, -np.inf)
    want = {int(q): [int(x) for x in ids[np.lexsort((ids, -sims[i]))[:10]]] for i, q in enumerate(ids)}
    monkeypatch.setattr(tiles, "ROWS", 64)  # several blocks and slots
    monkeypatch.setattr(tiles, "QUERIES", 100)
    got = {}
    for r in Q.QUERIES["topk_cosine_all"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want
    of, n = dict(zip(ids.tolist(), label.tolist(), strict=True)), {x: int((label == x).sum()) - 1 for x in set(label.tolist())}
    per = {}
    for q, near in want.items():
        hits = [i for i, x in enumerate(near, 1) if of[x] == of[q]]
        if n[of[q]]:
            per[q] = (float(hits[:1] == [1]), 1 / hits[0] if hits else 0.0, float(bool(hits) and hits[0] <= 3), sum(i <= 3 for i in hits) / n[of[q]])
    figures = {r["query_id"]: tuple(r)[1:] for r in Q.QUERIES["retrieval_metrics_all"](spark, sf_dir).collect()}
    assert figures.keys() == per.keys() and all(figures[q] == pytest.approx(per[q], abs=1e-6) for q in per)
    avg = Q.QUERIES["retrieval_average_all"](spark, sf_dir).first()
    assert avg["queries"] == len(per) and tuple(avg)[1:] == pytest.approx(np.mean(list(per.values()), axis=0), abs=1e-6)
    diverse = {}
    for r in Q.QUERIES["diversified_topk_all"](spark, sf_dir).orderBy("query_id", "rank").collect():
        diverse.setdefault(r["query_id"], []).append(r["vec_id"])
    for q, near in want.items():
        heads = list({of[x]: x for x in reversed(near)}.values())
        heads = sorted(heads, key=near.index)[:3]
        assert diverse[q] == heads + [x for x in near if x not in heads]


def test_requests_and_responses(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"model": "m", "query": "q", "documents": ["a", "b"], "top_n": 1}')
    rows = retrieve.requests(corpora.read_string_requests(spark, str(tmp_path / "r.json"))).collect()
    assert [(r["request_index"], r["original_index"], r["text"], r["similarity"]) for r in rows] == [(0, 0, "a", None), (1, 1, "b", None)]
    (tmp_path / "f.json").write_text('{"query": "q", "documents": [{"text": "a", "original_index": 5, "similarity": 0.5}]}')
    assert retrieve.requests(corpora.read_requests(spark, str(tmp_path / "f.json"))).first()["original_index"] == 5
    (tmp_path / "c.json").write_text('["x", "y"]')
    assert [tuple(r) for r in corpora.read_corpus(spark, str(tmp_path / "c.json")).collect()] == [(0, "x"), (1, "y")]
    got = corpora.responses(Q._final(spark), model="m").where("query_id = 1").first()
    assert [r["rank"] for r in got["results"]] == list(range(1, 11)) and '"model":"m"' in got["json"]


def test_index_build_marks_failures(spark, tmp_path):
    def make():
        def ask(texts):
            if "bad" in texts:
                raise OSError
            return [[1.0, 2.0]] * len(texts)

        return ask

    docs = spark.createDataFrame([(0, "ok"), (1, "bad")], "doc_id long, text string")
    build_index(docs, make, 2, str(tmp_path))
    got = {r["doc_id"]: (r["embedding"], r["ok"]) for r in corpora.read_index(spark, str(tmp_path / "index")).collect()}
    assert got == {0: ([1.0, 2.0], True), 1: ([0.0, 0.0], False)}


def test_diversify_and_defaults(spark):
    rows = spark.createDataFrame([(1, i, d, s) for i, (d, s) in enumerate([("a", 9.0), ("a", 8.0), ("b", 7.0), ("c", 6.0), ("d", 5.0)])], "query_id long, retrieval_rank int, domain string, score double")
    got = fallback.diversified(rows, "score", "domain", ["retrieval_rank"]).orderBy("rank").collect()
    assert [r["retrieval_rank"] for r in got] == [0, 2, 3, 1, 4]
    sims = retrieve.default_similarity(spark.createDataFrame([(1, 0, None), (1, 1, 0.3), (1, 2, None), (2, 0, None)], "query_id int, request_index int, similarity double")).orderBy("query_id", "request_index").collect()
    assert [r["similarity"] for r in sims] == [1.0, 0.3, 0.0, 1.0]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "query_id int, doc_id int, rank int")
    rel = spark.createDataFrame([(1, 6), (1, 9), (2, 7), (3, 1)], "query_id int, doc_id int")
    got = {r["query_id"]: tuple(r)[1:] for r in evaluate.metrics(ranked, rel).collect()}
    assert got == {1: (0.0, 0.5, 1.0, 0.5), 2: (1.0, 1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0, 0.0)}


def test_caps_are_opt_in(spark):
    rows = spark.createDataFrame([("fix shower", "kitchen sink", 3), ("fix shower", "remove shower", 2)], "query string, text string, bucket int")
    caps = [{"if_query_contains_any": ["shower"], "and_doc_contains_any": ["sink"], "cap_to": 0}]
    boosts = [{"if_base_score_at_least": 7, "and_doc_contains_any": ["remove"], "and_doc_contains_any2": ["shower"], "boost_to": 10}]
    assert [r["bucket"] for r in rank.apply_caps(rows, caps, boosts).collect()] == [0, 3]


def _events(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "k" if i % 2 else "m", t0 + dt.timedelta(seconds=20 * i), i % 3 == 0) for i in range(30)]
    return spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, failed boolean")


def test_breaker_and_cache_match_loops(spark):
    rows = _events(spark).orderBy("id").collect()
    fails, want = [], {}
    for r in rows:
        if r["failed"]:
            fails.append(r["ts"])
        want[r["id"]] = sum(f >= r["ts"] - dt.timedelta(seconds=60) for f in fails)
    got = {r["id"]: r["failures"] for r in stateful.breaker(_events(spark), "failed", "60 seconds", 2).collect()}
    assert got == want
    written, hits = {}, {}
    for r in rows:
        hits[r["id"]] = r["k"] in written and r["ts"] - written[r["k"]] < dt.timedelta(seconds=100)
        if not hits[r["id"]]:
            written[r["k"]] = r["ts"]
    assert {r["id"]: r["hit"] for r in stateful.ttl_cache(_events(spark), ["k"], 100).collect()} == hits


def test_rerank_stream(spark, tmp_path):
    Q.howto(spark).where("query_id = 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(Q.howto(spark).schema).parquet(str(tmp_path / "in"))
    q = live.rerank_stream(stream, lambda b: rerank(b, Options(policy_id="howto_plumbing_v1")), lambda df, n: df.select("original_index", "rank").write.mode("overwrite").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert [r["original_index"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("rank").collect()][:2] == [0, 2]


def test_memo_and_validate(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert stateful.memoised(rows, "k")[0].count() == 2
    v = retrieve.validate(spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "query_id int, text string"), most=1).collect()
    assert {r["query_id"]: r["status"] for r in v} == {1: 413, 2: 422}
    assert T.word_pattern(["a b"]).endswith(r"(?:a b)(?![\p{L}\p{N}_])") and Policy().tier_a == []


def test_options_from_the_session(spark):
    spark.conf.set("lumenrank.skip_ambiguous", "no")
    spark.conf.set("lumenrank.fine_top_k", "3")
    try:
        got = Options.from_conf(spark, top_n=2, policy_id=None)
        assert (got.skip_ambiguous, got.fine_top_k, got.top_n, got.policy_id) == (False, 3, 2, None)
    finally:
        spark.conf.unset("lumenrank.skip_ambiguous")
        spark.conf.unset("lumenrank.fine_top_k")


def test_command_line(spark, capsys):
    from lumenrank.__main__ import main

    main(["demo", "--policy", "howto_plumbing_v1", "--top-n", "1", "--report"])
    assert "item=shower+" in capsys.readouterr().out
    main(["demo", "--query", "how to fix a leaky shower", "--policy", "howto_plumbing_v1", "--top-n", "2", "--explain", "--show-facts"])
    out = capsys.readouterr().out
    assert '"query":"how to fix a leaky shower"' in out and '"same_item":true' in out and "reason" in out
    main(["demo", "--eval", "--policy", "howto_plumbing_v1"])
    assert "recall_all" in capsys.readouterr().out


def test_row_helpers(spark):
    rows = spark.createDataFrame([(1, None, 80, 0.8, True, 12.7), (2, "empty_output", None, None, True, None), (3, None, None, 0.415, False, 3.0), (4, None, None, None, False, None)], "i int, tie_breaker_error string, fine_score int, fine_score_norm double, tie_breaker_used boolean, tie_breaker_latency_ms double")
    assert [r["tie_info"] for r in evaluate.tie_info(rows).orderBy("i").collect()] == ["80% (12ms)", "ERR(empty_output)", "42% (3ms)", None]
    rows = spark.createDataFrame([(None, True, 0.0, None), (None, False, 1.0, None), (None, False, 0.0, "item_mismatch"), (None, False, 0.0, "other"), ("KEEP_LOW_SIGNAL", False, 0.0, None)], "d string, f boolean, s double, z string")
    got = rows.select(rank.decision_of(*[F.col(c) for c in "dfsz"]).alias("x")).collect()
    assert [r["x"] for r in got] == ["ACCEPT", "ACCEPT", "REJECT_TIER_0", "REJECT_TIER_9", "KEEP_LOW_SIGNAL"]
    rows = spark.createDataFrame([(1, 2.0, None), (1, 1.0, None), (1, 1.0, 0.9), (2, 0.0, None)], "query_id int, score double, score_norm double")
    assert sorted(str(r["norm"]) for r in rank.client_score_norm(rows).collect()) == ["0.5", "0.9", "1.0", "None"]
    fine = spark.createDataFrame([("empty_output", 1, False), ("percent_retry_parse:x", 2, False), ("fine_score_timeout", 1, False), (None, 0, True), ("skipped_total_budget", 0, False)], "error string, attempts int, cached boolean")
    assert score.fine_metrics(fine).first().asDict() == {"requested": 5, "cache_hits": 1, "parse_errors": 1, "retries": 1, "retry_errors": 1, "timeouts": 1, "skipped_budget": 1, "circuit_open": 0, "empty": 1}
