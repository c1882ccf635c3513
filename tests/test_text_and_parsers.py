import pytest
from pyspark.sql import functions as F

from lumenrank import fixtures as X
from lumenrank.functions import facts as A
from lumenrank.functions import parsers as P
from lumenrank.functions import prompts
from lumenrank.functions import signals as S
from lumenrank.functions import text as T
from lumenrank.sources.policies import Policy, PolicyStore, load, normalise, parse_yaml, plugin


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_parse_bucket_goldens(spark):
    rows = spark.createDataFrame(list(enumerate(X.BUCKET_OUTPUTS)), "id int, raw string").select("id", P.parse_bucket(F.col("raw")).alias("b")).orderBy("id").collect()
    assert [r["b"] for r in rows] == X.BUCKETS


def test_parse_fine_goldens(spark):
    rows = spark.createDataFrame(list(enumerate(X.FINE_OUTPUTS)), "id int, raw string").select("id", P.parse_fine(F.col("raw")).alias("p")).orderBy("id").collect()
    assert [r["p"]["score"] for r in rows] == X.FINES
    assert [r["p"]["error"] for r in rows] == X.FINE_ERRORS


def test_parse_numbers_of_any_size_and_json_only_where_braces_are(spark):
    raws = ["score: 9999999999", "12345678901 %", '{"score": 1e30}', "-99999999999", "7 99999999999999999999999", "0" * 30 + "7", "{" * 20_000, "{} score: 3", "'10'", None]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string").orderBy("id")
    got = df.select(P.parse_fine(F.col("raw")).alias("p"), P.parse_bucket(F.col("raw")).alias("b")).collect()
    assert [(r["p"]["score"], r["b"]) for r in got] == [(100, None), (100, None), (100, 3), (0, None), (100, 2), (7, 2), (None, None), (3, 1), (10, 3), (None, None)]
    for parse in (P.parse_fine, P.parse_bucket):
        assert df.select(parse(F.col("raw"))).columns[0].count("try_parse_json") == 1


def test_fallback_and_scale(spark):
    for fit, sim, want in X.FALLBACKS:
        assert one(spark, x=P.fallback_fine(F.lit(fit).cast("double"), F.lit(sim)))["x"] == want
    got = one(spark, a=P.parse_legacy_scale(F.lit('{"score": 7}')), b=P.parse_legacy_scale(F.lit("score: 10")), c=P.parse_legacy_scale(F.lit("maybe 3?")), d=P.parse_legacy_scale(F.lit("")), e=P.parse_legacy_scale(F.lit("5")))
    assert [tuple(got[c]) for c in "abcde"] == [(7, "json"), (10, "score_tag"), (3, "bare_token"), (None, "empty_output"), (None, "no_match")]
    assert [one(spark, x=P.few_shot_bucket(F.lit(s)))["x"] for s in (0, 1, 2, 3, 5, 7, 10)] == [0, 1, 2, 3, 1, 2, 3]


def test_response_shapes(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(X.REPLIES)], "id int, raw string").select("id", P.response_text(F.col("raw")).alias("a")).orderBy("id").collect()
    assert [r["a"] for r in rows] == [a for _, a in X.REPLIES]


def test_stems_and_tokens(spark):
    stems = {"leaking": "leak", "pipes": "pip", "brakes": "brak", "is": "is", "bed": "bed", "cars": "car", "sing": "sing"}
    for w, want in stems.items():
        assert one(spark, x=T.stem(F.lit(w)))["x"] == want, w
    got = one(spark, a=T.tokens_alnum(F.lit("How to fix the O-Ring 12ab x")), b=T.tokens_word(F.lit("Don't use an O-ring--now")), c=T.tokens_letters(F.lit("A b a")), d=T.tokens_alnum(F.lit(None).cast("string")))
    assert got["a"] == ["fix", "ring", "12ab"] and got["b"] == ["don't", "use", "an", "o-ring", "now"] and got["c"] == ["a", "b"] and got["d"] == []
    assert one(spark, x=T.keyword_set(F.lit("dripping leaks"), {"drip": "leak"}))["x"] == ["dripp", "leak"]
    assert sorted(one(spark, x=T.keyword_set(F.lit("leaks"), {}, {"leak": ["seep"]}))["x"]) == ["leak", "seep"]


def test_formatters(spark):
    long = "x" * 900
    got = one(spark, t=T.trim_middle(F.lit(long)), s=T.snippet(F.lit(" a\nb ")), c=T.snippet(F.lit(long)), m=T.match_flag(F.lit(None).cast("boolean")), n=T.loose_number(F.lit("score 2")), z=T.loose_number(F.lit("none")), k=T.truncate(F.lit("éab"), 2))
    assert got["t"] == "x" * 600 + " [...] " + "x" * 200 and got["s"] == "a b" and got["c"] == "x" * 77 + "..." and got["m"] == "?" and got["n"] == 2.0 and got["z"] == float("-inf") and got["k"] == "éa"


def test_step_bullets_only_after_line_feeds(spark):
    got = {r["id"]: r for r in spark.createDataFrame(X.STEPS, "id int, text string").select("id", S.step_bullets(F.col("text")).alias("b"), S.distinct_verbs(F.col("text")).alias("v"), S.separators(F.col("text")).alias("s"), S.procedure_signal(F.col("text")).alias("p")).collect()}
    assert [got[1][c] for c in "bvs"] == [3, 4, 4] and got[2]["b"] == 1 and got[5]["p"] == 0 and got[6]["v"] == 2 and got[6]["s"] > 8 and got[6]["p"] == 4 + 8


def test_whole_words_know_accents(spark):
    got = one(spark, a=T.matches_any(F.lit("écar"), ["car"]), b=T.matches_any(F.lit("a Car."), ["car"]), c=T.matches_any(F.lit("shower head"), ["shower head"]), d=T.matches_any(F.lit("x"), []))
    assert (got["a"], got["b"], got["c"], got["d"]) == (False, True, True, False)


def test_domains(spark):
    got = one(spark, a=A.generic_domain(F.lit("shower and car")), b=A.generic_domain(F.lit("nothing")), c=A.generic_domain(F.lit("shower valve car")), d=A.client_domain(F.lit("carpet")), e=A.infer_domain(F.lit("water heater")), f=A.domain_hits(F.lit("water heater tub")), g=A.infer_domain(F.lit("my car"), negative={"automotive": ["my"]}))
    assert (got["a"], got["b"], got["c"], got["d"], got["e"]) == ("ambiguous", "unknown", "plumbing", "automotive", "plumbing")
    assert got["f"] == {"plumbing": 3} and got["g"] is None


def test_ambiguity(spark):
    yes, reason = A.ambiguous_client(F.col("q"))
    rows = spark.createDataFrame([("",), ("help",), ("car",), ("car car",), ("fix car",)], "q string").select("q", yes.alias("y"), reason.alias("r"), A.ambiguous_generic(F.col("q")).alias("g"), A.ambiguous_gated(F.col("q"), Policy(ambiguous_triggers=["fix"])).alias("t")).collect()
    assert [(r["y"], r["r"], r["g"], r["t"]) for r in rows] == [(True, "empty", True, True), (True, "trigger", True, True), (True, "too_short", True, True), (True, "too_short", True, True), (False, None, False, True)]


YAML = """# policy
name: p
scale: [0, 3, 7, 10]
rubric: |
  one: two
  three
item_gating_rules:
  faucet:
    must_match_any: ["Faucet", "tap"]
    neg_if_doc_has: ["tub"]
synonyms:
  leak: ["drip"]
tier_a_keywords:
  - leak
  - o-ring
few_shot:
  - query: "q: 1"
    doc: 'd'
    score: 10
caps: []
"""


def test_policy_shapes():
    p = normalise(parse_yaml(YAML))
    assert p.name == "p" and p.item_aliases == {"faucet": ["faucet", "tap"]} and p.synonym_map == {"leak": "leak", "drip": "leak"} and p.tier_a == ["leak", "o-ring"]
    assert p.few_shot == [{"query": "q: 1", "doc": "d", "score": 10}] and set(p.inert) == {"scale", "rubric", "caps"} and p.inert["rubric"] == "one: two\nthree\n"
    rule = {"must_match_any": ["tap"]}
    shapes = [{"item_gating_rules": {"Faucet": rule}}, {"item_gating_rules": [{"Faucet": rule}]}, {"item_gating_rules": [{"Faucet": [rule]}]}]
    assert all(normalise(s).item_rules == {"faucet": ["tap"]} for s in shapes)
    assert normalise({"object_groups": [{"Car": ["auto"]}]}).item_rules == {"car": ["auto"]}
    assert normalise({"synonyms": [{"A": "b"}]}).synonyms == {"a": ["b"]}


def test_policy_store(tmp_path):
    (tmp_path / "b.json").write_text('{"name": "x", "tier_a_keywords": ["one"]}')
    (tmp_path / "c.yaml").write_text("name: x\ntier_a_keywords:\n  - two\n")
    store = PolicyStore(tmp_path)
    assert store.select("x").tier_a == ["two"] and store.default == "x" and not store.refresh()
    (tmp_path / "d.yaml").write_text("name: howto_car_v1\n")
    assert store.select(None, "car").name == "howto_car_v1" and store.select("none").name == "x"
    assert load(tmp_path / "b.json").tier_a == ["one"]
    with pytest.raises(RuntimeError):
        (tmp_path / "empty").mkdir()
        PolicyStore(tmp_path / "empty")


def test_plugins():
    assert [plugin(p) for p in (None, "howto_x_v1", "generic_v1", "generic", "legacy_demo_v1")] == ["gated", "gated", "generic", "generic", "gated"]
    with pytest.raises(ValueError):
        plugin("other")


def test_registered_rankings(spark):
    from lumenrank.operators import rank
    from lumenrank.plans.api import Options, rerank

    backwards = rank.Ranking(lambda rows, policy: rank.generic(rows).withColumns({"tier": F.lit(0), "decision": F.lit("ACCEPT"), "rank_score": F.col("request_index").cast("double"), "policy_id": F.lit("backwards")}), own_words=False)
    rank.register("backwards", backwards, ("backwards_v2",))
    with pytest.raises(ValueError):
        rank.register("generic", backwards)
    rows = spark.createDataFrame([(1, "q", i, i, "text", 0.5) for i in range(3)], "query_id long, query string, request_index int, original_index long, text string, similarity double")
    for name in ("backwards", "backwards_v2", "backwards_v1"):
        got = rerank(rows, Options(policy_id=name)).orderBy("rank").collect()
        assert [r["original_index"] for r in got] == [2, 1, 0] and got[0]["policy_id"] == "backwards"


def test_prompts_keep_nulls(spark):
    p = Policy(few_shot=[{"query": "q", "doc": "d", "score": 10}])
    facts = A.identity(F.lit("q"), F.lit("d"), p)
    got = one(spark, b=prompts.bucket_prompt(F.lit("q?"), F.lit("doc"), facts, p), r=prompts.retry_prompt(facts), k=prompts.cache_key("m", F.lit("d"), F.lit("q")))
    assert '"query_item":null' in got["b"] and '"score": 3' in got["b"] and "doc" not in got["r"].split("FACTS")[0] and got["k"].startswith("m:") and len(got["k"]) == 2 + 40 * 3 + 2


def test_signals_are_the_same_from_given_tokens_and_long_blanks_cost_no_more(spark):
    blank = " \t" * 500_000
    texts = [None, "", blank, blank + "Steps: remove the filters, turn the valve." + blank, "1. Open the valves; 2. tighten the gaskets", "İstanbul valve O-Ring"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    alone = rows.select("i", T.strip(F.col("text")).alias("s"), S.gated_quality(F.col("text")).alias("q"))
    alone = alone.select("*", S.kind_gated(F.col("s"), F.col("q")).alias("k")).orderBy("i").collect()
    shared = S.with_quality(rows).orderBy("i").collect()
    assert [r["s"] for r in alone] == [(t or "").strip(" \t") for t in texts]
    assert [r["q"] for r in alone] == [r["q"] for r in shared]
    assert [r["q"]["part_terms"] > 0 for r in alone] == [False, False, False, True, True, True]
    assert [r["k"] for r in alone[:3]] == ["UNKNOWN"] * 3


def test_words_made_once_say_what_each_text_says(spark):
    """Signals from the shared words of a text against those that read it themselves, on texts where the forms of words differ."""
    from lumenrank.functions import dictionary as D
    from lumenrank.functions import facts as A
    from lumenrank.functions import signals as S
    from lumenrank.functions import vocab as V

    texts = [
        None, "", "Check the o-ring, don't OPEN it. Fix1 fix 1fix", "check_valve open_ _close replace2 re-install", "Kheck Kiosk sKip the routine", "İnspect the İnterval schedule", "éopen opén cleané run",
        "1. Turn off\n2. Drain water in 1999 1.", "schedule maintenance tires 2024 then clean, clean; repair", "ſrun café_car engine water heater tubs",
    ]
    t, said = F.col("text"), F.col("said")
    rows = T.computed(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string"), said=D.whole_words(t))
    rows = S.with_quality(rows)
    low, words, hits = F.col("_low"), F.col("_words"), F.col("_hits")
    query = F.lit("fix the o-ring routine kiosk skip open clean car")
    same = [
        (S.distinct_verbs(t), S.distinct_verbs(t, said)), (S.procedure_signal(t), S.procedure_signal(t, said)), (T.keyword_set(t, {}), T.keyword_set(t, {}, said=said)), (S.gated_quality(t), F.col("q")),
        (F.array_distinct(F.transform(T.tokens_alnum(t), lambda x: T.canonical(x, {}))), T.keyword_set(t, {}, said=said)), (T.tokens_word(F.lower(T.text(t))), words),
        (D.found(t, A.terms_of(V.DOMAIN_RULES)), D.found(t, A.terms_of(V.DOMAIN_RULES), said)), (S.kind_gated(t, F.col("q")), S.kind_gated(t, F.col("q"), hits, low)), (S.kind_generic(t, F.col("q")), S.kind_generic(t, F.col("q"), hits, low)),
        (S.action_score(t, F.col("q")), S.action_score(t, F.col("q"), hits)), (T.overlap_count(query, t), T.overlap_count(query, t, F.when(T.same_in_lower(t), words).otherwise(T.tokens_word(t)))),
        (A.generic_domain(t), A.generic_domain(t, tokens=words)), (S.quality_signals(t), S.quality_signals(t, words, low, hits)),
    ]
    got = rows.select("id", *[c.alias(f"{side}{i}") for i, pair in enumerate(same) for side, c in zip("ab", pair, strict=True)]).collect()
    assert len(got) == len(texts)
    for r in got:
        for i in range(len(same)):
            assert r[f"a{i}"] == r[f"b{i}"], (texts[r["id"]], i)
    assert [r["b0"] for r in got][:4] == [0, 0, 2, 1]


def test_texts_are_read_once_for_the_final_order(spark, sf_dir):
    from lumenrank import queries

    assert not any("documents" in f for f in queries.corpus_final(spark, sf_dir).inputFiles())


def test_cosines_take_little_beside_their_tile():
    import tracemalloc

    import numpy as np

    from lumenrank.operators import retrieve

    rng = np.random.default_rng(1)
    q, m = rng.normal(size=(512, 16)), rng.normal(size=(4096, 16))
    q[3], m[5], m[6, 0] = 0, 0, np.nan
    size, norms = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(m, axis=1)
    tracemalloc.start()
    got = retrieve._cosines(q, m, size, norms)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    with np.errstate(divide="ignore", invalid="ignore"):
        want = (q @ m.T) / (size * norms[None])
    assert (got == np.where(np.isfinite(want), want, retrieve.NO_COSINE)).all() and peak < 1.5 * got.nbytes
    assert (retrieve._cosines(q[:, :3], m, size, norms) == retrieve.NO_COSINE).all()
