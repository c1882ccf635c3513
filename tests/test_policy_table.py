"""Policies as rows, and dictionaries of terms."""

import random
import re

from pyspark.sql import functions as F

from lumenrank.functions import facts as A
from lumenrank.functions import prompts
from lumenrank.functions import text as T
from lumenrank.functions.dictionary import found
from lumenrank.operators import rank, score
from lumenrank.plans.api import Options, rerank
from lumenrank.queries import CORPUS_POLICY, corpus_mixed, howto, plumbing
from lumenrank.sources import policy_table as PT
from lumenrank.sources.policies import Policy, PolicyStore


def test_terms_of_any_kind_are_found(spark):
    rng = random.Random(1)
    parts = ["tap", "Faucet", "o", "ring", "oil", "change", "élan", "x_1", "2"]
    terms = {rng.choice(["", " ", "-", "'"]).join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"c++", ".net", "plumber's tape", "O-Ring"}
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "-", "  ", "'", "", ". ", "_"]) for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", "C++ and .NET, a plumber's tape; O-RING", "c++x x.net", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: set(r["f"]) for r in rows.select("i", found(F.col("t"), terms).alias("f")).collect()}
    for i, t in enumerate(texts):
        want = {x.lower() for x in terms if re.search(rf"(?i)(?<!\w){re.escape(x)}(?!\w)", t or "")}
        assert got[i] == want, t
    assert rows.select(found(F.col("t"), []).alias("f")).where(F.size("f") > 0).count() == 0


def test_a_text_costs_the_same_for_any_number_of_terms(spark):
    few, many = ([f"term{i} of {i}" for i in range(n)] + [f"word{i}" for i in range(n)] for n in (10, 10_000))
    plan = lambda terms: spark.range(1).select(found(F.concat(F.lit("word3 term7 of 7 "), F.col("id").cast("string")), terms).alias("f"))
    assert plan(few).first() == plan(many).first() and set(plan(few).first()["f"]) == {"word3", "term7 of 7"}


def invented(n):
    rng = random.Random(n)
    words = ["leak", "faucet", "tire", "chain", "brake", "oil", "shower", "valve", "how", "seasonal"]
    pick = lambda k: rng.sample(words, k)
    return [Policy(name=f"p{i}", synonyms={pick(1)[0]: pick(2)}, item_rules={w: [w, *pick(1)] for w in pick(2)}, tier_a_keywords=pick(3), domain_keywords=pick(rng.randint(0, 3)), ambiguous_triggers=pick(rng.randint(0, 2))) for i in range(n)]


OUT = ["query_id", "original_index", "policy_id", "tier", "mode", "decision", "zero_reason", "rank_score", "score", "policy_rank"]


def routed(spark, policies, rows, name):
    table, words = PT.policy_table(spark, policies)
    return rank.gated(score.score(score.prepare(PT.with_policy(rows, name, table), words), words), words).select(*OUT)


def test_policies_as_rows_equal_a_plan_for_each(spark):
    policies = [*invented(7), plumbing(), CORPUS_POLICY, corpus_mixed(), Policy(name="nothing")]
    base = howto(spark)
    rows = spark.range(len(policies)).crossJoin(base).withColumn("query_id", F.col("id") * 100 + F.col("query_id")).drop("id").cache()
    name = F.element_at(F.array(*[F.lit(p.name) for p in policies]), F.floor(F.col("query_id") / 100).cast("int") + 1)
    got = sorted(map(tuple, routed(spark, policies, rows, name).collect()), key=str)
    want = []
    for i, p in enumerate(policies):
        mine = rows.where(F.floor(F.col("query_id") / 100) == i)
        want += map(tuple, rank.gated(score.score(score.prepare(mine, p), p), p).select(*OUT).collect())
    assert len(got) == len(policies) * base.count() and got == sorted(want, key=str)


def test_the_plan_is_the_same_for_any_number_of_policies(spark, monkeypatch):
    shape = lambda df: re.findall(r"(\w+)Exec|(Exchange|Join|Scan|Window|Generate)", df._jdf.queryExecution().executedPlan().toString())
    some, many = (routed(spark, invented(n), howto(spark), F.concat(F.lit("p"), F.pmod("query_id", F.lit(2)))) for n in (3, 500))
    assert shape(some) == shape(many) and "BroadcastHashJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert many.count() == some.count() == 40
    monkeypatch.setattr(PT, "BROADCAST_BYTES", 10)
    table, _ = PT.policy_table(spark, invented(3))
    assert "ResolvedHint" not in table._jdf.queryExecution().analyzed().toString() and routed(spark, invented(3), howto(spark), F.lit("p1")).count() == 40


def test_rows_may_ask_for_their_policies(spark):
    rows = howto(spark)
    asked = rows.withColumn("policy_id", F.when(F.col("query_id") == 1, "howto_bicycle_v1").when(F.col("query_id") == 2, "no such one"))
    own = {r["query_id"]: r["policy_id"] for r in rerank(asked, Options()).select("query_id", "policy_id").distinct().collect()}
    free = {r["query_id"]: r["policy_id"] for r in rerank(rows, Options()).select("query_id", "policy_id").distinct().collect()}
    assert own[1] == "howto_bicycle_v1" and {q: own[q] for q in own if q != 1} == {q: free[q] for q in free if q != 1} and free[1] == "howto_plumbing_v1"
    assert set(free.values()) <= set(PolicyStore().policies)


def test_examples_carry_their_facts(spark):
    p = Policy(name="p", item_rules={"faucet": ["tap"]}, few_shot=[{"query": "fix a tap leak", "doc": "Tap: turn off the water.", "score": 3}, {"query": "chain", "doc": "nothing", "score": 0}])
    said = prompts.examples(spark, [p, Policy(name="none")])
    assert said["none"] == "" and said["p"].count("EXAMPLE") == 2
    first = said["p"].split("---\n")[0]
    facts = spark.range(1).select(prompts.compact_json(A.identity(F.lit("fix a tap leak"), F.lit("Tap: turn off the water."), p)).alias("f")).first()["f"]
    assert f"FACTS: {facts}\n" in first and '"same_item":true' in facts and first.index("DOCUMENT") < first.index("FACTS") < first.index("OUTPUT")
    row = spark.createDataFrame([("q", "d")], "query string, text string").select(prompts.bucket_prompt(F.col("query"), T.text(F.col("text")), A.identity(F.col("query"), F.col("text"), p), said["p"]).alias("x")).first()["x"]
    assert said["p"] in row and row.endswith("OUTPUT:")
