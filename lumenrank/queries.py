"""The registered queries of the retrieval and reranking operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import facts as A
from .functions import parsers as P
from .functions import prompts
from .functions import signals as S
from .functions import text as T
from .functions.dictionary import found
from .operators import evaluate, fallback, ordered, rank, retrieve, score, stateful
from .operators.tables import stored
from .plans.api import Options, fine_pass, rerank
from .sources.corpora import relevance_rows, responses
from .sources.policies import Policy, PolicyStore
from .sources.policy_table import COLUMNS, policy_table, with_policy

Query = Callable[[SparkSession, str], DataFrame]

#: A policy over words that the generated documents have.
CORPUS_POLICY = Policy(
    name="corpus", synonyms={"the": ["then"], "tion": ["tions", "nt"], "in": ["inn"]}, tier_a_keywords=["tion", "nder", "ther"], tier_b_keywords=["from", "than"], domain_keywords=["tion", "from", "ther", "and", "ble"],
    ambiguous_triggers=["than"], item_rules={"mill": ["tion", "nt"], "gate": ["than", "from"]},
)
CORPUS_DOMAINS = [("alpha", ["tion", "from", "ing"]), ("beta", ["ther", "ble", "erin"]), ("gamma", ["than", "then", "thing"])]
#: Ambiguous queries of the how-to corpus: one word, a trigger among others, no word at all.
ASKED = [(5, "faucet"), (6, "seasonal plumbing jobs"), (7, "?"), (8, "engine")]
BREAKER = ("1 hour", 5)
TTL = {"event_type": 900, "user_id": 26_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col) -> object:
    return F.round(col, 6)


def howto(spark: SparkSession) -> DataFrame:
    """The invented corpus as request rows of every query."""
    docs = [(i, o, t, s) for i, (o, s, t) in enumerate(X.CORPUS)]
    rows = [(q, text, *d) for q, text in X.QUERIES for d in docs]
    return spark.createDataFrame(rows, "query_id long, query string, request_index int, original_index long, text string, similarity double")


def plumbing() -> Policy:
    return PolicyStore().select("howto_plumbing_v1")


def corpus_mixed() -> Policy:
    """The plumbing policy with the corpus policy's words and items, and with triggers."""
    a, b = plumbing(), CORPUS_POLICY
    return Policy(
        name="corpus_mixed", synonyms=a.synonyms | b.synonyms, item_rules=a.item_rules | b.item_rules, tier_a_keywords=a.tier_a_keywords + b.tier_a_keywords, tier_b_keywords=a.tier_b_keywords + b.tier_b_keywords,
        domain_keywords=a.domain_keywords + b.domain_keywords, ambiguous_triggers=[*b.ambiguous_triggers, "seasonal"],
    )


def _retrieved(spark: SparkSession, d: str, asked: str = "vec_id % 20 = 0") -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where(asked).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.top_k(q, e, 10, doc_id="vec_id", keep=["label"], exclude_same_id=True)


def _neighbours(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.col("doc_id").alias("vec_id"), r6("sim").alias("sim"), "rank", "label")


def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(_retrieved(spark, d))


def topk_cosine_all(spark: SparkSession, d: str) -> DataFrame:
    """Every vector is a query, here and in the other queries named _all."""
    return _neighbours(_retrieved(spark, d, "true"))


def _metrics(spark: SparkSession, d: str, asked: str = "vec_id % 20 = 0") -> DataFrame:
    """Metrics of the queries from counts per label: pairs of equal label would be a square of the rows."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return evaluate.label_metrics(_retrieved(spark, d, asked), e).where(asked.replace("vec_id", "query_id"))


METRICS = ("acc1", "mrr", "recall_any", "recall_all")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query_id", *[r6(c).alias(c) for c in METRICS])


def retrieval_metrics_all(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d, "true").select("query_id", *[r6(c).alias(c) for c in METRICS])


def retrieval_average(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.average(_metrics(spark, d)).select("queries", *[r6(c).alias(c) for c in METRICS])


def retrieval_average_all(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.average(_metrics(spark, d, "true")).select("queries", *[r6(c).alias(c) for c in METRICS])


def _diverse(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("sim", r6("sim")).withColumnRenamed("rank", "retrieval_rank")
    return fallback.diversified(rows, "sim", "label", ["retrieval_rank"]).select("query_id", F.col("doc_id").alias("vec_id"), "label", "is_head", "rank")


def diversified_topk(spark: SparkSession, d: str) -> DataFrame:
    return _diverse(_retrieved(spark, d))


def diversified_topk_all(spark: SparkSession, d: str) -> DataFrame:
    return _diverse(_retrieved(spark, d, "true"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Documents as requests, one per source; a source may hold a third of all documents."""
    docs = table(spark, d, "documents")
    sim = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 97) / 97.0)
    rows = docs.select(F.col("source").alias("query_id"), F.col("source").alias("query"), F.col("doc_id").alias("original_index"), "text", sim.alias("similarity"))
    return ordered.exact_rank(rows, ["original_index"], ["query_id"], "request_index").withColumn("request_index", (F.col("request_index") - 1).cast("int"))


def missing_sim_default(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.default_similarity(_requests(spark, d)).select("query_id", "original_index", r6("similarity").alias("similarity"))


def truncate_usage(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.usage(_requests(spark, d))


def request_status(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.validate(_requests(spark, d), most=50)


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = _requests(spark, d).withColumn("original_index", F.col("original_index") % 7)
    return retrieve.last_of(rows).select("query_id", "original_index", "request_index")


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.truncate(t, 512).alias("truncated"), T.trim_middle(t).alias("trimmed"), T.snippet(t).alias("snippet"), T.match_flag(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 1)).alias("flag"))


def loose_numbers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.coalesce(F.nullif(T.loose_number(F.get_json_object("props", "$.k")), F.lit(float("-inf"))), F.lit(-1.0)).alias("k"), F.coalesce(F.nullif(T.loose_number(F.col("event_type")), F.lit(float("-inf"))), F.lit(-1.0)).alias("kind"))


def keyword_sets(spark: SparkSession, d: str) -> DataFrame:
    t, syn = F.col("text"), CORPUS_POLICY.synonym_map
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens_alnum(t)).alias("tokens"), F.array_join(F.array_sort(T.keyword_set(t, syn)), " ").alias("keywords"), F.size(T.tokens_letters(t)).alias("letters"))


def quality_signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.quality_signals(F.col("text")).alias("s")).select("doc_id", "s.*")


def _with_howto(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([(-1 - o, t) for o, _, t in X.CORPUS], "doc_id long, text string")
    return table(spark, d, "documents").select("doc_id", "text").unionByName(extra)


def gated_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = S.with_quality(_with_howto(spark, d))
    return rows.select("doc_id", "q.part_terms", "q.procedural", r6("q.quality_score").alias("quality_score"), r6(S.action_score(F.col("text"), F.col("q"))).alias("action_score"))


def doc_kinds(spark: SparkSession, d: str) -> DataFrame:
    t, q, w, n, low = F.col("text"), F.col("q"), F.col("_words"), F.col("letters"), F.col("low")
    rows = T.computed(S.with_quality(_with_howto(spark, d)), letters=T.tokens_letters(t), low=F.lower(T.text(t)))
    return rows.select("doc_id", S.kind_gated(t, q, w, low).alias("gated"), S.kind_generic(t, q, w, low).alias("generic"), S.kind_client(t, n, low).alias("client"), r6(S.lexical_bonus(t, n)).alias("bonus"))


def query_intents(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([(-q, 0, t) for q, t in X.QUERIES], "conv_id long, turn long, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text").unionByName(extra)
    t = F.col("text")
    rows = rows.select("conv_id", "turn", S.query_intent(t).alias("intent"), S.client_intent(t).alias("client_intent"), S.is_howto(t).alias("howto"), A.ambiguous_generic(t).alias("ambiguous"), A.ambiguous_gated(t, CORPUS_POLICY).alias("triggered"), S.kind_client(t).alias("kind"))
    return rows.withColumns({"fit": r6(S.fit_gated(F.col("intent"), F.col("kind"))), "client_fit": r6(S.fit_client(F.col("client_intent"), F.col("kind")))})


def procedure_signals(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([(-i, t) for i, t in X.STEPS], "doc_id long, text string")
    t = F.col("text")
    rows = table(spark, d, "documents").select("doc_id", "text").unionByName(extra)
    return rows.select("doc_id", S.step_bullets(t).alias("bullets"), S.distinct_verbs(t).alias("verbs"), S.separators(t).alias("separators"), S.procedure_signal(t).alias("signal"))


def items_of(benchmark: DataFrame):
    """One more than the largest item id, as a scalar subquery (null for an empty table)."""
    return benchmark.agg(F.max("item_id") + 1).scalar()


def keyword_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Every document with one benchmark item as its query."""
    b = table(spark, d, "benchmark")
    n = items_of(b)
    rows = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % n).join(b.select("item_id", F.col("text").alias("query")), "item_id")
    q, t = F.col("query_keys"), F.col("doc_keys")
    rows = score.keyword_sets(rows, CORPUS_POLICY)
    return rows.select("doc_id", score.overlap_tier(q, t, CORPUS_POLICY).alias("tier"), score.domain_gate(q, t, CORPUS_POLICY).alias("allowed"), T.overlap_count(F.col("query"), F.col("text")).alias("overlap"))


def domain_detect(spark: SparkSession, d: str) -> DataFrame:
    t, have = F.col("text"), F.col("have")
    rows = T.computed(table(spark, d, "documents"), have=found(t, A.terms_of(CORPUS_DOMAINS)))
    rows = T.computed(rows, hits=A.domain_hits(t, CORPUS_DOMAINS, have), inferred=A.infer_domain(t, CORPUS_DOMAINS, have=have), generic=A.generic_domain(t, CORPUS_DOMAINS))
    return rows.select(
        "doc_id", "generic", A.client_domain(t, CORPUS_DOMAINS).alias("client"), F.coalesce(A.choose_domain(F.col("hits"), CORPUS_DOMAINS), F.lit("-")).alias("chosen"),
        F.coalesce("inferred", F.lit("-")).alias("inferred"), F.array_join(A.items(t, CORPUS_POLICY), ",").alias("items"),
    )


def _facts(spark: SparkSession) -> DataFrame:
    return score.prepare(howto(spark), plumbing())


def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a candidate of one benchmark item (each fourth asks with its first word alone), and the how-to
    corpus as candidates of its own and of ambiguous queries; some without similarity."""
    from pyspark.sql import Window

    b = table(spark, d, "benchmark")
    n = items_of(b)
    text, id_ = F.col("b.text"), F.col("b.item_id")
    pairs = table(spark, d, "documents").alias("d").join(b.alias("b"), F.col("d.doc_id") % n == id_)
    place = (F.row_number().over(Window.partitionBy(id_).orderBy("d.doc_id")) - 1).alias("request_index")
    sim = F.when(F.col("d.doc_id") % 3 != 0, (F.col("d.doc_id") % 97) / 97.0).alias("similarity")
    pairs = pairs.select(id_.cast("long").alias("query_id"), F.when(id_ % 4 == 0, F.regexp_extract(text, "[a-zA-Z]+", 0)).otherwise(text).alias("query"), place, F.col("d.doc_id").alias("original_index"), F.col("d.text").alias("text"), sim)
    extra = [(-q, asked, i, -1 - o, doc, sim if i % 3 else None) for q, asked in [*X.QUERIES, *ASKED] for i, (o, sim, doc) in enumerate(X.CORPUS)]
    return pairs.unionByName(spark.createDataFrame(extra, "query_id long, query string, request_index int, original_index long, text string, similarity double"))


def _corpus_gated(spark: SparkSession, d: str) -> DataFrame:
    p = corpus_mixed()
    return rank.gated(score.score(score.prepare(corpus_rows(spark, d), p), p), p)


def _corpus_final(spark: SparkSession, d: str) -> DataFrame:
    got = stored(_corpus_gated(spark, d), "gated")  # read twice: for the candidates and for their scores
    said = F.element_at(F.array(*[F.lit(x) for x in ("77", "{bad}", "FINE_SCORE: 41%", "0.66", "")]), (F.abs("original_index") % 5 + 1).cast("int"))
    outputs = score.fine_candidates(got).select("query_id", "original_index", said.alias("raw"), F.lit(None).cast("string").alias("error"))
    return rank.final_order(score.merge_fine(got, outputs))


def corpus_gated(spark: SparkSession, d: str) -> DataFrame:
    return _gated_columns(_corpus_gated(spark, d), "mode")


def corpus_policies() -> list[Policy]:
    return [corpus_mixed(), CORPUS_POLICY, plumbing()]


def corpus_routed(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a candidate, each query under one of several policies that are joined as data."""
    policies = corpus_policies()
    words, columns = policy_table(spark, policies)
    name = F.element_at(F.array(*[F.lit(p.name) for p in policies]), (F.pmod("query_id", F.lit(len(policies))) + 1).cast("int"))
    rows = with_policy(corpus_rows(spark, d), name, words)
    got = rank.gated(score.score(score.prepare(rows, columns), columns), columns)
    return _gated_columns(got, "mode", "policy_id").drop(*COLUMNS)


def corpus_gate_stats(spark: SparkSession, d: str) -> DataFrame:
    return score.gate_stats(score.prepare(corpus_rows(spark, d), corpus_mixed()))


def corpus_identity(spark: SparkSession, d: str) -> DataFrame:
    return _identity_columns(score.prepare(corpus_rows(spark, d), corpus_mixed()))


def corpus_generic(spark: SparkSession, d: str) -> DataFrame:
    return _generic_columns(_generic(corpus_rows(spark, d), corpus_mixed()))


def corpus_final(spark: SparkSession, d: str) -> DataFrame:
    return _final_columns(_corpus_final(spark, d))


def corpus_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.breakdown(_corpus_gated(spark, d))


def corpus_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Counts alone: a query may reject more documents than one row can list."""
    return evaluate.reject_counts(_corpus_gated(spark, d))


def corpus_relevance(spark: SparkSession, d: str) -> DataFrame:
    return relevance_rows(_corpus_final(spark, d)).withColumn("relevance_score", r6("relevance_score"))


def identity_facts(spark: SparkSession, d: str) -> DataFrame:
    return _identity_columns(_facts(spark))


def _identity_columns(prepared: DataFrame) -> DataFrame:
    f = prepared.select("query_id", "original_index", "facts.*")
    names = ("query_item", "same_item", "same_domain", "query_domain", "doc_domain", "domain_match_doc", "domain_match_query")
    hits = F.aggregate(F.map_values("doc_domain_hits"), F.lit(0), lambda a, x: a + x)
    return f.select("query_id", "original_index", F.array_join("doc_items", ",").alias("doc_items"), *names, hits.alias("doc_hits"))


def gated_bucket(spark: SparkSession, d: str) -> DataFrame:
    got = score.score(_facts(spark), plumbing())
    return got.select("query_id", "original_index", "overlap_tier", "tie_breaker", F.coalesce("gate", F.lit("-")).alias("gate"), "bucket", rank.clamp(F.col("bucket"), F.col("facts")).cast("int").alias("clamped"))


def gate_stats(spark: SparkSession, d: str) -> DataFrame:
    return score.gate_stats(_facts(spark))


def _gated(spark: SparkSession) -> DataFrame:
    return rank.gated(score.score(_facts(spark), plumbing()), plumbing())


def _gated_columns(got: DataFrame, *more: str) -> DataFrame:
    return got.select("query_id", "original_index", *more, "tier", "decision", F.coalesce("zero_reason", F.lit("-")).alias("zero_reason"), "doc_kind", r6("intent_fit").alias("intent_fit"), r6("rank_score").alias("rank_score"), r6("score").alias("score"), r6("score_norm").alias("score_norm"), "policy_rank")


def gated_rank(spark: SparkSession, d: str) -> DataFrame:
    return _gated_columns(_gated(spark))


def _generic(rows: DataFrame, known: Policy) -> DataFrame:
    none = Policy(name="generic")
    facts = A.identity(F.col("query"), F.col("text"), known)
    return rank.generic(score.score(T.computed(score.prepare(rows, none, with_facts=False), facts=facts), none))


def generic_rank(spark: SparkSession, d: str) -> DataFrame:
    return _generic_columns(_generic(howto(spark), plumbing()))


def _generic_columns(got: DataFrame) -> DataFrame:
    return got.select("query_id", "original_index", "tier", "mode", "decision", F.coalesce("zero_reason", F.lit("-")).alias("zero_reason"), "doc_kind", "doc_domain", r6("intent_fit").alias("intent_fit"), r6("rank_score").alias("rank_score"), "policy_rank")


def _outputs(spark: SparkSession) -> DataFrame:
    """Recorded model outputs of a fine pass over the candidates: what the model said, by id."""
    said = {0: "77", 2: "{bad}", 4: "FINE_SCORE: 41%", 1: "0.66", 6: ""}
    return spark.createDataFrame([(q, o, t, None) for q, _ in X.QUERIES for o, t in said.items()], "query_id long, original_index long, raw string, error string")


def _final(spark: SparkSession) -> DataFrame:
    got = _gated(spark)
    asked = score.fine_candidates(got).select("query_id", "original_index")
    return rank.final_order(score.merge_fine(got, _outputs(spark).join(asked, ["query_id", "original_index"])))


def final_order(spark: SparkSession, d: str) -> DataFrame:
    return _final_columns(_final(spark))


def _final_columns(got: DataFrame) -> DataFrame:
    got = rank.client_order(got)
    return got.select("query_id", "original_index", "rank", "client_rank", F.coalesce("fine_score", F.lit(-1)).alias("fine_score"), "tie_breaker_used", F.coalesce("tie_breaker_error", F.lit("-")).alias("error"))


def decision_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.breakdown(_gated(spark))


def reject_groups(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rejects_by_reason(_gated(spark)).withColumn("docs", F.array_join(F.transform("docs", lambda x: x.cast("string")), ","))


def plain_response(spark: SparkSession, d: str) -> DataFrame:
    return relevance_rows(_final(spark)).withColumn("relevance_score", r6("relevance_score"))


def response_json(spark: SparkSession, d: str) -> DataFrame:
    return responses(_final(spark), model="rules", return_documents=True).select("query_id", "pairs", "document_chars", F.size("results").alias("results"), "query_tokens", "document_tokens", "total_tokens", F.length("json").alias("chars"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.report(_final(spark))


def eval_howto(ranked: DataFrame, spark: SparkSession) -> DataFrame:
    """Metrics of the how-to queries in the order of retrieval and in the final order."""
    relevant = spark.createDataFrame(X.RELEVANT, "query_id long, original_index long")
    stages = {"retrieved": F.col("request_index") + 1, "reranked": F.col("rank")}
    parts = [evaluate.metrics(ranked.select("query_id", "original_index", c.alias("rank")), relevant, doc_col="original_index").withColumn("stage", F.lit(n)) for n, c in stages.items()]
    return parts[0].unionByName(parts[1])


def howto_metrics(spark: SparkSession, d: str) -> DataFrame:
    return eval_howto(_final(spark), spark).select("stage", "query_id", *[r6(c).alias(c) for c in METRICS])


def routed_rerank(spark: SparkSession, d: str) -> DataFrame:
    got = rerank(howto(spark), Options())
    return got.select("query_id", "original_index", "policy_id", "tier", "decision", "rank")


def ambiguous_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = howto(spark).withColumn("retrieval_rank", F.col("request_index") + 1)
    yes, reason = A.ambiguous_client(F.col("query"))
    got = fallback.fallback(rows.withColumn("query", F.when(F.col("query_id") == 4, "maintenance").otherwise(F.col("query"))))
    return got.select("query_id", "original_index", "domain", "doc_kind", r6("score").alias("score"), "is_head", "rank", yes.alias("ambiguous"), F.coalesce(reason, F.lit("-")).alias("reason"))


def parse_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(X.BUCKET_OUTPUTS)), "id int, raw string")
    return rows.select("id", P.parse_bucket(F.col("raw")).alias("bucket"))


def parse_fines(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(X.FINE_OUTPUTS)), "id int, raw string")
    return rows.select("id", P.parse_fine(F.col("raw")).alias("p")).select("id", "p.score", "p.error")


def parse_event_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores said in three ways, made from every event."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("score: "), k, F.lit("%"))).when(F.col("event_id") % 3 == 1, F.format_string("0.%02d", (F.col("event_id") % 100).cast("int"))).otherwise(F.concat(F.lit("bucket "), k))
    return e.select("event_id", raw.alias("raw")).select("event_id", P.parse_fine(F.col("raw"))["score"].alias("fine"), P.parse_bucket(F.col("raw")).alias("bucket"))


def fallback_fines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 21) / 20.0).alias("fit"), ((F.col("event_id") % 11) / 10.0).alias("sim"))
    return e.select("event_id", P.fallback_fine(F.when(F.col("event_id") % 7 != 0, F.col("fit")), F.col("sim")).alias("fine"))


def response_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(X.REPLIES)], "id int, raw string")
    return rows.select("id", P.response_text(F.col("raw")).alias("answer"))


def flatlines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.round("value", 0).alias("score"))
    return evaluate.flatline(e, 6, 2)


def score_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    rows = rows.select(F.col("source").alias("query_id"), F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("relevant"))
    return evaluate.score_gap(rows).withColumn("gap", r6("gap"))


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.latency(table(spark, d, "events"), "value")
    return got.select("n", *[r6(c).alias(c) for c in ("avg_ms", "min_ms", "max_ms")])


def tie_summaries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("query_id"), (F.col("event_type") != "error").alias("tie_breaker_used"), F.when(F.col("event_type") == "error", "json_parse_failed").alias("tie_breaker_error"), F.col("value").alias("tie_breaker_latency_ms"))
    return evaluate.tie_summary(rows)


def missing_docs(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.missing(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return stateful.breaker(e, "failed", *BREAKER).select("event_id", "failures", "open")


def user_breaker(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "user_id", (F.col("event_type") == "error").alias("failed"))
    return stateful.breaker(e, "failed", "1 day", 2, keys=["user_id"]).select("event_id", "failures", "open")


def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    return stateful.ttl_cache(e, ["user_id"], TTL["user_id"], order="event_id").select("event_id", "hit")


def latency_budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    got = stateful.budget(e, "value", 500.0, ["ts", "event_id"], ["user_id"])
    return got.select("event_id", F.round("spent", 4).alias("spent"), "skipped")


def series_budget(spark: SparkSession, d: str) -> DataFrame:
    """All events as one series under one budget."""
    e = table(spark, d, "events").select("event_id", "ts", "value")
    got = stateful.budget(e, "value", 5000.0, ["ts", "event_id"], [])
    return got.select("event_id", F.round("spent", 3).alias("spent"), "skipped")


def type_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache keyed by the few event types: each key has a share of all events, and none is brought together."""
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    return stateful.ttl_cache(e, ["event_type"], TTL["event_type"], order="event_id", fold_times=100).select("event_id", "hit")


def one_query_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a candidate of one query, ranked by text length, similarity and id."""
    rows = table(spark, d, "documents").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("original_index"), F.length(T.text(F.col("text"))).alias("size"), ((F.col("doc_id") % 97) / 97.0).alias("similarity"))
    return ordered.exact_rank(rows, [F.desc("size"), F.desc("similarity"), "original_index"], ["query_id"]).select("query_id", "original_index", "rank")


def prompt_hash(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    n = items_of(b)
    rows = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % n).join(b.select("item_id", F.col("text").alias("query")), "item_id")
    return rows.select("doc_id", F.sha1(prompts.fine_prompt(F.col("query"), F.col("text"))).alias("prompt_sha1"), prompts.cache_key("m", F.col("text"), F.col("query")).alias("cache_key"))


def recorded_model() -> Callable[[list[str]], list[str]]:
    """A model whose answers depend on a digest of the prompt alone: no number, nothing, too late, or a percentage."""
    import hashlib

    def answer(prompt: str) -> str:
        h = int(hashlib.md5(prompt.encode()).hexdigest()[:6], 16)
        if prompt == prompts.FINE_RETRY:
            return "50%"
        if h % 8 == 2:
            raise TimeoutError
        return ("no number", "")[h % 8] if h % 8 < 2 else f"{h % 101}%"

    return lambda asked: [answer(p) for p in asked]


def fine_outputs(spark: SparkSession, d: str) -> DataFrame:
    """A fine pass over every document as a candidate of one benchmark item."""
    b = table(spark, d, "benchmark")
    n = items_of(b)
    rows = table(spark, d, "documents").select((F.col("doc_id") % n).alias("query_id"), F.col("doc_id").alias("original_index"), F.col("doc_id").alias("policy_rank"), "text")
    rows = rows.join(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    got = fine_pass(recorded_model, "m")(rows)
    got = T.computed(got, p=P.parse_fine(F.col("raw")))
    return got.select("query_id", "original_index", F.when(F.col("error").isNull(), F.col("p.score")).alias("fine"), F.coalesce("error", F.lit("-")).alias("error"), "attempts")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        topk_cosine, retrieval_metrics, retrieval_average, diversified_topk, topk_cosine_all, retrieval_metrics_all, retrieval_average_all, diversified_topk_all, missing_sim_default, truncate_usage, request_status, last_wins, text_forms, loose_numbers, keyword_sets, quality_signals, gated_quality, doc_kinds,
        query_intents, procedure_signals, keyword_tiers, domain_detect, identity_facts, gated_bucket, gate_stats, gated_rank, generic_rank, final_order, decision_breakdown, reject_groups, plain_response, response_json, reports,
        routed_rerank, ambiguous_fallback, parse_buckets, parse_fines, parse_event_scores, fallback_fines, response_texts, flatlines, score_gap, latency_stats, tie_summaries, missing_docs, circuit_breaker, user_breaker,
        ttl_cache, latency_budget, series_budget, type_cache, one_query_rank, prompt_hash, fine_outputs, corpus_gated, corpus_generic, corpus_final, corpus_breakdown, corpus_rejects, corpus_relevance, corpus_routed, corpus_gate_stats, corpus_identity, howto_metrics,
    )
}
