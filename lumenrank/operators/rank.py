"""Ranking: the gated and the generic policy, and the final order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as A
from ..functions import signals as S
from ..functions import text as T
from ..functions import vocab as V
from ..sources.policies import RANKING_IDS, Policy
from ..sources.policy_table import PolicyColumns


def clamp(bucket: Column, facts: Column) -> Column:
    """0 unless the domains agree and, where the query names an item, the document names it too; a document
    of the same domain and item has 1 at least."""
    other = facts["query_item"].isNotNull() & ~F.coalesce(facts["same_item"], F.lit(False))
    kept = F.when(~F.coalesce(facts["domain_match"], F.lit(False)) | other, 0).otherwise(bucket)
    return F.when((kept == 0) & facts["same_domain"] & F.coalesce(facts["same_item"], F.lit(False)), 1).otherwise(kept)


def zero_tier(reason: Column, same_domain: Column, same_item: Column) -> Column:
    same = F.coalesce(same_domain, F.lit(False)) | F.coalesce(same_item, F.lit(False))
    return F.when(reason == "item_mismatch", 0).when((reason == "no_item_found") & same, 1).otherwise(2)


def client_zero_tier(reason: Column) -> Column:
    return F.when(reason == "item_mismatch", 0).when(reason == "no_item_found", 1).when(reason == "domain_mismatch", 2).otherwise(9)


def client_score_norm(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """norm: the first known of score_norm, rank_score_norm and fine_score_norm, else the score's share of
    the query's highest."""
    top = F.max("score").over(Window.partitionBy(id_col))
    known = [F.col(c) for c in ("score_norm", "rank_score_norm", "fine_score_norm") if c in rows.columns]
    return rows.withColumn("norm", F.coalesce(*known, F.when(top > 0, F.col("score") / top)))


def decision_of(decision: Column, fallback: Column, score: Column, reason: Column) -> Column:
    """A row's decision, inferred where it has none: fallback rows and positive scores are accepted."""
    return F.coalesce(decision, F.when(fallback | (score > 0), "ACCEPT").otherwise(F.concat(F.lit("REJECT_TIER_"), client_zero_tier(reason).cast("string"))))


def gated(scored: DataFrame, policy: Policy | PolicyColumns, id_col: str = "query_id") -> DataFrame:
    """Scored rows under the gated policy: tier, decision, zero_reason, scores, intent and kind, and
    policy_rank from 1, the order that the fine pass cuts."""
    q, d, f = F.col("query"), F.col("text"), F.col("facts")
    one = Window.partitionBy(id_col)
    ambiguous = A.ambiguous_gated(q, policy)
    rows = T.computed(scored, mode=F.when(ambiguous, "AMBIGUOUS").otherwise("SPECIFIC")).withColumn("tier", F.when(F.col("mode") == "AMBIGUOUS", F.col("bucket")).otherwise(clamp(F.col("bucket"), f)).cast("int"))
    # all that the texts say comes before the rows are dealt by query, so texts that nobody asks for stay behind
    rows = S.with_quality(rows, name="_q")
    low, words, hits = F.col("_low"), F.col("_words"), F.col("_hits")
    said = F.when(T.same_in_lower(d), words).otherwise(T.tokens_word(d))
    rows = T.computed(rows, query_intent=S.query_intent(q), _overlap=T.overlap_count(q, d, said), _short=F.size(T.tokens_word(q)) <= 1, doc_kind=S.kind_gated(d, F.col("_q"), hits, low), _action=S.action_score(d, F.col("_q"), hits)).drop("_low", "_words", "_hits")
    rows = T.computed(rows, intent_fit=S.fit_gated(F.col("query_intent"), F.col("doc_kind")))
    rows = rows.withColumn("_last", F.greatest(F.lit(1), F.count("*").over(one) - 1))
    rows = rows.withColumn("_sim", F.coalesce("similarity", 1.0 - F.col("request_index") / F.col("_last")))
    rows = rows.withColumn("final_rank", F.when(F.col("tier") > 0, F.col("_action") * F.col("intent_fit")).otherwise(0.0))
    flat = (F.max("tier").over(one) == F.min("tier").over(one)) | (F.size(F.collect_set("tier").over(one)) <= 2)
    blend = ((F.col("mode") == "AMBIGUOUS") | F.col("_short")) & flat
    rows = rows.withColumn("_blend", blend).withColumn("_final", F.when(F.col("_blend"), F.col("_sim") * 0.85 + F.col("_overlap") * 0.15).otherwise(F.col("tier").cast("double")))
    rows = rows.withColumn("final_rank", F.when(F.col("_final") > 0, F.col("final_rank")).otherwise(0.0))
    specific, zero = F.col("mode") == "SPECIFIC", F.col("_final") == 0
    none = F.size(f["doc_items"]) == 0
    reason = F.when(zero, F.when(~f["same_domain"] & specific, "domain_mismatch").when(f["query_item"].isNotNull() & F.coalesce(~f["same_item"], F.lit(False)) & specific, "item_mismatch").when(none & specific, "no_item_found").otherwise("low_signal"))
    rows = rows.withColumn("zero_reason", reason)
    rows = rows.withColumn("score_raw", F.when(F.coalesce(F.col("zero_reason") == "no_item_found", F.lit(False)), F.col("intent_fit") * 0.1).otherwise(F.col("_final")))
    reject = F.concat(F.lit("REJECT_TIER_"), zero_tier(F.col("zero_reason"), f["same_domain"], f["same_item"]).cast("string"))
    rows = rows.withColumn("decision", F.when(F.col("tier") > 0, "ACCEPT").otherwise(reject))
    soft = F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)) * 0.12
    softened = (F.col("mode") == "AMBIGUOUS") & (F.col("score_raw") <= 0) & (soft > F.col("score_raw"))
    rows = rows.withColumns({
        "score": F.when(softened, soft).otherwise(F.col("score_raw")), "score_norm": F.greatest(T.clamp01(F.col("score_raw") / 3.0), F.when(softened, soft / 3.0).otherwise(0.0)),
        "pre_rank_score": F.col("final_rank"), "rank_score": F.when(F.col("decision") == "ACCEPT", F.col("final_rank")).otherwise(0.0),
        "rank_score_reason": F.when(F.col("decision") == "ACCEPT", "accepted").otherwise("rejected"), "softened_zero_reason": F.when(softened, F.col("zero_reason")),
    })
    before = Window.partitionBy(id_col).orderBy(F.desc("tier"), F.desc("tie_breaker"), "request_index")
    rows = rows.withColumn("index", F.row_number().over(before) - 1)  # the place before the postprocess
    sim = F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0))
    positive = (F.col("decision") == "ACCEPT") & (F.col("rank_score") > 0)
    on = lambda c: F.when(positive, c)
    order = Window.partitionBy(id_col).orderBy(
        F.when(positive, 0).otherwise(1), on(F.col("tier")).desc_nulls_last(), on(F.col("rank_score")).desc_nulls_last(), on(F.col("intent_fit")).desc_nulls_last(), on(F.col("doc_kind")).desc_nulls_last(),
        F.when(positive, 0).otherwise(zero_tier(F.col("zero_reason"), f["same_domain"], f["same_item"])), sim.desc(), on(F.col("original_index")).desc_nulls_last(), "original_index", "request_index",
    )
    return rows.withColumn("policy_rank", F.row_number().over(order)).withColumn("policy_id", F.lit(policy.name) if isinstance(policy.name, str) else policy.name).drop("_q", "_overlap", "_sim", "_final", "_blend", "_last", "_short", "_action")


def generic(scored: DataFrame, id_col: str = "query_id", diversify: bool = False) -> DataFrame:
    """Scored rows under the generic policy: no gates on items, a penalty and a reject on a domain mismatch,
    low-signal rows of ambiguous queries kept. ``diversify`` really puts each domain's best accepted row of
    an ambiguous query first."""
    q, d = F.col("query"), F.col("text")
    rows = S.with_words(scored)
    low, words, hits = F.col("_low"), F.col("_words"), F.col("_hits")
    rows = T.computed(rows, query_intent=S.query_intent(q), query_domain=A.generic_domain(q), doc_domain=A.generic_domain(d, tokens=words), _s=S.quality_signals(d, words, low, hits), mode=F.when(A.ambiguous_generic(q), "AMBIGUOUS").otherwise("SPECIFIC"))
    rows = T.computed(rows, doc_kind=S.kind_generic(d, F.col("_s"), hits, low)).drop("_low", "_words", "_hits")
    rows = T.computed(rows, intent_fit=S.fit_generic(F.col("query_intent"), F.col("doc_kind")))
    other = ~F.col("query_domain").isin("unknown", "ambiguous") & ~F.col("doc_domain").isin("unknown", "ambiguous") & (F.col("query_domain") != F.col("doc_domain"))
    base = T.clamp01(F.col("_s.action_verbs") / 4.0 * F.col("intent_fit"))
    tier, specific = F.col("bucket").cast("int"), F.col("mode") == "SPECIFIC"
    rows = rows.withColumns({
        "tier": tier, "pre_rank_score_raw": base, "pre_rank_score": F.when(other, F.greatest(F.lit(0.0), base - 0.25)).otherwise(base), "score_raw": tier.cast("double"), "score": tier.cast("double"),
        "score_norm": T.clamp01(tier / 3.0), "decision": F.when(specific & other, "REJECT_TIER_9").when(specific & (tier <= 0), "REJECT_TIER_2").when(~specific & (tier <= 0), "KEEP_LOW_SIGNAL").otherwise("ACCEPT"),
    })
    accept = F.col("decision") == "ACCEPT"
    rows = rows.withColumns({
        "zero_reason": F.when(F.col("decision") == "REJECT_TIER_9", "domain_mismatch").when(~accept, "low_signal"), "rank_score": F.when(accept, F.col("pre_rank_score")).otherwise(0.0),
        "rank_score_reason": F.when(accept, "accepted").otherwise("rejected"), "_kind": F.coalesce(*[F.when(F.col("doc_kind") == k, v) for k, v in V.KIND_RANK.items()]),
        "_group": F.when(accept, 0).when(F.col("decision") == "KEEP_LOW_SIGNAL", 1).otherwise(2),
    })
    keys = ["_group", F.desc("score_raw"), F.desc("rank_score"), F.desc("intent_fit"), F.desc("_kind"), F.coalesce("similarity", F.lit(0.0)).desc(), "request_index"]
    if diversify:
        head = F.row_number().over(Window.partitionBy(id_col, "_group", "doc_domain").orderBy(F.desc("rank_score"), *keys))
        rows = rows.withColumn("_head", F.when(accept & ~specific & (head == 1), 0).otherwise(1))
        keys.insert(1, "_head")
    rows = rows.withColumn("policy_rank", F.row_number().over(Window.partitionBy(id_col).orderBy(*keys)))
    return rows.withColumns({"index": F.col("policy_rank") - 1, "final_rank": F.col("pre_rank_score"), "softened_zero_reason": F.lit(None).cast("string"), "policy_id": F.lit("generic")}).drop("_s", "_kind", "_group", "_head")


@dataclass(frozen=True)
class Ranking:
    """How scored rows become ranked ones: tier, decision, scores, index and policy_rank (see ``gated``). With
    ``own_words`` gates and facts use the selected policy's words, else none."""

    rank: Callable[[DataFrame, Policy | PolicyColumns], DataFrame]
    own_words: bool = True


RANKINGS = {"gated": Ranking(gated), "generic": Ranking(lambda rows, _: generic(rows), own_words=False)}


def register(name: str, ranking: Ranking, aliases: tuple[str, ...] = ()) -> None:
    """Makes a ranking available to requests under its name and aliases; a name can't be taken twice."""
    taken = [i for i in (name, *aliases) if i in RANKING_IDS]
    if taken or name in RANKINGS:
        raise ValueError(f"registered already: {taken or name}")
    RANKINGS[name] = ranking
    RANKING_IDS.update(dict.fromkeys((name, *aliases), name))


def decision_bucket(decision: Column) -> Column:
    return F.when(F.upper(decision) == "ACCEPT", 2).when(F.upper(decision) == "KEEP_LOW_SIGNAL", 1).otherwise(0)


def final_order(ranked: DataFrame, top_n: int | None = None, id_col: str = "query_id") -> DataFrame:
    """rank from 1: decision, tier, fine score, rank score, similarity, original_index, index."""
    order = Window.partitionBy(id_col).orderBy(
        decision_bucket(F.col("decision")).desc(), F.coalesce("tier", F.lit(-1)).desc(), F.coalesce("fine_score", F.lit(-1)).desc(), F.coalesce("rank_score", "score", F.lit(0.0)).desc(),
        F.coalesce("similarity", F.lit(0.0)).desc(), "original_index", "index",
    )
    out = ranked.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top_n) if top_n is not None and top_n > 0 else out


def client_order(ranked: DataFrame, id_col: str = "query_id") -> DataFrame:
    """rank from 1 as the search client shows it: accepted and kept rows as they came, then the others by
    reason, similarity and id."""
    group = F.when(F.col("decision") == "ACCEPT", 0).when(F.col("decision") == "KEEP_LOW_SIGNAL", 1).otherwise(2)
    rest = group == 2
    order = Window.partitionBy(id_col).orderBy(
        group, F.when(~rest, F.col("rank")), F.when(rest, client_zero_tier(F.col("zero_reason"))), F.when(rest, F.coalesce("similarity", F.lit(0.0))).desc_nulls_last(), F.when(rest, F.col("original_index")),
    )
    return ranked.withColumn("client_rank", F.row_number().over(order))


def apply_caps(rows: DataFrame, caps: list[dict], boosts: list[dict]) -> DataFrame:
    """Opt-in extension: the policies' caps and boosts on the bucket (as 0, 3, 7 or 10 on the old scale),
    which the ranking itself never reads."""
    scale = {0: 0, 3: 1, 7: 2, 10: 3}
    out = F.col("bucket")
    low_q, low_d = F.lower(T.text(F.col("query"))), F.lower(T.text(F.col("text")))
    for c in caps:
        hit = T.contains_any(low_q, c.get("if_query_contains_any", [])) & T.contains_any(low_d, c.get("and_doc_contains_any", []))
        hit = hit & ~T.contains_any(low_d, c.get("and_doc_not_contains_any", []))
        out = F.when(hit, F.least(out, F.lit(scale[c["cap_to"]]))).otherwise(out)
    for b in boosts:
        hit = (out >= scale[b["if_base_score_at_least"]]) & T.contains_any(low_d, b.get("and_doc_contains_any", [])) & T.contains_any(low_d, b.get("and_doc_contains_any2", []))
        out = F.when(hit, F.greatest(out, F.lit(scale[b["boost_to"]]))).otherwise(out)
    return rows.withColumn("bucket", out.cast("int"))
