"""Scoring: gates before the expensive scorer, the rule scorer, callable scorers, fine scores."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import facts as A
from ..functions import signals as S
from ..functions import text as T
from ..functions.dictionary import whole_words
from ..functions.parsers import fallback_fine, parse_bucket, parse_fine
from ..sources.policies import Policy
from ..sources.policy_table import PolicyColumns

Words = Policy | PolicyColumns

#: Request rows that are always scored, whatever the gates say.
ALWAYS = 5


def keyword_sets(rows: DataFrame, policy: Words, query: str = "query", doc: str = "text", said: Column | None = None) -> DataFrame:
    """``rows`` with the keyword sets of query and document, each made once: query_keys, doc_keys."""
    return T.computed(rows, query_keys=T.keyword_set(F.col(query), policy.synonym_map), doc_keys=T.keyword_set(F.col(doc), policy.synonym_map, said=said))


def overlap_tier(query_keys: Column, doc_keys: Column, policy: Words) -> Column:
    """2 without query keywords or with a shared tier-A one, 1 with another shared one, else 0."""
    return T.let(F.array_intersect(query_keys, doc_keys), lambda s: F.when(F.size(query_keys) == 0, 2).when(F.size(s) == 0, 0).when(T.any_of(s, policy.tier_a), 2).otherwise(1))


def domain_gate(query_keys: Column, doc_keys: Column, policy: Words) -> Column:
    """A query with a domain keyword wants documents with one."""
    given = policy.domain_keywords
    if not isinstance(given, Column) and not given:
        return F.lit(True)
    return (F.size(T.words(given)) == 0) | ~T.any_of(query_keys, given) | T.any_of(doc_keys, given)


def has_intent(query: Column, policy: Words) -> Column:
    return T.any_of(T.keyword_set(query, policy.synonym_map), policy.intent_keywords)


def procedure_cap(query: Column, doc: Column, bucket: Column, policy: Words) -> Column:
    """For a query with intent, 3 needs two procedure signals and 2 needs one."""
    known = F.struct(bucket.alias("b"), has_intent(query, policy).alias("i"), S.procedure_signal(doc).alias("n"))
    return T.let(known, lambda k: F.when(k["i"] & (k["b"] == 3) & (k["n"] < 2), 2).when(k["i"] & (k["b"] == 2) & (k["n"] < 1), 1).otherwise(k["b"]))


def rule_bucket(doc: Column, facts: Column) -> Column:
    """The deterministic scorer: what the scoring prompt's rules say, from the facts alone."""
    t = T.tokens_word(F.lower(T.text(doc)))
    about = T.any_of(t, [*S.V.KIND_MAINTENANCE_TOKENS, "fix", "repair", "replace"])
    same, match = F.coalesce(facts["same_item"], F.lit(False)), facts["domain_match"]
    generic = F.when(match & about, 2).when(match, 1).otherwise(0)
    return F.when(facts["query_item"].isNull(), generic).when(same, F.when(S.distinct_verbs(doc) >= 2, 3).otherwise(2)).otherwise(F.when(match, 1).otherwise(0))


def prepare(rows: DataFrame, policy: Words, with_facts: bool = True) -> DataFrame:
    """Request rows with facts, tier, tie_breaker and gate (null: goes to the scorer; else why not)."""
    q, d = F.col("query"), F.col("text")
    said = F.col("_said")
    facts = A.identity(q, d, policy if with_facts else Policy(), said)
    sets = keyword_sets(T.computed(rows, _said=whole_words(d)), policy, said=said)
    qk, dk = F.col("query_keys"), F.col("doc_keys")
    out = T.computed(sets, facts=facts, overlap_tier=overlap_tier(qk, dk, policy), _allowed=domain_gate(qk, dk, policy), _signal=S.procedure_signal(d, said)).drop("query_keys", "doc_keys", "_said")
    late = F.col("request_index") >= ALWAYS
    gate = F.when(late & (F.col("overlap_tier") == 0), "tier_0").when(late & ~F.col("_allowed"), "domain")
    return out.withColumns({"tie_breaker": F.col("overlap_tier") * 100 + F.col("_signal"), "gate": gate}).drop("_allowed", "_signal")


def gate_counters() -> dict[str, Column]:
    """tier_a, tier_b (scored rows by overlap tier) and skipped, as aggregates over prepared rows."""
    open_ = F.col("gate").isNull()
    return {"tier_a": F.count_if(open_ & (F.col("overlap_tier") == 2)), "tier_b": F.count_if(open_ & (F.col("overlap_tier") == 1)), "skipped": F.count_if(~open_)}


def gate_stats(prepared: DataFrame, id_col: str = "query_id") -> DataFrame:
    """The gate counters per query."""
    return prepared.groupBy(id_col).agg(*[c.alias(n) for n, c in gate_counters().items()])


def watched(rows: DataFrame, counters: dict[str, Column], name: str = "counters") -> tuple[DataFrame, Observation]:
    """(``rows``; what ``get`` tells the counters by, once an action has run over them): counted while the rows pass, without
    a job of their own. On a stream they are in each batch's progress, under ``name``."""
    seen = Observation(name)
    return rows.observe(seen if not rows.isStreaming else name, *[c.alias(n) for n, c in counters.items()]), seen


Generate = Callable[[list[str]], list[str]]
#: Errors after which a scorer is asked once more.
RETRIABLE = ("TimeoutError", "ReadTimeout", "ConnectError", "ConnectionError", "ConnectionRefusedError", "ConnectionResetError", "ValueError")


def tasks_for(most_calls: int, concurrency: int) -> int:
    """Tasks of a stage that together make no more than ``most_calls`` calls at once."""
    if most_calls < concurrency:
        raise ValueError("one task makes more calls at once than the job may")
    return most_calls // concurrency


def generate(rows: DataFrame, prompt: str, make: Callable[[], Generate], to: str = "raw", timeout: float = 45.0, concurrency: int = 4, budget: tuple[str, float] | None = None, breaker: tuple[float, int] | None = None, most_calls: int | None = None) -> DataFrame:
    """``rows`` with the model's answer to the column ``prompt`` in ``to``, and its latency_ms, attempts and error.

    ``make`` builds a client once per task. Each prompt is one call of at most ``timeout`` seconds, and a task makes
    ``concurrency`` calls at once, so a job makes no more than that times its tasks. A null prompt isn't asked and
    counts no attempt; a failed call gives null and the error's name. With a ``budget`` (id column, seconds) the rows
    of an id, in one task in their order, are asked one after the other until their calls took that long
    (``skipped_total_budget`` from there on). With a ``breaker`` (window in seconds, threshold) a task whose calls
    failed that often within the window asks no more until failures have aged (``circuit_open``, no attempt).
    ``most_calls`` bounds the calls that all tasks make at once, whatever the cluster: the rows are dealt over so few tasks
    (with a ``budget`` by its id, in their order).
    """
    if most_calls is not None:
        n = tasks_for(most_calls, concurrency)
        if budget:
            rows = rows.withColumn("_order", F.monotonically_increasing_id()).repartition(n, budget[0]).sortWithinPartitions("_order").drop("_order")
        else:
            rows = rows.repartition(n)
    more = {to: "string", "latency_ms": "long", "attempts": "int", "error": "string"}
    schema = rows.withColumns({c: F.lit(None).cast(t) for c, t in more.items()}).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, spent, failed, lock = make(), {}, deque(), Lock()

        def tripped() -> bool:
            with lock:
                while failed and failed[0] <= time.monotonic() - breaker[0]:
                    failed.popleft()
                return len(failed) >= breaker[1]

        for frame in frames:
            got: list[tuple] = [(None, 0, 0, None)] * len(frame)
            prompts = frame[prompt].tolist()
            groups: dict = {}
            for i, p in enumerate(prompts):
                if p is not None:
                    groups.setdefault(frame[budget[0]].iloc[i] if budget else i, []).append(i)

            calls, turns = ThreadPoolExecutor(2 * concurrency), ThreadPoolExecutor(concurrency)

            def ask(i: int, prompts=prompts, calls=calls) -> tuple:
                if breaker and tripped():
                    return None, 0, 0, "circuit_open"
                began = time.monotonic()
                try:
                    answer, error = calls.submit(client, [prompts[i]]).result(timeout)[0], None
                except Exception as e:
                    answer, error = None, type(e).__name__
                    with lock:
                        failed.append(time.monotonic())
                return answer, int((time.monotonic() - began) * 1000), 1, error

            def group(key, got=got, ask=ask, groups=groups) -> None:
                for i in groups[key]:
                    if budget and spent.get(key, 0) > budget[1] * 1000:
                        got[i] = None, 0, 0, "skipped_total_budget"
                    else:
                        got[i] = ask(i)
                        spent[key] = spent.get(key, 0) + got[i][1] if budget else 0

            list(turns.map(group, list(groups)))
            calls.shutdown(wait=False, cancel_futures=True)  # a call that hangs can't be ended
            turns.shutdown(wait=False)
            yield frame.assign(**{c: pd.Series([g[k] for g in got], index=frame.index, dtype=object if c in (to, "error") else None) for k, c in enumerate(more)})

    return rows.mapInPandas(run, schema)


def score(prepared: DataFrame, policy: Words, make: Callable[[], Generate] | None = None, prompt: Column | None = None, retry_prompt: Column | None = None, timeout: float = 45.0, concurrency: int = 4, most_calls: int | None = None) -> DataFrame:
    """Prepared rows with bucket and warning (struct: error, raw). Gated rows get 0 without meeting the scorer: they
    have no prompt. Without ``make`` the rule scorer scores. A model is asked once more where the parser finds no
    bucket in its answer or the call timed out or didn't connect; other errors warn at once.
    """
    live, none = F.col("gate").isNull(), "struct<error:string,raw:string>"
    if make is None:
        rows = T.computed(prepared, _raw_bucket=F.when(live, rule_bucket(F.col("text"), F.col("facts"))).otherwise(0)).withColumn("warning", F.lit(None).cast(none))
    else:
        spare = ["latency_ms", "attempts", "error"]
        first = generate(prepared.withColumn("_prompt", F.when(live, prompt)), "_prompt", make, "_raw1", timeout, concurrency, most_calls=most_calls)
        first = T.computed(first, _b1=parse_bucket(F.col("_raw1"))).withColumn("_error1", F.col("error")).drop(*spare)
        again = live & F.col("_b1").isNull() & F.coalesce(F.col("_error1").isin(*RETRIABLE), F.lit(True))
        second = generate(first.withColumn("_prompt", F.when(again, retry_prompt if retry_prompt is not None else prompt)), "_prompt", make, "_raw2", timeout, concurrency, most_calls=most_calls)
        rows = T.computed(second.withColumn("_asked", F.col("attempts") > 0), _b2=parse_bucket(F.col("_raw2"))).withColumn("_raw_bucket", F.coalesce("_b1", "_b2", F.lit(0)))
        error = F.when(F.col("_asked"), F.coalesce(F.col("error"), F.lit("score parse failed"))).otherwise(F.col("_error1"))
        failed = live & F.col("_b1").isNull() & F.col("_b2").isNull()
        rows = rows.withColumn("warning", F.when(failed, F.struct(error.alias("error"), F.coalesce("_raw2", "_raw1").alias("raw"))).cast(none))
        rows = rows.drop("_prompt", "_raw1", "_raw2", "_b1", "_b2", "_error1", "_asked", *spare)
    capped = F.when(live, procedure_cap(F.col("query"), T.trim_middle(F.col("text")), F.col("_raw_bucket"), policy)).otherwise(0).cast("int")
    return T.computed(rows, bucket=capped).drop("_raw_bucket")


def fine_candidates(ranked: DataFrame, k: int = 10, id_col: str = "query_id") -> DataFrame:
    """The first k accepted rows of each query in policy order that have a text."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("policy_rank"))
    return ranked.where("decision = 'ACCEPT'").withColumn("_place", place).where((F.col("_place") <= k) & (F.length(T.text(F.col("text"))) > 0)).drop("_place")


def merge_fine(ranked: DataFrame, outputs: DataFrame, id_col: str = "query_id", fit: str = "intent_fit") -> DataFrame:
    """Ranked rows with fine_score, fine_score_norm, tie_breaker_used and tie_breaker_error. ``outputs``:
    query_id, original_index, raw, error (why there is no output, as ``circuit_open``). What can't be parsed
    falls back to fit and similarity, and its error says so."""
    o = T.computed(outputs, _p=parse_fine(F.col("raw")))
    o = o.select(id_col, "original_index", F.lit(True).alias("_asked"), F.when(F.col("error").isNull(), F.col("_p.score")).alias("_score"), F.coalesce("error", "_p.error").alias("_error"))
    out = ranked.join(o, [id_col, "original_index"], "left")
    failed = F.col("_asked") & F.col("_score").isNull()
    score_ = F.coalesce("_score", F.when(failed, fallback_fine(F.col(fit), F.col("similarity"))))
    out = out.withColumns({
        "fine_score": score_, "fine_score_norm": score_ / 100.0, "tie_breaker_used": F.coalesce("_asked", F.lit(False)), "tie_breaker_fallback": F.coalesce(failed, F.lit(False)),
        "tie_breaker_error": F.when(failed & F.col("_error").isNotNull(), F.concat("_error", F.lit("|fallback"))).otherwise(F.col("_error")),
    })
    return out.drop("_asked", "_score", "_error")


def fine_counters() -> dict[str, Column]:
    """Aggregates over a fine pass's rows (error, attempts, cached)."""
    e, fresh = F.coalesce("error", F.lit("")), ~F.col("cached")
    return {
        "requested": F.count("*"), "cache_hits": F.count_if("cached"), "parse_errors": F.count_if(fresh & ((F.col("attempts") > 1) | e.startswith("percent_parse"))), "retries": F.count_if(fresh & (F.col("attempts") > 1)),
        "retry_errors": F.count_if(fresh & e.startswith("percent_retry_parse")), "timeouts": F.count_if(fresh & e.isin("fine_score_timeout", "percent_retry_timeout")), "skipped_budget": F.count_if(e == "skipped_total_budget"),
        "circuit_open": F.count_if(e == "circuit_open"), "empty": F.count_if(e == "empty_output"),
    }


def fine_metrics(outputs: DataFrame) -> DataFrame:
    """Counters of a fine pass from its rows."""
    return outputs.agg(*[c.alias(n) for n, c in fine_counters().items()])
