"""End-to-end plans: rerank request rows, search a corpus, build an index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import facts as A
from ..functions import prompts
from ..functions import text as T
from ..functions.parsers import parse_fine
from ..operators import fallback as B
from ..operators import rank as R
from ..operators import retrieve, score
from ..operators.tables import stored
from ..sources.corpora import Embed, embed, write_corpus, write_index
from ..sources.policies import Policy, PolicyStore, plugin
from ..sources.policy_table import COLUMNS, PolicyColumns, policy_table, with_policy


@dataclass(frozen=True)
class Options:
    """What a request may set."""

    policy_id: str | None = None
    top_n: int | None = None
    fine_top_k: int = 10
    top_k_retrieval: int = 10
    query_chars: int = 256
    document_chars: int = 512
    skip_ambiguous: bool = True
    max_documents: int = 1024
    return_documents: bool = False

    @classmethod
    def from_conf(cls, spark: SparkSession, **given) -> Options:
        """Options from the session's ``lumenrank.<name>`` settings; what is given (and not None) goes first."""
        out = {k: v for k, v in given.items() if v is not None}
        for f in fields(cls):
            said = spark.conf.get(f"lumenrank.{f.name}", None)
            if said is not None and f.name not in out:
                out[f.name] = truthy(said) if isinstance(f.default, bool) else int(said) if "int" in str(f.type) else said
        return cls(**out)


def truthy(said: str) -> bool:
    return said.strip().lower() in ("1", "true", "yes")


def scored(rows: DataFrame, policy: Policy | PolicyColumns, kind: str, options: Options, make: Callable[[], score.Generate] | None = None) -> DataFrame:
    """Request rows with facts (of the whole texts) and bucket (of the truncated ones)."""
    q, d = T.truncate(F.col("query"), options.query_chars), T.truncate(F.col("text"), options.document_chars)
    rows = rows.withColumns({"_query": F.col("query"), "_text": F.col("text")})
    words = policy if R.RANKINGS[kind].own_words else Policy(name="generic")
    cut = score.prepare(rows.withColumns({"query": q, "text": d}), words, with_facts=False)
    cut = T.computed(cut, facts=A.identity(F.col("_query"), F.col("_text"), policy)) if R.RANKINGS[kind].own_words else cut
    asked: dict[str, Column] = {}
    if make is not None:
        shots = policy.shots if isinstance(policy, PolicyColumns) else prompts.examples(rows.sparkSession, [policy])[policy.name]
        asked = {"prompt": prompts.bucket_prompt(F.col("query"), T.trim_middle(F.col("text")), F.col("facts"), shots), "retry_prompt": prompts.retry_prompt(F.col("facts"))}
    out = score.score(cut, words, make, **asked)
    return out.withColumns({"query": F.col("_query"), "text": F.col("_text")}).drop("_query", "_text")


def route(rows: DataFrame, store: PolicyStore) -> Column:
    """The policy of each row: its own policy_id, else the how-to policy of the query's domain, else the default."""
    names = sorted(store.policies)
    domains = [n[len("howto_") : -len("_v1")] for n in names if n.startswith("howto_") and n.endswith("_v1")]
    asked = F.col("policy_id") if "policy_id" in rows.columns else F.lit(None).cast("string")
    by_domain = T.let(A.infer_domain(F.col("query")), lambda d: F.when(d.isin(domains), F.concat(F.lit("howto_"), d, F.lit("_v1"))))
    return F.coalesce(F.when(asked.isin(names), asked), by_domain, F.lit(store.default))


def rerank(rows: DataFrame, options: Options = Options(), store: PolicyStore | None = None, make: Callable[[], score.Generate] | None = None, fine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Request rows (query_id, query, request_index, original_index, text, similarity) in final order.

    A query goes to the policy asked for, else to that of its domain, else to the default. Rows may ask for themselves
    in a column policy_id. Where policies differ by row they are joined as data (``policy_table``), so the plan is
    the same for any number of them. ``make`` builds a scoring client per task (without it the rule scorer scores);
    ``fine`` turns fine-pass candidates into (query_id, original_index, raw, error).
    """
    store = store or PolicyStore()
    store.refresh()
    kind = plugin(options.policy_id)
    if kind != "gated" or options.policy_id in store.policies:
        policy = store.select(options.policy_id)
        ranked = R.RANKINGS[kind].rank(scored(rows.drop("policy_id"), policy, kind, options, make), policy)
    else:
        shots = prompts.examples(rows.sparkSession, store.policies.values()) if make is not None else {}
        table, words = policy_table(rows.sparkSession, store.policies.values(), shots)
        mine = with_policy(rows.drop("policy_id"), route(rows, store), table) if "policy_id" not in rows.columns else with_policy(rows, route(rows, store), table).drop("policy_id")
        ranked = R.RANKINGS[kind].rank(scored(mine, words, kind, options, make), words).drop(*COLUMNS)
    if fine is not None:
        ranked = score.merge_fine(ranked, fine(score.fine_candidates(ranked, options.fine_top_k)))
    else:
        none = {"fine_score": "int", "fine_score_norm": "double", "tie_breaker_error": "string"}
        ranked = ranked.withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"tie_breaker_used": F.lit(False), "tie_breaker_fallback": F.lit(False)})
    return R.final_order(ranked, options.top_n)


@dataclass(frozen=True)
class FineLimits:
    """What a fine pass may take: seconds of a call and of a query's calls, an answer's life in the cache, and the
    failures within a window that open the circuit. With ``trip`` the failures of a task's own calls open it, too, for the
    rows that the task comes to later. ``most_calls`` bounds the calls of the whole job at once."""

    timeout: float = 30.0
    total: float = 60.0
    ttl: float = 300.0
    window: float = 60.0
    threshold: int = 5
    concurrency: int = 4
    document_chars: int = 1600
    trip: bool = False
    most_calls: int | None = None


def fine_pass(make: Callable[[], score.Generate], model: str = "", limits: FineLimits = FineLimits(), cache: DataFrame | None = None, failures: DataFrame | None = None, now: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """A ``fine`` for ``rerank``: candidates (query_id, original_index, query, text, policy_rank) with key, raw, error,
    attempts, cached and latency_ms.

    ``failures`` (at) are those of earlier passes: ``threshold`` within the window leave every row ``circuit_open``.
    ``cache`` (key, expires_at, raw, error), see ``cache_rows``, answers for what it holds, errors too. Otherwise each
    distinct pair of query and document is asked once, a query's one after the other within its budget; where the
    parser finds no number in an answer, a prompt without query and document asks once more for half the time.
    """
    now = F.current_timestamp() if now is None else now

    def run(candidates: DataFrame) -> DataFrame:
        rows = T.computed(candidates, key=prompts.cache_key(model, F.col("text"), F.col("query"), limits.document_chars))
        plain = rows.select("query_id", "original_index", "key")
        recent = (F.col("at") > now - F.make_dt_interval(secs=F.lit(limits.window))) & (F.col("at") <= now)
        open_ = F.lit(False) if failures is None else failures.where(recent).agg(F.count("*") >= limits.threshold).scalar()
        own = (limits.window, limits.threshold) if limits.trip else None
        first = Window.partitionBy("key").orderBy("query_id", "policy_rank")
        once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("query_id", "policy_rank", "key", prompts.fine_prompt(F.col("query"), F.col("text"), limits.document_chars).alias("prompt"))
        known = (cache if cache is not None else once.select("key").withColumns({"expires_at": F.lit(None).cast("timestamp"), "raw": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).where(F.lit(False))).where(F.col("expires_at") > now)
        known = known.select("key", F.col("raw").alias("raw"), F.col("error").alias("error")).dropDuplicates(["key"])
        todo = once.where(~open_).join(known, "key", "left_anti")
        dealt = [score.tasks_for(limits.most_calls, limits.concurrency)] if limits.most_calls else []
        todo = todo.repartition(*dealt, "query_id").sortWithinPartitions("query_id", "policy_rank")
        asked = score.generate(todo, "prompt", make, "raw1", limits.timeout, limits.concurrency, ("query_id", limits.total), own)
        asked = T.computed(asked, _p1=parse_fine(F.col("raw1")), _e1=F.col("error"), _ms=F.col("latency_ms")).drop("error", "latency_ms", "attempts", "prompt")
        empty = T.strip(F.col("raw1")) == ""
        again = F.col("_e1").isNull() & ~empty & F.col("_p1.score").isNull()
        asked = score.generate(asked.withColumn("prompt", F.when(again, prompts.FINE_RETRY)), "prompt", make, "raw2", limits.timeout / 2, limits.concurrency, breaker=own)
        asked = T.computed(asked, _p2=parse_fine(F.col("raw2")), _again=(F.col("attempts") > 0) | F.coalesce(F.col("error") == "circuit_open", F.lit(False)))
        late = lambda e, what: F.when(e.isin("skipped_total_budget", "circuit_open"), e).when(e.isin("TimeoutError", "ReadTimeout"), F.lit(f"{what}_timeout")).when(e.isNotNull(), F.concat(F.lit(f"{what}_exc:"), e))
        error = F.when(F.col("_again"), F.coalesce(late(F.col("error"), "percent_retry"), F.when(F.col("_p2.score").isNull(), F.concat(F.lit("percent_retry_parse:"), "_p2.error")))).otherwise(F.coalesce(late(F.col("_e1"), "fine_score"), F.when(empty, "empty_output")))
        attempts = F.when(F.col("_e1").isin("skipped_total_budget", "circuit_open"), 0).otherwise(1) + (F.col("attempts") > 0).cast("int")
        answers = asked.select("key", F.coalesce(F.nullif("raw2", F.lit("")), F.col("raw1")).alias("raw"), error.alias("error"), attempts.alias("attempts"), F.lit(False).alias("cached"), (F.col("_ms") + F.col("latency_ms")).alias("latency_ms"))
        held = known.select("key", "raw", "error", F.lit(0).alias("attempts"), F.lit(True).alias("cached"), F.lit(0).cast("long").alias("latency_ms"))
        got = plain.join(answers.unionByName(held), "key", "left")
        shut = {"raw": F.lit(None).cast("string"), "error": F.lit("circuit_open"), "attempts": F.lit(0), "cached": F.lit(False), "latency_ms": F.lit(0).cast("long")}
        return got.select("query_id", "original_index", "key", *[F.when(open_, v).otherwise(F.col(c)).alias(c) for c, v in shut.items()])

    return run


def cache_rows(outputs: DataFrame, limits: FineLimits = FineLimits(), now: Column | None = None) -> DataFrame:
    """What a fine pass adds to its cache: (key, expires_at, raw, error) of the answers that were asked for."""
    now = F.current_timestamp() if now is None else now
    fresh = outputs.where(~F.col("cached") & (F.col("attempts") > 0)).dropDuplicates(["key"])
    return fresh.select("key", (now + F.make_dt_interval(secs=F.lit(limits.ttl))).alias("expires_at"), "raw", "error")


def search(queries: DataFrame, index: DataFrame, corpus: DataFrame, options: Options = Options(), **kw) -> tuple[DataFrame, DataFrame]:
    """(reranked rows, fallback rows) of queries (query_id, query, embedding) over an index (doc_id,
    embedding) and its corpus (doc_id, text). Ambiguous queries skip the reranker where the options say so."""
    found = retrieve.top_k(queries, index, options.top_k_retrieval)
    rows = found.join(corpus.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    rows = rows.select("query_id", "query", (F.col("rank") - 1).alias("request_index"), F.col("doc_id").alias("original_index"), "text", F.col("sim").alias("similarity"), F.col("rank").alias("retrieval_rank"))
    yes, _ = A.ambiguous_client(F.col("query"))
    skip = yes if options.skip_ambiguous else F.lit(False)
    return rerank(rows.where(~skip).drop("retrieval_rank"), options, **kw), B.fallback(rows.where(skip))


def build_index(corpus: DataFrame, make: Callable[[], Embed], dim: int, path: str) -> None:
    """Embeds a corpus and writes index and documents below ``path``."""
    write_index(embed(corpus, make, dim), f"{path}/index")
    write_corpus(corpus, f"{path}/docs")


#: Folders of an index that is kept up to date.
INDEX_BUCKETS = 64


def update_index(corpus: DataFrame, make: Callable[[], Embed], dim: int, path: str, order: Column | None = None) -> dict[str, int]:
    """Brings the index at ``path`` (doc_id, digest, embedding, ok, bucket) to the state of ``corpus`` (doc_id, text), and
    returns how many texts were embedded, kept and removed.

    Only texts whose digest isn't in the index, or whose embedding failed, are embedded. Of rows that share a doc_id the
    last by ``order`` counts (without it, the one of the largest text); rows without doc_id are left out. Only the
    folders (by a hash of doc_id) in which something changed are written again, and each is replaced as a whole.
    """
    spark = corpus.sparkSession
    last = F.struct((order if order is not None else F.lit(0)).alias("o"), T.text(F.col("text")).alias("text"))
    now = corpus.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(last).alias("l")).select("doc_id", F.col("l.text").alias("text"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(INDEX_BUCKETS)).cast("int")
    now = now.withColumns({"digest": F.sha2("text", 256), "bucket": bucket})
    form = "doc_id long, digest string, embedding array<float>, ok boolean, bucket int"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = spark.read.schema(form).parquet(path) if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else spark.createDataFrame([], form)
    fresh = stored(now.join(old.where("ok").select("doc_id", "digest"), ["doc_id", "digest"], "left_anti"), "fresh")
    gone = stored(old.select("doc_id", "bucket").join(now.select("doc_id"), "doc_id", "left_anti"), "gone")
    vectors = embed(fresh.select("doc_id", "text"), make, dim).join(fresh.select("doc_id", "digest", "bucket"), "doc_id").select("doc_id", "digest", "embedding", "ok", "bucket")
    touched = F.broadcast(fresh.select("bucket").unionByName(gone.select("bucket")).distinct())  # as many rows as folders, at most
    kept = old.join(touched, "bucket", "left_semi").join(fresh.select("doc_id"), "doc_id", "left_anti").join(gone.select("doc_id"), "doc_id", "left_anti")
    new = stored(kept.select("doc_id", "digest", "embedding", "ok", "bucket").unionByName(vectors), "index")
    n = {"embedded": fresh.count(), "removed": gone.count(), "kept": 0}
    n["kept"] = now.count() - n["embedded"]
    empty = touched.join(new.select("bucket").distinct(), "bucket", "left_anti").collect()  # folders that lost all they had
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for r in empty:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={r['bucket']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return n
