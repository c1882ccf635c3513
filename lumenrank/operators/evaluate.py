"""Ranking metrics, summaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_flag, snippet


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 3, id_col: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """Per query of ``relevant`` (query_id, doc_id): acc1, mrr, recall_any and recall_all at k. Queries
    without ranked rows score 0."""
    r = relevant.select(id_col, doc_col).distinct()
    size = r.groupBy(id_col).agg(F.count("*").alias("n"))
    hit = ranked.select(id_col, doc_col, "rank").join(r, [id_col, doc_col], "left_semi")
    best = hit.groupBy(id_col).agg(F.min("rank").alias("first"), F.count_distinct(F.when(F.col("rank") <= k, F.col(doc_col))).alias("hits"))
    out = size.join(best, id_col, "left")
    return _figures(out, k, id_col)


def _figures(out: DataFrame, k: int, id_col: str) -> DataFrame:
    return out.select(
        id_col, F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("acc1"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias("recall_any"), (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall_all"),
    )


def label_metrics(ranked: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "query_id") -> DataFrame:
    """``metrics`` where a query's relevant rows are the other rows of its label: ``queries`` (id_col, own) are
    all rows with their label, ``ranked`` has the column label. Queries alone with their label give no row."""
    size = queries.where("own is not null").groupBy("own").agg((F.count("*") - 1).alias("n"))
    size = queries.join(size.where("n > 0"), "own")
    hit = ranked.join(queries, id_col).where(F.col("label") == F.col("own"))
    best = hit.groupBy(id_col).agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("hits"))
    return _figures(size.join(best, id_col, "left"), k, id_col)


def average(per_query: DataFrame) -> DataFrame:
    names = ("acc1", "mrr", "recall_any", "recall_all")
    return per_query.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in names])


def score_gap(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Per query: mean score of the relevant rows less that of the others (null without both)."""
    mean = lambda on: F.avg(F.when(on, F.col("score")))
    return rows.groupBy(id_col).agg((mean(F.col("relevant")) - mean(~F.col("relevant"))).alias("gap"))


def latency(rows: DataFrame, col: str = "latency_ms") -> DataFrame:
    return rows.agg(F.count(col).alias("n"), F.avg(col).alias("avg_ms"), F.min(col).alias("min_ms"), F.max(col).alias("max_ms"))


def breakdown(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Rows per decision and query: accepted, kept, each reject tier, other."""
    d = F.col("decision")
    tiers = {f"reject_{t}": F.count_if(d == f"REJECT_TIER_{t}") for t in (0, 1, 2, 9)}
    known = d.isin("ACCEPT", "KEEP_LOW_SIGNAL", *[f"REJECT_TIER_{t}" for t in (0, 1, 2, 9)])
    return rows.groupBy(id_col).agg(F.count_if(d == "ACCEPT").alias("accepted"), F.count_if(d == "KEEP_LOW_SIGNAL").alias("kept"), *[v.alias(k) for k, v in tiers.items()], F.count_if(~F.coalesce(known, F.lit(False))).alias("other"))


def rejects_by_reason(rows: DataFrame, id_col: str = "query_id", doc_col: str = "original_index") -> DataFrame:
    """Per query and reason the rows that aren't accepted or kept, by id."""
    out = rows.where(~F.col("decision").isin("ACCEPT", "KEEP_LOW_SIGNAL"))
    return out.groupBy(id_col, F.coalesce("zero_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(doc_col)).alias("docs"))


def reject_counts(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Per query and reason the number of rows that aren't accepted or kept."""
    out = rows.where(~F.col("decision").isin("ACCEPT", "KEEP_LOW_SIGNAL"))
    return out.groupBy(id_col, F.coalesce("zero_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def tie_summary(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Per query: fine scores used, parse failures, mean latency cut to whole milliseconds."""
    failed = F.contains(F.lower(F.coalesce("tie_breaker_error", F.lit(""))), F.lit("parse"))
    return rows.groupBy(id_col).agg(F.count_if("tie_breaker_used").alias("used"), F.count_if(failed).alias("parse_failed"), F.avg(F.col("tie_breaker_latency_ms").cast("long")).cast("int").alias("avg_latency_ms"))


def flatline(rows: DataFrame, digits: int = 8, most: int = 1, id_col: str = "query_id") -> DataFrame:
    """Per query whether its scores have at most ``most`` different values at that precision."""
    n = F.count_distinct(F.round(F.col("score").cast("double"), digits))
    return rows.groupBy(id_col).agg(n.alias("different"), F.max("score").alias("max_score")).withColumn("flat", F.col("different") <= most)


def tie_info(rows: DataFrame) -> DataFrame:
    """tie_info: what the report says about a row's fine score; null where there was none."""
    e, s, n, ms = (F.col(c) for c in ("tie_breaker_error", "fine_score", "fine_score_norm", "tie_breaker_latency_ms"))
    label = (
        F.when(e.isNotNull() & (e != ""), F.concat(F.lit("ERR("), e, F.lit(")"))).when(s.isNotNull(), F.concat(s.cast("string"), F.lit("%")))
        .when(n.isNotNull(), F.concat(F.rint(n * 100).cast("int").cast("string"), F.lit("%"))).when(F.col("tie_breaker_used"), "used").otherwise("pending")
    )
    out = F.when(ms.isNotNull(), F.concat(label, F.lit(" ("), ms.cast("int").cast("string"), F.lit("ms)"))).otherwise(label)
    return rows.withColumn("tie_info", F.when(F.coalesce("tie_breaker_used", F.lit(False)) | e.isNotNull() | ms.isNotNull(), out))


def report(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """One line per row in final order: group, rank, score, flags for item and domain, snippet."""
    group = F.when(F.col("decision") == "ACCEPT", "accepted").when(F.col("decision") == "KEEP_LOW_SIGNAL", "kept").otherwise("filtered")
    flag = lambda label, value, ok: F.concat(F.lit(f"{label}="), F.coalesce(value, F.lit("-")), match_flag(ok))
    line = F.concat_ws(
        " ", F.format_string("#%d", "rank"), F.format_string("score=%.2f", F.col("score")), flag("item", F.try_element_at(F.col("facts.doc_items"), F.lit(1)), F.col("facts.same_item")),
        flag("domain", F.col("facts.doc_domain"), F.col("facts.same_domain")), F.col("zero_reason"), snippet(F.col("text")),
    )
    return rows.select(id_col, "rank", group.alias("group"), "original_index", line.alias("line"))


def explain_rank(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(F.col("rank") == n)


def max_score(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    return rows.withColumn("max_score", F.max("score").over(Window.partitionBy(id_col)))
