"""Command line: ``python -m lumenrank rerank REQUEST.json`` or ``python -m lumenrank demo [--query TEXT | --eval]``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .operators import evaluate, retrieve
from .plans.api import Options, rerank
from .sources import corpora


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lumenrank")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("rerank", help="rerank the documents of a request file")
    one.add_argument("request")
    demo = commands.add_parser("demo", help="rerank the built-in how-to corpus")
    for p in (one, demo):
        p.add_argument("--policy")
        p.add_argument("--top-n", type=int)
        p.add_argument("--report", action="store_true", help="one line per row instead of JSON")
        p.add_argument("--rank", type=int, help="show this rank only")
        p.add_argument("--show-facts", action="store_true", help="each row's facts, too")
        p.add_argument("--explain", action="store_true", help="why documents were filtered, by reason")
    demo.add_argument("--query", help="rank the corpus for this query instead of its own")
    demo.add_argument("--eval", action="store_true", help="metrics of the corpus's queries before and after reranking")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lumenrank").getOrCreate()
    options = Options.from_conf(spark, policy_id=args.policy, top_n=args.top_n)
    rows = Q.howto(spark) if args.command == "demo" else retrieve.requests(corpora.read_requests(spark, args.request))
    if args.command == "demo" and args.query is not None:
        rows = rows.where("query_id = 1").withColumns({"query": F.lit(args.query), "similarity": F.lit(None).cast("double")})
    got = rerank(rows, options)
    if args.command == "demo" and args.eval:
        judged = Q.eval_howto(rerank(rows, replace(options, top_n=None)), spark)
        judged.orderBy("query_id", F.desc("stage")).show(200, truncate=False)
        judged.groupBy("stage").agg(*[F.round(F.avg(c), 4).alias(c) for c in Q.METRICS]).orderBy(F.desc("stage")).show()
        return
    if args.explain:
        evaluate.rejects_by_reason(got).orderBy("query_id", "reason").show(200, truncate=False)
    got = evaluate.explain_rank(got, args.rank) if args.rank else got
    if args.report:
        evaluate.report(got).orderBy("query_id", "rank").select("query_id", "group", "line").show(200, truncate=False)
        if args.show_facts:
            got.orderBy("query_id", "rank").select("query_id", "rank", F.to_json("facts").alias("facts")).show(200, truncate=False)
    else:
        for r in corpora.responses(got, return_documents=options.return_documents, facts=args.show_facts).select("json").toLocalIterator():
            print(r["json"])


if __name__ == "__main__":
    main()
