"""Command line: python -m lodestone COMMAND --data FOLDER --out FOLDER ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.plans import commands
from lodestone.sources import artifacts


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("command", choices=["validate", "prepare", "generate", "judge", "index", "query", "answer", "answer-benchmark", "train", "evaluate", "experiment", "calibrate", "audit", "criticize", "usage"])
    p.add_argument("--data", help="folder of the log tables")
    p.add_argument("--out", help="folder of the engine's tables")
    p.add_argument("--config", help="JSON or YAML of settings")
    p.add_argument("--validation-from")
    p.add_argument("--evaluation-from")
    p.add_argument("--pilot", type=int, help="sessions to draw; 0: all")
    p.add_argument("--partitions", nargs="*", help="partitions whose records may be found")
    p.add_argument("--once", action="store_true", help="experiment: freeze the best trial; evaluate: the frozen one, once")
    p.add_argument("--text", help="the question")
    p.add_argument("--as-of")
    p.add_argument("--limit", type=int)
    p.add_argument("--queries", help="Parquet of query_id, query")
    p.add_argument("--qrels", help="Parquet of query_id, evidence_id, grade")
    a = p.parse_args(argv)
    c = artifacts.load_config(a.config)
    limit = a.limit or c["limit"]
    search = {"as_of": a.as_of, "limit": limit, "partitions": a.partitions, "floor": c["floor"], "weight": c["weight"], "half_life": c["half_life"]}
    own = spark is None
    spark = spark or SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.text is not None:
        queries = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(a.text).alias("query"))
    elif a.queries:
        queries = spark.read.parquet(a.queries)
    elif a.command in ("query", "answer", "answer-benchmark", "evaluate", "experiment"):
        p.error("--text or --queries is needed")
    if a.command in ("evaluate", "experiment", "calibrate") and not a.qrels:
        p.error("--qrels is needed")
    qrels = lambda: spark.read.parquet(a.qrels)

    def experiment():
        best = commands.experiment(spark, a.out, queries, qrels(), partitions=a.partitions)
        if a.once:
            commands.freeze(spark, a.out, best.first().asDict())
        return best

    pilot = c["pilot_size"] if a.pilot is None else a.pilot
    run = {
        "validate": lambda: commands.validate(spark, a.data),
        "prepare": lambda: commands.prepare(spark, a.data, a.out, a.validation_from or c["validation_from"], a.evaluation_from or c["evaluation_from"], pilot, c["pilot_seed"], thinking=c["include_thinking"], tool_results=c["include_tool_results"]),
        "generate": lambda: commands.generate(spark, a.out),
        "judge": lambda: commands.judge(spark, a.out),
        "index": lambda: commands.index(spark, a.out, queries=queries if a.queries and "primary_positive_ids" in queries.columns else None),
        "query": lambda: commands.query(spark, a.out, queries, **search).orderBy("query_id", "final_rank"),
        "answer": lambda: commands.answer(spark, a.out, queries, **search),
        "answer-benchmark": lambda: commands.answer_benchmark(spark, a.out, queries, **search),
        "train": lambda: commands.train(spark, a.out),
        "evaluate": lambda: commands.evaluate_once(spark, a.out, queries, qrels()) if a.once else commands.evaluate(spark, a.out, queries, qrels(), a.partitions),
        "experiment": experiment,
        "calibrate": lambda: commands.calibrate(spark, a.out, qrels(), queries if a.queries else None),
        "audit": lambda: commands.audit(spark, a.out),
        "criticize": lambda: commands.criticize(spark, a.out),
        "usage": lambda: commands.usage(spark, a.out),
    }
    out = commands.told(run[a.command]())
    if own:
        spark.stop()
    return out


if __name__ == "__main__":
    print(main())
