"""Metrics from counts of judgments and from classes, without a row for each pair of a class."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import catalogue
from lodestone.operators import calibration, metrics

DATA = "/root/testdata/sf0.001"


def test_ideals_of_counts_are_those_of_judgments(spark):
    rng = random.Random(4)
    rows = [(q, e, rng.choice([None, 0, 0, 1, 2, 3])) for q in range(30) for e in rng.sample(range(100), rng.randrange(0, 25))]
    qrels = spark.createDataFrame(rows, "query_id long, evidence_id long, grade int")
    gain = (F.pow(2.0, F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "evidence_id")
    want = qrels.withColumn("rank", F.row_number().over(w)).groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= 10, gain).otherwise(0.0)).alias("ideal"), F.count_if(F.col("grade") > 0).alias("relevant"))
    got = {r[0]: r for r in metrics.ideals(metrics.judged(qrels)).collect()}
    want = {r[0]: r for r in want.collect()}
    assert got.keys() == want.keys()
    for q, r in want.items():
        assert abs((got[q].ideal or 0) - (r.ideal or 0)) < 1e-12 and got[q].relevant == r.relevant


def test_judgments_are_not_repeated_for_each_trial(spark):
    """Trials read each judgment once: only the few rows of counts by grade meet the trials."""
    grid = spark.createDataFrame([(k, 0.1 * k, 0.1) for k in range(7)], "trial int, floor double, weight double")
    at = F.timestamp_seconds(F.col("id") % 90 * 86400)
    hits = spark.range(60).select((F.col("id") % 6).alias("query_id"), F.col("id").alias("evidence_id"), (F.col("id") / 60).alias("dense_score"), F.lit(None).cast("int").alias("lexical_rank"), (F.col("id") / 99).alias("fusion_score"), at.alias("timestamp"), F.lit("latest").alias("mode"), F.timestamp_seconds(F.lit(90 * 86400)).alias("latest"))
    other = hits.select("query_id", "evidence_id", (F.floor(F.col("evidence_id") / 6) + 1).alias("rank"))
    classes = spark.range(60).select(F.col("id").alias("evidence_id"), F.when(F.col("id") % 11 > 0, F.col("id") % 4).alias("class"))
    asked = spark.range(6).select(F.col("id").alias("query_id"), (F.col("id") % 4).alias("class"))
    qrels = classes.join(asked, "class").select("query_id", "evidence_id", F.lit(3).alias("grade"))
    queries = spark.range(7).select(F.col("id").alias("query_id"))
    plain = calibration.trials(hits, {"dense": other}, grid, qrels, queries)
    graded = lambda x: metrics.graded_by_class(x, classes, asked)
    counts = metrics.judged_by_class(classes, asked)
    by_class = calibration.trials(graded(hits), {"dense": graded(other)}, grid, None, queries, counts=counts)
    assert sorted(map(tuple, plain.select("trial", "ndcg", "mrr").collect())) == sorted(map(tuple, by_class.select("trial", "ndcg", "mrr").collect()))
    assert plain.count() == 8 and plain.where("ndcg > 0").count() > 1

    seen = spark.sparkContext.accumulator(0)
    marked = qrels.withColumn("grade", F.col("grade") + F.udf(lambda k: seen.add(1) or 0, "int")("evidence_id"))
    calibration.trials(hits, {"dense": other}, grid, marked, queries).collect()
    assert 0 < seen.value <= 2 * qrels.count()  # graded and counted; no longer once for each of the trials


def test_no_row_for_each_pair_of_a_class(spark, monkeypatch):
    """Relevant vectors of a query are a tenth of all: queries that rank don't make these pairs."""

    def refused(t):
        raise AssertionError("all pairs of a class")

    want = {n: sorted(map(tuple, catalogue.queries()[n](spark, DATA).collect())) for n in ("temporal_correctness", "experiment_choice")}
    monkeypatch.setattr(catalogue._Tables, "same_label", property(refused))
    for name, rows in want.items():
        assert rows and sorted(map(tuple, catalogue.queries()[name](spark, DATA).collect())) == rows
