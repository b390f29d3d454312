"""Retrieval, answer and calibration metrics as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text

#: Scores are rounded to so many places before they are ranked, which bounds how many differ.
PLACES = 4


def graded(ranking: DataFrame, qrels: DataFrame | None) -> DataFrame:
    """The ranking with grades; unjudged is zero. Without ``qrels`` the ranking has its grades."""
    rows = ranking if qrels is None else ranking.join(qrels, ["query_id", "evidence_id"], "left")
    return rows.withColumn("grade", F.coalesce("grade", F.lit(0)))


def graded_by_class(ranking: DataFrame, classes: DataFrame, asked: DataFrame, grade: int = 3) -> DataFrame:
    """The ranking with ``grade`` where evidence and query are of one class, else zero: no row is made for any other pair of a class.

    classes: evidence_id, class; asked: query_id, class; ids once.
    """
    x = ranking.join(classes.withColumnRenamed("class", "__own"), "evidence_id", "left").join(asked.withColumnRenamed("class", "__asked"), "query_id", "left")
    return x.withColumn("grade", F.when(F.col("__own") == F.col("__asked"), grade).otherwise(0)).drop("__own", "__asked")


def judged(qrels: DataFrame) -> DataFrame:
    """query_id, grade, n: how many are judged so."""
    return qrels.groupBy("query_id", "grade").agg(F.count("*").alias("n"))


def judged_by_class(classes: DataFrame, asked: DataFrame, grade: int = 3) -> DataFrame:
    """``judged`` where all of the query's class have the ``grade``, from the sizes of classes."""
    sizes = classes.groupBy("class").agg(F.count("*").alias("n"))
    return asked.join(sizes, "class").select("query_id", F.lit(grade).alias("grade"), "n")


def ideals(counts: DataFrame) -> DataFrame:
    """query_id, ideal (the gain of the best ten that are ``judged``), relevant."""
    sums = [0.0]  # of the discounts of so many first ranks
    for rank in range(1, 11):
        sums.append(sums[-1] + 1 / math.log2(rank + 1))
    upto = lambda n: F.get(F.array(*map(F.lit, sums)), F.least(n, F.lit(10)).cast("int"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each grade
    x = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    gain = (F.pow(2.0, F.col("grade")) - 1) * (upto(F.col("before") + F.col("n")) - upto(F.col("before")))
    return x.groupBy("query_id").agg(F.sum(gain).alias("ideal"), F.coalesce(F.sum(F.when(F.col("grade") > 0, F.col("n"))), F.lit(0)).alias("relevant"))


def retrieval_metrics(ranking: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, ndcg_10, mrr_10, precision_5, recall_20, recall_50; ranking has query_id, evidence_id, rank."""
    return measured(graded(ranking, qrels), judged(qrels), queries.select("query_id"))


def measured(ranked: DataFrame, counts: DataFrame, queries: DataFrame) -> DataFrame:
    """``retrieval_metrics`` of a ``graded`` ranking and ``judged`` counts; other columns of ``queries`` (as trial) tell rankings of a query apart."""
    keys = queries.columns
    gain = (F.pow(2.0, F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    hit = F.col("grade") > 0
    found = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col("rank") <= 10, gain).otherwise(0.0)).alias("dcg"),
        F.min(F.when(hit & (F.col("rank") <= 10), F.col("rank"))).alias("first"),
        F.count_if(hit & (F.col("rank") <= 5)).alias("h5"),
        F.count_if(hit & (F.col("rank") <= 20)).alias("h20"),
        F.count_if(hit & (F.col("rank") <= 50)).alias("h50"),
        F.count("*").alias("n"),
    )
    x = queries.join(found, keys, "left").join(ideals(counts), "query_id", "left").fillna(0, ["dcg", "h5", "h20", "h50", "n", "ideal", "relevant"])
    recall = lambda h: F.when(F.col("relevant") == 0, 1.0).otherwise(F.col(h) / F.col("relevant"))
    ndcg = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).when(F.col("n") == 0, 1.0).otherwise(0.0)
    return x.select(*keys, F.round(ndcg, 9).alias("ndcg_10"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr_10"), (F.col("h5") / 5).alias("precision_5"), recall("h20").alias("recall_20"), recall("h50").alias("recall_50"))


def temporal_correctness(hits: DataFrame, qrels: DataFrame | None, queries: DataFrame) -> DataFrame:
    """query_id, temporal_correctness of hits (query_id, evidence_id, rank, temporal_score, timestamp) by the mode of queries.

    Without ``qrels`` the hits have their grades.
    Of the first ten, relevant hits count: for current and latest the first one's freshness, one from a half on; for evolution
    the days they are of, three for one; other modes need any, and neutral none.
    """
    good = graded(hits.where("rank <= 10"), qrels).where("grade > 0").groupBy("query_id").agg(F.min_by("temporal_score", "rank").alias("fresh"), F.count_distinct(F.to_date("timestamp")).alias("days"))
    x = queries.select("query_id", "mode").join(good, "query_id", "left")
    value = F.when(F.col("mode") == "neutral", 1.0).when(F.col("fresh").isNull(), 0.0)
    value = value.when(F.col("mode").isin("current", "latest"), F.when(F.col("fresh") >= 0.5, 1.0).otherwise(F.col("fresh")))
    value = value.when(F.col("mode") == "evolution", F.least(F.lit(1.0), F.col("days") / 3)).otherwise(1.0)
    return x.select("query_id", F.round(value, 9).alias("temporal_correctness"))


def coverage(ranking: DataFrame, judgments: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, evidence_coverage, claim_coverage, answerability_correct of the first twenty ranks.

    judgments: query_id, evidence_id, grade, claims; queries: query_id, answerability, claims (ids expected).
    """
    good = judgments.where("grade > 0")
    found = good.join(ranking.where("rank <= 20").select("query_id", "evidence_id").distinct(), ["query_id", "evidence_id"])
    n = good.groupBy("query_id").agg(F.count_distinct("evidence_id").alias("relevant"))
    hit = found.groupBy("query_id").agg(F.count_distinct("evidence_id").alias("covered"))
    asked = queries.select("query_id", F.explode(F.array_distinct("claims")).alias("claim"))
    told = asked.join(found.select("query_id", F.explode("claims").alias("claim")).distinct(), ["query_id", "claim"]).groupBy("query_id").agg(F.count("*").alias("told"))
    x = queries.select("query_id", "answerability", F.size(F.array_distinct("claims")).alias("expected"))
    for part in (n, hit, told):
        x = x.join(part, "query_id", "left")
    x = x.fillna(0, ["relevant", "covered", "told"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    right = (F.col("covered") > 0) == (F.col("answerability") != "unsupported")
    return x.select("query_id", share("covered", "relevant").alias("evidence_coverage"), share("told", "expected").alias("claim_coverage"), right.cast("double").alias("answerability_correct"))


def means(rows: DataFrame) -> DataFrame:
    """One row: the mean of each metric over the queries."""
    return rows.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(c) for c in rows.columns if c != "query_id"])


def semantic_coverage(expected: DataFrame, actual: DataFrame, threshold: float = 0.55) -> DataFrame:
    """query_id, claim_coverage: expected texts (query_id, text) that an actual one is like, by TF-IDF within the query.

    Terms are weighed among a query's own texts, so all moves by query and term.
    """
    rows = expected.select("query_id", "text", F.lit(True).alias("wanted")).unionByName(actual.select("query_id", "text", F.lit(False).alias("wanted")))
    rows = rows.withColumn("k", F.monotonically_increasing_id())
    terms = rows.select("query_id", "k", "wanted", F.explode(text.ngrams(F.col("text"))).alias("term")).groupBy("query_id", "k", "wanted", "term").agg(F.count("*").alias("tf"))
    n = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    df = terms.groupBy("query_id", "term").agg(F.count("*").alias("df")).join(n, "query_id")
    w = terms.join(df, ["query_id", "term"]).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1.0 + F.col("df"))) + 1))
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id", "k"))))
    a = w.where("wanted").select("query_id", "term", F.col("k").alias("a"), F.col("w").alias("wa"))
    b = w.where("not wanted").select("query_id", "term", F.col("k").alias("b"), F.col("w").alias("wb"))
    like = a.join(b, ["query_id", "term"]).groupBy("query_id", "a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 9).alias("s")).where(F.col("s") >= threshold)
    got = like.groupBy("query_id").agg(F.count_distinct("a").alias("got"))
    return rows.where("wanted").groupBy("query_id").agg(F.count("*").alias("wanted")).join(got, "query_id", "left").select("query_id", F.round(F.coalesce("got", F.lit(0)) / F.col("wanted"), 9).alias("claim_coverage"))


def _by_score(rows: DataFrame, *more: Column) -> DataFrame:
    """Positives and negatives of each distinct rounded score, with those at or over it and of all; one window over a bounded table."""
    by = rows.withColumn("score", F.round("score", PLACES)).groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"), *more)
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    out = by.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down))
    return out.withColumn("all_p", F.sum("p").over(whole)).withColumn("all_n", F.sum("n").over(whole))


def binary_metrics(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: roc_auc, average_precision, brier of (label, score); ties share their rank. With a threshold also accuracy,
    balanced_accuracy, precision and recall. Scores count to ``PLACES`` places."""
    run = _by_score(rows, F.sum(F.pow(F.round("score", PLACES) - F.col("label"), 2)).alias("sq"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("score") >= F.lit(threshold), F.col(c))), F.lit(0))
    out = run.agg(
        F.round(F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)), F.sum("p") * F.sum("n")), 9).alias("roc_auc"),
        F.round(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p")), 9).alias("average_precision"),
        F.round(F.sum("sq") / F.sum(F.col("p") + F.col("n")), 9).alias("brier"),
        *([of("p").alias("tp"), of("n").alias("fp"), F.sum("p").alias("ps"), F.sum("n").alias("ns")] if threshold is not None else []),
    )
    if threshold is None:
        return out
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "ps", "ns"))
    recall = F.when(p > 0, tp / p).otherwise(0.0)
    told = {"accuracy": (tp + n - fp) / (p + n), "balanced_accuracy": (recall + F.when(n > 0, (n - fp) / n).otherwise(0.0)) / 2, "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), "recall": recall}
    return out.select("roc_auc", "average_precision", "brier", *[F.round(c, 9).alias(k) for k, c in told.items()])


def reliability_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_score, rate of (label, score in 0..1); the last bin is closed."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.avg(F.col("label").cast("double")), 9).alias("rate"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    b = reliability_bins(rows, bins)
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n"), 6).alias("ece"))


def best_threshold(rows: DataFrame, min_recall: float = 0.0, objective: str = "f1") -> DataFrame:
    """The score with the largest F1, or balanced accuracy, among those with enough recall; ties go to the higher."""
    x = _by_score(rows).where(F.col("tp") >= min_recall * F.col("all_p"))
    recall = F.when(F.col("all_p") > 0, F.col("tp") / F.col("all_p")).otherwise(0.0)
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_p"))
    value = f1 if objective == "f1" else (recall + F.when(F.col("all_n") > 0, 1 - F.col("fp") / F.col("all_n")).otherwise(0.0)) / 2
    x = x.withColumn("value", F.round(value, 9))
    return x.agg(F.max_by("score", F.struct("value", "score")).alias("threshold"), F.max("value").alias("f1" if objective == "f1" else objective))
