"""Score calibration: isotonic relevance, logistic answerability, and their use on hits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import scoring
from lodestone.operators.partition import _saved

FEATURES = ("top_score", "margin_2", "margin_10", "overlap_10", "likely_10", "mean_relevance_5")
GATE_AUC, GATE_BALANCED, GATE_RECALL = 0.65, 0.60, 0.80


def pools(rows: DataFrame, fan: int = 8) -> DataFrame:
    """lo, hi, n, total of the pools of an isotonic fit of label on score: rates (total over n) rise from pool to pool.

    Rows of one score are counted first. Pools of adjacent violators are those of the pools of each range of scores, pooled
    again: ranges are pooled apart, then ``fan`` of them together, until one is left. The last step reads pools, not scores.
    """
    x = rows.where("score is not null").groupBy(F.col("score").cast("double").alias("lo")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("label").cast("double")).alias("total"))
    x = x.select("lo", F.col("lo").alias("hi"), "n", "total").repartitionByRange("lo")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list[float]] = []
        for f in frames:
            for lo, hi, n, total in f.itertuples(index=False):
                stack.append([lo, hi, n, total])
                while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
                    lo2, hi2, n2, total2 = stack.pop()
                    stack[-1] = [stack[-1][0], hi2, stack[-1][2] + n2, stack[-1][3] + total2]
        yield pd.DataFrame(stack, columns=["lo", "hi", "n", "total"])

    while True:
        x = _saved(x.sortWithinPartitions("lo").mapInPandas(pooled, "lo double, hi double, n double, total double"))
        if parts == 1:
            return x
        parts = max(1, parts // fan)
        x = x.repartitionByRange(parts, "lo") if parts > 1 else x.coalesce(1)


def isotonic(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Knots of an isotonic fit of label on score: the ends of each pool, with its rate. As many pools as rates, at most."""
    xs, ys = [], []
    for r in sorted(pools(rows).collect()):
        for x in dict.fromkeys((r["lo"], r["hi"])):
            xs.append(x)
            ys.append(r["total"] / r["n"])
    return xs, ys


def relevance(hits: DataFrame, xs: list[float], ys: list[float]) -> DataFrame:
    return hits.withColumn("relevance_probability", scoring.interpolate(F.col("dense_score"), xs, ys))


def query_features(dense: DataFrame, lexical: DataFrame, xs: list[float], ys: list[float], likely: float = 0.5) -> DataFrame:
    """query_id and six features of its rankings (rank, score); ranks that are missing of ten take the last score."""
    at = lambda k: F.coalesce(F.max(F.when(F.col("rank") == k, F.col("score"))), F.min("score"))
    d = dense.where("rank <= 10").withColumn("p", scoring.interpolate(F.col("score"), xs, ys))
    n, last = F.count("*"), F.min_by("p", F.struct("score", -F.col("rank")))
    lacking = F.greatest(F.lit(0), 10 - n)
    over = F.count_if(F.col("p") >= likely) + F.when(last >= likely, lacking).otherwise(0)
    five = (F.sum(F.when(F.col("rank") <= 5, F.col("p")).otherwise(0.0)) + last * F.greatest(F.lit(0), 5 - n)) / 5
    d = d.groupBy("query_id").agg(F.max("score").alias("top_score"), (at(1) - at(2)).alias("margin_2"), (at(1) - at(10)).alias("margin_10"), over.cast("double").alias("likely_10"), five.alias("mean_relevance_5"))
    both = dense.where("rank <= 10").join(lexical.where("rank <= 10").select("query_id", "evidence_id"), ["query_id", "evidence_id"]).groupBy("query_id").agg((F.count("*") / 10).alias("overlap_10"))
    return d.join(both, "query_id", "left").fillna(0.0, ["overlap_10"]).select("query_id", *FEATURES)


def answerability(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> dict:
    """Balanced logistic regression of label on standardized features: mean, scale, weights, bias."""
    stats = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features], F.count("*").alias("n"), F.sum("label").alias("p")).first()
    mean, scale = [stats[f"m_{f}"] for f in features], [stats[f"s_{f}"] or 1.0 for f in features]
    n, p = stats["n"], stats["p"]
    x = rows.select(F.col("label").cast("double"), *[((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, mean, scale, strict=True)])
    x = x.withColumn("weight", F.when(F.col("label") == 1, n / (2.0 * max(p, 1))).otherwise(n / (2.0 * max(n - p, 1))))
    x = VectorAssembler(inputCols=list(features), outputCol="x").transform(x)
    m = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1.0 / n, standardization=False, maxIter=200, tol=1e-10).fit(x)
    return {"mean": mean, "scale": scale, "weights": list(m.coefficients), "bias": m.intercept}


def answer_probability(rows: DataFrame, model: dict, features: tuple[str, ...] = FEATURES) -> DataFrame:
    return rows.withColumn("answerability_probability", scoring.logistic([F.col(f) for f in features], model["mean"], model["scale"], model["weights"], model["bias"]))


def folds(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    """A fold for each group, the same for all its rows."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(k)))


def stratified_folds(rows: DataFrame, key: str, label: str = "label", k: int = 5) -> DataFrame:
    """Folds that each have their share of both labels: rows of a label are dealt in the order of a hash."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(key), key)  # one row for each query
    return rows.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def out_of_fold(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Isotonic predictions of each fold from the others: the rows with ``predicted``."""
    f, out = folds(rows, group, k), None
    for j in range(k):
        xs, ys = isotonic(f.where(F.col("fold") != j))
        part = f.where(F.col("fold") == j).withColumn("predicted", scoring.interpolate(F.col("score"), xs, ys) if xs else F.lit(0.0))
        out = part if out is None else out.unionByName(part)
    return out.drop("fold")


def answer_out_of_fold(rows: DataFrame, key: str = "query_id", k: int = 5) -> DataFrame:
    """Answerability of each fold from the others: the rows (features, label) with ``predicted``."""
    f, out = stratified_folds(rows, key, k=k), None
    for j in range(k):
        train, part = f.where(F.col("fold") != j), f.where(F.col("fold") == j)
        if train.select("label").distinct().count() < 2:
            part = part.withColumn("predicted", F.lit(train.agg(F.avg("label")).first()[0] or 0.0))
        else:
            part = answer_probability(part, answerability(train)).withColumnRenamed("answerability_probability", "predicted")
        out = part if out is None else out.unionByName(part)
    return out.drop("fold")


def fit(pairs: DataFrame, queries: DataFrame, version: str = "1") -> dict:
    """The calibration of dense scores and of queries, with out-of-fold metrics and gates.

    pairs: query_id, score, label of judged hits; queries: query_id, label (answerable) and the two rankings' features
    but those that need the relevance fit, given as a function of it.
    """
    from lodestone.operators import metrics

    rows = pairs.withColumn("score", F.round("score", metrics.PLACES))
    xs, ys = isotonic(rows)
    raw = metrics.best_threshold(rows).first()["threshold"]
    held = out_of_fold(rows, "query_id").select("label", F.round("predicted", metrics.PLACES).alias("score"))
    likely = metrics.best_threshold(held).first()["threshold"]
    relevance = {"x_thresholds": list(map(float, xs)), "y_thresholds": list(map(float, ys)), "raw_score_threshold": raw, "probability_threshold": likely, "enabled_for_filtering": False}
    relevance["metrics"] = {**metrics.binary_metrics(held, likely).first().asDict(), **metrics.calibration_error(held).first().asDict()}
    out = {"version": version, "relevance": relevance}
    asked = queries(xs, ys, likely)
    if asked.select("label").distinct().count() == 2:
        told = answer_out_of_fold(asked).select("label", F.round("predicted", metrics.PLACES).alias("score"))
        at = metrics.best_threshold(told, GATE_RECALL, "balanced_accuracy").first()["threshold"]
        m = metrics.binary_metrics(told, at).first().asDict()
        out["answerability"] = {**answerability(asked), "probability_threshold": at, "metrics": m, "enabled_for_abstention": abstention_gate(m["roc_auc"] or 0.0, m["balanced_accuracy"], m["recall"])}
    return out


def runtime(hits: DataFrame, features: DataFrame, artifact: dict) -> DataFrame:
    """Hits with what the calibration says of them and of their query; none of an abstained query where that is on."""
    hits = annotate(hits, artifact)
    if "answerability" not in artifact:
        return hits
    model = artifact["answerability"]
    p = answer_probability(features, model).select("query_id", "answerability_probability")
    out = hits.join(p, "query_id", "left").withColumn("answerability_threshold", F.lit(model["probability_threshold"]))
    return out.where(F.col("answerability_probability") >= F.lit(model["probability_threshold"])) if model["enabled_for_abstention"] else out


def annotate(hits: DataFrame, artifact: dict, exact_ranks: int = 5) -> DataFrame:
    """Hits with relevance_probability, calibration_version, passes_relevance_threshold, calibration_filtering_enabled and
    lexical_rescue; those that don't pass go where filtering is on."""
    r = artifact["relevance"]
    rescue = F.coalesce(F.col("lexical_rank") <= exact_ranks, F.lit(False))
    ok = F.coalesce(F.col("dense_score") >= r["raw_score_threshold"], F.lit(False)) | rescue
    p = F.coalesce(scoring.interpolate(F.col("dense_score"), r["x_thresholds"], r["y_thresholds"]), F.lit(0.0))
    enabled = bool(r.get("enabled_for_filtering"))
    out = hits.withColumn("relevance_probability", p).withColumn("calibration_version", F.lit(artifact["version"])).withColumn("passes_relevance_threshold", ok)
    out = out.withColumn("calibration_filtering_enabled", F.lit(enabled)).withColumn("lexical_rescue", rescue)
    return out.where("passes_relevance_threshold") if enabled else out


def impact(ranking: DataFrame, qrels: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """stage (before, after a hard threshold on the score) and the means of the retrieval metrics."""
    from lodestone.operators import metrics

    kept = ranking.where(F.col("score") >= threshold)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "evidence_id")))
    told = lambda name, r: metrics.means(metrics.retrieval_metrics(r.select("query_id", "evidence_id", "rank"), qrels, queries)).select(F.lit(name).alias("stage"), "*")
    return told("before", ranking).unionByName(told("after", kept))


def filter_hits(hits: DataFrame, threshold: float, enabled: bool = True, exact_ranks: int = 5) -> DataFrame:
    """Hits over the threshold or among the first lexical ranks; only annotated where the filter is off."""
    ok = F.coalesce(F.col("dense_score") >= threshold, F.lit(False)) | F.coalesce(F.col("lexical_rank") <= exact_ranks, F.lit(False))
    out = hits.withColumn("passes", ok)
    return out.where("passes") if enabled else out


def abstention_gate(auc: float, balanced: float, recall: float) -> bool:
    return auc >= GATE_AUC and balanced >= GATE_BALANCED and recall >= GATE_RECALL


def filter_gate(ndcg: tuple[float, float], recall: tuple[float, float]) -> bool:
    """Before and after: quality isn't lower, and 95 % of the recall stays."""
    return ndcg[1] >= ndcg[0] and recall[1] >= 0.95 * recall[0]


def trials(hits: DataFrame, rankings: dict[str, DataFrame], grid: DataFrame, qrels: DataFrame | None, queries: DataFrame, half_life: float = 30, counts: DataFrame | None = None) -> DataFrame:
    """trial, variant, floor, weight, ndcg, mrr of every hybrid of a ``grid`` and of other ``rankings`` by name, in one plan.

    hits: fused, with dense_score, lexical_rank, fusion_score, timestamp, mode and latest; grid: trial, floor, weight, a few rows;
    rankings: query_id, evidence_id, rank, numbered -1, -2 and so on. Hybrids with a weight are another variant than those without.
    With ``counts`` (query_id, grade, n of all that are judged) in place of ``qrels``, hits and rankings have their grades. Judgments are
    not repeated for each trial.
    """
    from lodestone.operators import metrics, search

    tried = hits.crossJoin(F.broadcast(grid))  # a dozen rows
    tried = tried.where(~(F.coalesce(F.col("dense_score") < F.col("floor"), F.lit(False)) & F.col("lexical_rank").isNull()))
    tried = search.temporal_rerank(tried, F.col("mode"), F.col("latest"), F.col("weight"), half_life)
    # a query of a trial is a query of its own
    own = tried.withColumn("query_id", F.struct("trial", "query_id"))
    columns = ["trial", "query_id", "evidence_id", "rank", *(["grade"] if counts is not None else [])]
    ranked = search.final_rank(own, 50).withColumnRenamed("final_rank", "rank").withColumn("trial", F.col("query_id.trial")).withColumn("query_id", F.col("query_id.query_id")).select(*columns)
    named = grid.select("trial", F.when(F.col("weight") > 0, "hybrid_temporal").otherwise("hybrid").alias("variant"), "floor", "weight")
    for k, (name, ranking) in enumerate(rankings.items(), 1):
        one = grid.sparkSession.range(1).select(F.lit(-k).alias("trial"), F.lit(name).alias("variant"), F.lit(None).cast("double").alias("floor"), F.lit(None).cast("double").alias("weight"))
        named = named.unionByName(one)
        ranked = ranked.unionByName(ranking.where("rank <= 50").withColumn("trial", F.lit(-k)).select(*columns))
    every = F.broadcast(named.select("trial"))
    judged = metrics.judged(qrels) if counts is None else counts
    m = metrics.measured(metrics.graded(ranked, qrels), judged, queries.select("query_id").crossJoin(every))
    by = m.groupBy("trial").agg(F.round(F.avg("ndcg_10"), 9).alias("ndcg"), F.round(F.avg("mrr_10"), 9).alias("mrr"))
    return by.join(F.broadcast(named), "trial")


def choose(tried: DataFrame) -> DataFrame:
    """One row of ``trials``: the variant with the best (ndcg, mrr), the simpler one on ties, with the best hybrid's floor and weight."""
    hybrid = best_trial(tried.where("trial >= 0"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ("lexical", "dense", "hybrid", "hybrid_temporal"))), F.col("variant")), F.lit(9))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("ndcg"), F.desc("mrr"), place)  # a few variants
    best = tried.where("trial < 0").unionByName(hybrid.select(*tried.columns)).withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("variant", "ndcg", "mrr").crossJoin(F.broadcast(hybrid.select("trial", "floor", "weight")))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the best (ndcg, mrr, least weight); the first on ties."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("ndcg"), F.desc("mrr"), "weight", "trial")  # a grid of a few dozen rows
    return trials.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
