"""Fusion, filters, temporal scores, grouping and diversification of ranked hits.

Hits are tables keyed by query_id; one query and many are the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import scoring


def fuse(dense: DataFrame, lexical: DataFrame, k: int = scoring.RRF_K) -> DataFrame:
    """Full outer join of two rankings (query_id, evidence_id, rank, score) with the reciprocal rank sum."""
    d = dense.select("query_id", "evidence_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    x = lexical.select("query_id", "evidence_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    both = d.join(x, ["query_id", "evidence_id"], "full")
    return both.withColumn("fusion_score", scoring.reciprocal_rank(F.col("dense_rank"), k) + scoring.reciprocal_rank(F.col("lexical_rank"), k))


def relevance_floor(hits: DataFrame, floor: float) -> DataFrame:
    """Drops hits under the floor that no lexical rank vouches for."""
    return hits.where(~(F.coalesce(F.col("dense_score") < floor, F.lit(False)) & F.col("lexical_rank").isNull()))


def metadata_filter(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """All keys must match; a key matches any of its values, and in an array column any element."""
    kinds = dict(rows.dtypes)
    for key, value in filters.items():
        values = list(value) if isinstance(value, list | tuple | set) else [value]
        if kinds[key].startswith("array"):
            rows = rows.where(F.arrays_overlap(F.col(key), F.array(*map(F.lit, values))))
        else:
            rows = rows.where(F.col(key).isin(*values))
    return rows


def as_of(rows: DataFrame, moment: Column, ts: str = "timestamp") -> DataFrame:
    """Rows no later than the moment; undated rows go."""
    return rows.where(F.col(ts) <= moment)


def temporal_rerank(hits: DataFrame, mode: Column, at: Column, weight: float, half_life: float) -> DataFrame:
    hits = hits.withColumn("temporal_score", scoring.temporal_utility(F.col("timestamp"), mode, at, half_life))
    return hits.withColumn("final_score", F.round(F.col("fusion_score") * (1 + weight * F.col("temporal_score")), 12))


def _order() -> list[Column]:
    return [F.desc("final_score"), F.col("evidence_id")]


def group_hits(hits: DataFrame, limit: int) -> DataFrame:
    """One hit for each group: its best, raised by a tenth of the second and third; with size and the first ten ids.

    Where hits have ``source_refs``, the citations of the first three come along, each place once.
    """
    w = Window.partitionBy("query_id", "group_id").orderBy(*_order())
    r = hits.withColumn("r", F.row_number().over(w))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 10, F.struct("r", "evidence_id")))), lambda x: x["evidence_id"])
    more = [F.min_by("timestamp", "r").alias("timestamp")] if "timestamp" in hits.columns else []
    more += [F.min_by(c, "r").alias(c) for c in ("temporal_score", "dense_score", "dense_rank", "lexical_score", "lexical_rank", "fusion_score") if c in hits.columns]
    if "source_refs" in hits.columns:
        refs = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "source_refs")))), lambda x: x["source_refs"]))
        more.append(distinct_refs(refs).alias("citations"))
    best = r.groupBy("query_id", "group_id").agg(
        F.min_by("evidence_id", "r").alias("evidence_id"),
        F.round(F.max(F.when(F.col("r") == 1, F.col("final_score"))) + 0.1 * F.coalesce(F.sum(F.when(F.col("r").isin(2, 3), F.col("final_score"))), F.lit(0.0)), 12).alias("final_score"),
        F.count("*").alias("group_size"),
        ids.alias("group_member_ids"),
        *more,
    )
    return final_rank(best, limit)


def distinct_refs(refs: Column) -> Column:
    """The first citation of each place."""
    from lodestone.operators.evidence import ref_key

    keys = F.transform(refs, ref_key)
    return F.filter(refs, lambda x, k: F.array_position(keys, ref_key(x)) == k + 1)


def final_rank(hits: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*_order())
    return hits.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= limit)


def diversify(hits: DataFrame, limit: int, target_dates: int = 3) -> DataFrame:
    """The first hit, then those whose days lie farthest from the days chosen, until ``target_dates``; then by rank.

    ``hits`` has final_rank and timestamp. Each of the few picks is a window over the query's hits.
    """
    day = F.to_date("timestamp")
    own = Window.partitionBy("query_id")
    out = hits.withColumn("__day", day).withColumn("__pick", F.when(F.col("final_rank") == 1, 1))
    for pick in range(2, target_dates + 2):
        days = F.array_distinct(F.collect_list(F.when(F.col("__pick").isNotNull(), F.col("__day"))).over(own))
        out = out.withColumn("__days", days)
        far = F.array_min(F.transform("__days", lambda d: F.abs(F.datediff(F.col("__day"), d))))
        ok = F.col("__pick").isNull() & F.col("__day").isNotNull() & ~F.array_contains("__days", F.col("__day")) & (F.size("__days") < min(target_dates, limit))
        ok = F.coalesce(ok, F.lit(False))
        order = Window.partitionBy("query_id").orderBy(F.desc(ok), F.desc(F.when(ok, F.coalesce(far, F.lit(0)))), F.when(F.size("__days") == 0, F.lit(0.0)).otherwise(-F.col("final_score")), "final_rank")
        out = out.withColumn("__r", F.row_number().over(order)).withColumn("__pick", F.when((F.col("__r") == 1) & ok, pick).otherwise(F.col("__pick")))
    order = Window.partitionBy("query_id").orderBy(F.col("__pick").asc_nulls_last(), "final_rank")
    out = out.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= limit)
    return out.drop("__day", "__pick", "__days", "__r")


def latest(rows: DataFrame) -> DataFrame:
    """One row: the last moment of all indexed records, the reference time where a query has none."""
    return rows.agg(F.max("timestamp").alias("latest"))


def allowed(rows: DataFrame, partitions: list[str] | None) -> DataFrame:
    """Rows of these partitions; of all where none are named."""
    return rows if partitions is None else rows.where(F.col("partition").isin(*partitions))


def hybrid_search(dense: DataFrame, lexical: DataFrame, payload: DataFrame, queries: DataFrame, *, floor: float = 0.1, weight: float = 0.2, half_life: float = 30, limit: int = 10, at: DataFrame | None = None) -> DataFrame:
    """Fusion, floor, temporal score, grouping, diversification and final rank.

    payload: evidence_id, timestamp, group_id (and source_refs); queries: query_id, mode, as_of. ``at`` is ``latest`` of all
    indexed records, where the payload is but part of them. Of three times ``limit`` groups the best stay, those of
    evolution questions after their dates have been spread.
    """
    at = latest(payload) if at is None else at
    hits = fuse(dense, lexical).join(payload, "evidence_id").join(queries, "query_id").crossJoin(F.broadcast(at))  # one row
    hits = temporal_rerank(relevance_floor(hits, floor), F.col("mode"), F.coalesce("as_of", "latest"), weight, half_life)
    groups = group_hits(hits, 3 * limit).join(queries.select("query_id", "mode"), "query_id")
    spread = diversify(groups.where("mode = 'evolution'"), limit)
    return groups.where(F.col("mode").isNull() | (F.col("mode") != "evolution")).where(F.col("final_rank") <= limit).unionByName(spread)
