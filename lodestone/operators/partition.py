"""Sampling of sessions, their components, and chronological partitions without leakage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import ids, scoring


def pilot(sessions: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` sessions, in rounds over strata of week, agent, user and number of files."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    n = F.coalesce("files_touched_count", F.lit(0))
    rows = sessions.withColumn("week", F.coalesce(scoring.sunday_week(F.col("created_at")), F.lit("unknown"))).withColumn("size_bin", F.when(n >= 10, "large").when(n >= 3, "medium").otherwise("small"))
    bucket = [F.col("week"), text("agent"), text("user_id"), F.col("size_bin")]
    rows = rows.withColumn("bucket", ids.seeded_rank(seed, *bucket))
    w = Window.partitionBy("bucket").orderBy(ids.seeded_rank(seed, F.col("session_id")), "session_id")
    return rows.withColumn("round", F.row_number().over(w)).orderBy("round", "bucket").limit(size).select("session_id", "round")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; beside the warehouse where the session names none."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_rounds").rstrip("/")


def _saved(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Lineage cut through the folder that the cluster shares."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, root: the smallest node of its component; edges have src and dst.

    Nodes are numbered by a hash that tells them apart, and runs of edges are cut to as few as link the same nodes where they
    lie. In each round a node goes over to the least number beside it, and
    edges inside a node go; numbers are in no order, so the rounds grow with the logarithm of the nodes and soon have few edges.
    Then the steps are joined from the last to the first. Hubs, whose rows would meet in one task, take theirs from a broadcast
    table: at most ``_HUBS`` nodes have over 1/``_HUBS`` of the rows. Rounds are written where all executors see them.
    """
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    ends = _saved((ends.union(nodes.select("node")) if nodes is not None else ends).distinct())
    number = _numbers(ends)
    e = edges.where("src != dst").select(number("src").alias("u"), number("dst").alias("v"))
    e = _saved(e.mapInArrow(_forests(EDGES), e.schema))
    steps: list[tuple[DataFrame, int]] = []
    while n := e.count():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _saved(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
        steps.append((low.select("u", "m"), low.count()))
        half = _with_low(e, low, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = _saved(_with_low(half, low, 2 * n).select(F.col("m").alias("u"), "v").where("u != v").distinct())
    if not steps:
        return ends.select("node", F.col("node").alias("root"))
    last, _ = steps.pop()
    while steps:
        step, n = steps.pop()
        goal = step.groupBy(F.col("m").alias("u")).agg(F.count("*").alias("n")).join(last, "u", "left")
        goal = _saved(goal.select("u", F.coalesce("m", "u").alias("m"), "n"))
        last = _saved(_with_low(step.select(F.col("m").alias("u"), F.col("u").alias("v")), goal, n).select(F.col("v").alias("u"), "m"))
    named = _saved(ends.withColumn("u", number("node")).join(last, "u", "left").select("node", F.coalesce("m", "u").alias("u")))
    roots = _saved(named.groupBy("u").agg(F.min("node").alias("m"), F.count("*").alias("n")))
    return _with_low(named.withColumnRenamed("node", "v"), roots, named.count()).select(F.col("v").alias("node"), F.col("m").alias("root"))


_HUBS = 2000
#: Edges of a run that is cut to as few as link the same nodes.
EDGES = 1 << 20


def _forests(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of every run of about ``most`` edges (u, v) an edge from each node to the first of its part; nested whole, as executors needn't have this package."""

    def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        low = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[low], nodes[root[low]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in range(2)])
            n += batch.num_rows
            if n >= most:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held, strict=True)))], names=["u", "v"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held, strict=True)))], names=["u", "v"])

    return run


def _numbers(nodes: DataFrame) -> Callable[[str], Column]:
    """A hash that tells all ``nodes`` (each once) apart: the first seed under which no two of them meet."""
    seed = 0
    while nodes.groupBy(F.xxhash64(F.lit(seed), "node")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        seed += 1
    return lambda node: F.xxhash64(F.lit(seed), node)


def _with_low(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``rows`` with m, the least neighbour of u; hubs by broadcast."""
    most = max(1, total // _HUBS)
    hubs = F.broadcast(low.where(F.col("n") > most).select("u", F.col("m").alias("__hub")))
    marked = rows.join(hubs, "u", "left")
    near = marked.where("__hub is not null").withColumnRenamed("__hub", "m")
    far = marked.where("__hub is null").drop("__hub").join(low.where(F.col("n") <= most).select("u", "m"), "u")
    return near.select("u", "v", "m").unionByName(far.select("u", "v", "m"))


def assign(dated: DataFrame, validation_from: str, evaluation_from: str) -> DataFrame:
    """partition by cutoffs of group_time; undated groups train."""
    t = F.col("group_time")
    return dated.withColumn("partition", F.when(t >= F.lit(evaluation_from).cast("timestamp"), "evaluation").when(t >= F.lit(validation_from).cast("timestamp"), "validation").otherwise("train"))


def record_edges(records: DataFrame) -> DataFrame:
    """src, dst: each record's first session with its other sessions and its checkpoints.

    Sessions and checkpoints are nodes of two kinds (``s:``, ``c:``), so sessions of one checkpoint are linked through it: a
    checkpoint of many records has an edge for each session, never for each pair of sessions.
    """
    node = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(kind), x))
    every = F.concat(node("s:", "session_ids"), node("c:", "checkpoint_pks"))
    return records.select(every.alias("x")).where("size(x) > 1").select(F.col("x")[0].alias("src"), F.explode("x").alias("dst")).where("src != dst").distinct()


def partition_records(records: DataFrame, sessions: DataFrame, validation_from: str, evaluation_from: str) -> DataFrame:
    """``records`` with a partition. Sessions of one record or of one checkpoint go together, by their latest date.

    sessions: session_id, created_at, each session once. A record without sessions goes with its first checkpoint; what
    has neither, or no date, trains.
    """
    dated = sessions.select(F.concat(F.lit("s:"), "session_id").alias("session_id"), "created_at")
    parts = partition_groups(dated, record_edges(records), validation_from, evaluation_from).select(F.col("session_id").alias("__node"), F.col("partition").alias("__partition"))
    first = F.coalesce(F.concat(F.lit("s:"), F.get("session_ids", F.lit(0))), F.concat(F.lit("c:"), F.get("checkpoint_pks", F.lit(0))))
    found = records.drop("partition").withColumn("__node", first).join(parts, "__node", "left")
    return found.withColumn("partition", F.coalesce("__partition", F.lit("train"))).drop("__node", "__partition")


def partition_groups(sessions: DataFrame, edges: DataFrame, validation_from: str, evaluation_from: str) -> DataFrame:
    """session_id, root, group_time, partition: a component goes by its latest session."""
    parts = connected_components(edges, sessions.select(F.col("session_id").alias("node")))
    by = parts.join(sessions, F.col("node") == F.col("session_id"), "left").groupBy("root").agg(F.max("created_at").alias("group_time"))
    return assign(parts.join(by, "root"), validation_from, evaluation_from).withColumnRenamed("node", "session_id")


#: Parents whose lines and whose citations a topic shows.
LINES, REFS = 20, 100


def topic_views(topics: DataFrame, evidence: DataFrame) -> DataFrame:
    """A view of each topic for each partition in which its parents have two sessions or more.

    topics and evidence are records, evidence with a partition. A view lists its own parents alone, so no partition
    sees what belongs to another; its id, key (``topic@partition``), text, lists and citations are its own, all else is the topic's.
    """
    lists = ("session_ids", "checkpoint_pks", "commit_shas", "files")
    own = evidence.select(F.col("evidence_id").alias("parent"), "partition", F.col("title").alias("of"), F.col("timestamp").alias("at"), F.col("source_refs").alias("refs"), *[F.col(c).alias(f"p_{c}") for c in lists])
    p = _saved(topics.select("evidence_id", F.posexplode("parent_ids").alias("k", "parent")).join(own, "parent"))
    key = ["evidence_id", "partition"]
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"p_{c}")))).alias(c)
    kept = p.groupBy(*key).agg(*[every(c) for c in lists], F.transform(F.array_sort(F.collect_list(F.struct("k", "parent"))), lambda x: x["parent"]).alias("parent_ids")).where("size(session_ids) >= 2")
    late = Window.partitionBy(*key).orderBy(F.desc_nulls_last("at"), F.desc("parent"))
    line = F.concat(F.lit("- "), F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("unknown-date")), F.lit(": "), F.col("of"), F.lit(" ["), F.col("parent"), F.lit("]"))
    lines = p.withColumn("r", F.row_number().over(late)).where(F.col("r") <= LINES).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("x"))), False), lambda x: x["x"]).alias("lines"))
    first = Window.partitionBy(*key).orderBy("k")  # each parent has a citation at least
    refs = p.where("size(refs) > 0").withColumn("r", F.row_number().over(first)).where(F.col("r") <= REFS)
    refs = refs.groupBy(*key).agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "refs"))), lambda x: x["refs"])), 1, REFS).alias("source_refs"))
    views = kept.join(lines, key).join(refs, key, "left").withColumnRenamed("evidence_id", "of")
    rest = topics.drop(*lists, "parent_ids", "source_refs", "partition", "text").withColumnRenamed("evidence_id", "of")
    out = views.join(rest, "of").withColumn("text", F.concat(F.lit("Observed work topic: "), "topic_key", F.lit("\n"), F.array_join("lines", "\n")))
    out = out.withColumn("evidence_id", F.concat("of", F.lit(":"), F.left(F.sha2("partition", 256), F.lit(24))))
    return out.withColumn("topic_key", F.concat_ws("@", "topic_key", "partition")).drop("of", "lines")


def leaks(rows: DataFrame, *key: str) -> DataFrame:
    """Keys in more than one partition."""
    return rows.groupBy(*key).agg(F.count_distinct("partition").alias("partitions")).where("partitions > 1")


def leaked(records: DataFrame) -> DataFrame:
    """kind (session, checkpoint, topic), key, partitions: what lies in more than one partition, in one pass over the records."""
    told = lambda kind, c: F.transform(F.coalesce(F.array_distinct(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    keys = F.concat(told("session", F.col("session_ids")), told("checkpoint", F.col("checkpoint_pks")), told("topic", F.array_compact(F.array("topic_key"))))
    return leaks(records.select("partition", F.explode(keys).alias("x")).select("partition", "x.kind", "x.key"), "kind", "key")


def assert_isolated(records: DataFrame) -> None:
    """Raises if a record has no partition, or a session, checkpoint or topic is in several."""
    if records.where("partition is null").limit(1).count():
        raise ValueError("a record has no partition")
    found = leaked(records).groupBy("kind").agg(F.count("*").alias("n"), F.min("key").alias("first")).collect()  # three kinds
    if found:
        raise ValueError("in several partitions: " + ", ".join(f"{r['n']} of kind {r['kind']} ({r['first']})" for r in sorted(found)))


def report(rows: DataFrame) -> DataFrame:
    """partition, records, sessions."""
    return rows.groupBy("partition").agg(F.count("*").alias("records"), F.count_distinct("session").alias("sessions"))


def report_types(rows: DataFrame) -> DataFrame:
    """partition, evidence_type, records."""
    return rows.groupBy("partition", "evidence_type").agg(F.count("*").alias("records"))
