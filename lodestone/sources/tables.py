"""Reading activity logs: validated tables, JSON event transcripts, and the relations between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.ids import json_list

# The tables and columns of the data.
REQUIRED = {
    "sessions": ["session_id", "repo_id", "created_at", "checkpoint_ids"],
    "session_logs": ["session_id", "transcript_path"],
    "conversations": ["turn_id", "session_id", "role", "turn_type", "content"],
    "checkpoints": ["checkpoint_pk", "session_pks", "commit_shas"],
    "commits": ["checkpoint_pk", "status", "patch"],
}


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table with its required columns, and source_row, its rows' place in the table: files in the order of their paths."""
    if name not in REQUIRED:
        raise ValueError(f"unknown table: {name}")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    missing = [c for c in REQUIRED[name] if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return numbered(df, columns or df.columns)


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of a Parquet table as read, and source_row: the place in the file, after the rows of the files before it."""
    at = df.select(*columns, F.col("_metadata.row_index").alias("source_row"), F.col("_metadata.file_path").alias("__file"))
    if len(df.inputFiles()) < 2:
        return at.drop("__file")
    # rows of each file without reading a column; one row for each file
    sizes = df.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.count("*").alias("n"))
    before = sizes.select("__file", (F.sum("n").over(Window.orderBy("__file")) - F.col("n")).alias("__before"))
    return at.join(before, "__file").withColumn("source_row", F.col("source_row") + F.col("__before")).drop("__file", "__before")


def validate(spark: SparkSession, folder: str) -> dict[str, int]:
    """Row counts of all tables; raises for a missing table or column."""
    return {name: read_table(spark, folder, name).count() for name in REQUIRED}


def check_relative(path: str) -> str:
    """The path, unless it leaves its folder."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"path leaves the data folder: {path}")
    return path


def parse_events(texts: DataFrame, path_col: str = "path", text_col: str = "value") -> DataFrame:
    """Events of whole JSONL texts: path, event_index, event (variant; null where malformed), raw, type.

    Any of the three line ends counts, a blank line is a malformed event, and a last line end adds none.
    """
    lines = F.split(F.col(text_col), "\r\n|\n|\r", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    rows = texts.select(F.col(path_col).alias("path"), F.posexplode(lines).alias("event_index", "raw"))
    event = F.try_parse_json("raw")
    kind = F.coalesce(F.try_variant_get(event, "$.type", "string"), F.when(event.isNull(), F.lit("malformed")))
    return rows.select("path", "event_index", "raw", kind.alias("type"), event.alias("event"))


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """All transcripts below a folder as events; invalid UTF-8 is replaced."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_events(texts)


def last_wins(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: the last by source_row."""
    w = Window.partitionBy(key).orderBy(F.desc("source_row"))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def relations(sessions: DataFrame, logs: DataFrame, conversations: DataFrame, checkpoints: DataFrame, commits: DataFrame) -> DataFrame:
    """Each session with its transcript, checkpoints, commits, number of turns, and what is missing."""
    s = last_wins(sessions, "session_id")
    logs = last_wins(logs, "session_id").select("session_id", "transcript_path")
    turns = conversations.groupBy("session_id").agg(F.count("*").alias("turns"))
    pks = s.select("session_id", F.posexplode(json_list(F.col("checkpoint_ids"))).alias("k", "checkpoint_pk"))
    known = last_wins(checkpoints, "checkpoint_pk").select("checkpoint_pk", F.lit(True).alias("known"))
    linked = pks.join(known, "checkpoint_pk", "left")
    by = linked.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("k", "checkpoint_pk")))), lambda x: x["checkpoint_pk"]).alias("checkpoint_pks"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.struct("k", "checkpoint_pk")))), lambda x: F.concat(F.lit("checkpoint:"), x["checkpoint_pk"])).alias("lost"),
    )
    shas = linked.where("known").join(commits.where("commit_sha is not null"), "checkpoint_pk").groupBy("session_id").agg(F.array_sort(F.collect_set("commit_sha")).alias("commit_shas"))
    out = s.select("session_id", "created_at").join(logs, "session_id", "left").join(turns, "session_id", "left").join(by, "session_id", "left").join(shas, "session_id", "left")
    empty = F.array().cast("array<string>")
    missing = F.array_compact(F.array(F.when(F.col("transcript_path").isNull(), F.lit("session_log"))))
    missing = F.concat(missing, F.coalesce("lost", empty), F.array_compact(F.array(F.when(F.col("turns").isNull(), F.lit("conversations")))))
    return out.select("session_id", "created_at", "transcript_path", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("checkpoint_pks", empty).alias("checkpoint_pks"), F.coalesce("commit_shas", empty).alias("commit_shas"), missing.alias("missing"))


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Atomic by the commit protocol of the file writer."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
