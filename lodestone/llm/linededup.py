"""Line deduplication over a suffix array of line sequences, by distributed prefix doubling.

Each text is a sequence of line names; the suffixes of all texts are ranked by their first 1, 2, 4, ... lines. A
rank is named by the first position (text, line) whose suffix has it, so equal ranks are equal lines, with no
collision of hashes beyond the 128 bits of a line. Only suffixes that share their rank go on to the next round.
Intervals of suffixes with a common prefix of m lines are read from two overlapping ranks of 2^j <= m lines.

A run of consecutive lines with ``min_words`` words or more is deleted wherever it occurs after its first
occurrence. Any such run is the union of the shortest runs of that weight that start, or end, at one of its lines;
so these alone are looked up, and what they cover together are the maximal repeated runs.

Everything is DataFrame operations. Null texts count as empty, one line without words. Blank lines belong to runs
but weigh nothing. "First" is by id, then line; where ids are null or repeat, rows are numbered instead. Wholly
repeated texts stay as empty rows. Extra columns are kept as they are, whatever their names, and columns that the result
adds have underscores behind theirs where these are taken; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm._common import WORD, attach, packed, stage, unpacked

MIN_WORDS = 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _ranked(rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows that share ``keys`` with another, with ``r``, the first position of these; staged."""
    rows = stage(rows.select(F.struct(*keys).alias("__key"), "uid", "line", *keep))
    groups = rows.groupBy("__key").agg(F.min(F.struct("uid", "line")).alias("r"), F.count("*").alias("__n"))
    return stage(attach(rows, stage(groups.where("__n > 1")), "__key", "__n", rows.count()).select("uid", "line", "r", *keep))


def _shortest(rows: DataFrame, least: int) -> DataFrame:
    """The shortest runs of ``least`` words that start or end at a line, within stretches of ``rows``: uid, line, m."""
    by = Window.partitionBy("uid").orderBy("line")
    rows = rows.withColumn("stretch", F.col("line") - F.row_number().over(by))
    own = Window.partitionBy("uid", "stretch").orderBy("line")
    rows = rows.withColumn("to", F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("since", F.col("to") - F.col("words"))
    key = ["uid", "stretch"]
    # as-of lookups: the ends at or after the sum a start asks for, and the starts at or before what an end asks for
    ends = rows.select(*key, F.col("to").alias("at"), F.lit(0).alias("ask"), "line").unionByName(rows.select(*key, (F.col("since") + least).alias("at"), F.lit(1).alias("ask"), "line"))
    seen = Window.partitionBy(*key).orderBy(F.desc("at"), "ask", F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    forth = ends.withColumn("end", F.last(F.when(F.col("ask") == 0, F.col("line")), True).over(seen)).where("ask = 1 and end is not null").select("uid", "line", (F.col("end") - F.col("line") + 1).alias("m"))
    starts = rows.select(*key, F.col("since").alias("at"), F.lit(0).alias("ask"), "line").unionByName(rows.select(*key, (F.col("to") - least).alias("at"), F.lit(1).alias("ask"), "line"))
    seen = Window.partitionBy(*key).orderBy("at", "ask", "line").rowsBetween(Window.unboundedPreceding, 0)
    back = starts.withColumn("start", F.last(F.when(F.col("ask") == 0, F.col("line")), True).over(seen)).where("ask = 1 and start is not null").select("uid", F.col("start").alias("line"), (F.col("line") - F.col("start") + 1).alias("m"))
    return forth.unionByName(back).where("m > 0").distinct()


def repeated_runs(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal runs of lines that have an earlier copy, of ``texts`` (uid, text): uid, s, e (end exclusive)."""
    if min_words < 1:
        raise ValueError("a run weighs a word at least")
    lines = texts.select("uid", F.posexplode(_lines(F.col("text"))).alias("line", "x"))
    lines = lines.select("uid", F.col("line").cast("long"), F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b"), F.regexp_count("x", F.lit(WORD)).cast("long").alias("words"))
    level = _ranked(lines, ["a", "b"], ["words"])
    runs = stage(_shortest(level, min_words))
    longest = runs.agg(F.max("m")).first()[0] or 0
    ranks = level.select("uid", "line", F.lit(0).alias("j"), "r")
    j = 0
    while 2 << j <= longest:
        ahead = Window.partitionBy("uid").orderBy("line").rangeBetween(1 << j, 1 << j)
        pairs = level.select("uid", "line", F.col("r").alias("r0"), F.first("r").over(ahead).alias("r1")).where("r1 is not null")
        level = _ranked(pairs, ["r0", "r1"], [])
        j += 1
        ranks = ranks.unionByName(level.select("uid", "line", F.lit(j).alias("j"), "r"))
    runs = runs.withColumn("j", F.length(F.bin("m")) - 1).withColumn("tail", F.expr("line + m - shiftleft(1L, j)"))
    runs = runs.join(ranks.withColumnRenamed("r", "r0"), ["uid", "line", "j"])
    runs = runs.join(ranks.select("uid", F.col("line").alias("tail"), "j", F.col("r").alias("r1")), ["uid", "tail", "j"])
    later = _ranked(runs, ["m", "r0", "r1"], ["m"]).where(F.col("r") != F.struct("uid", "line"))
    spans = later.select("uid", F.col("line").alias("s"), (F.col("line") + F.col("m")).alias("e"))
    before = Window.partitionBy("uid").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("s") <= F.max("e").over(before), 0).otherwise(1)
    number = F.sum("new").over(Window.partitionBy("uid").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    return spans.groupBy("uid", "s").agg(F.max("e").alias("e")).withColumn("new", new).withColumn("run", number).groupBy("uid", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines deleted from ``text``; adds __lines, __deleted, __runs."""
    columns = docs.columns
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").limit(1).count()
    docs = packed(docs)
    docs = stage(docs.withColumn("__uid", F.monotonically_increasing_id())) if unclear else docs.withColumn("__uid", F.col("doc_id"))
    runs = repeated_runs(docs.select(F.col("__uid").alias("uid"), "text"), min_words)
    runs = stage(runs.groupBy(F.col("uid").alias("__uid")).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("__spans")))
    spans, lines = F.col("__spans"), _lines(F.col("text"))
    n = F.size(spans)
    end = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(spans, k - 1)["e"]).cast("int")
    start = lambda k, all_lines: F.when(k == n, all_lines).otherwise(F.get(spans, k)["s"]).cast("int")
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(F.col("__x"), end(k) + 1, start(k, F.size("__x")) - end(k))))
    out = docs.join(runs.hint("merge"), "__uid", "left").withColumn("__x", lines)  # never a broadcast: runs grow with the texts
    out = out.withColumn("text", F.when(spans.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    gone = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    added = {"__lines": F.size("__x").cast("long"), "__deleted": F.coalesce(gone, F.lit(0)), "__runs": F.when(spans.isNull(), 0).otherwise(n).cast("long")}
    return unpacked(out, columns, added)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """How many lines of each of ``documents`` go, and what stays."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__deleted").alias("n_deleted"), F.col("__runs").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
