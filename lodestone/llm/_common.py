"""Helpers the text-corpus operators share: staging, skew-safe group joins, connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group counts as hot when it holds over 1/HOT_SHARE of the rows, so at most HOT_SHARE groups can be hot.
HOT_SHARE = 2000
#: Space, tab, line feed, vertical tab, form feed and carriage return separate words.
WORD = r"[^\x20\x09-\x0D]+"

_staged: dict[str, SparkSession] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; set only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    return found.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(_forget)
    _staged[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _forget() -> None:
    """Delete the staged tables when the driver ends; results read them lazily until then."""
    for path, spark in _staged.items():
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone; the folder then goes with the application's
            return
    _staged.clear()


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until it is none of ``columns``; Spark doesn't tell capitals apart."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns of ``docs`` in one struct ``row``, so that no name of theirs is in the way."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.struct(F.lit(True).alias("none"))).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], added: dict[str, Column]) -> DataFrame:
    """The ``columns`` of what was ``packed``, in their order, then the ``added`` ones under names that are free."""
    old = [F.col(c) if c in ("doc_id", "text") else F.col("row")[c].alias(c) for c in columns]
    return rows.select(*old, *[x.alias(fresh(name, columns)) for name, x in added.items()])


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to one row per group on ``key``, when one group may hold a third of the rows.

    ``groups`` has each key once, with the number of its rows in ``size``, and ``total`` is the number of all
    rows. Groups over total/HOT_SHARE rows, HOT_SHARE at most by counting, are broadcast; their rows don't
    move. All others are small, and are joined by a shuffle on the key. ``groups`` should be staged.
    """
    limit = max(1, total // HOT_SHARE)
    flag = f"__hot_{key}"
    hot = groups.where(F.col(size) > limit)
    rows = rows.join(F.broadcast(hot.select(key, F.lit(True).alias(flag))), key, "left")
    near = rows.where(F.col(flag)).drop(flag).join(F.broadcast(hot), key, "inner")
    far = rows.where(F.col(flag).isNull()).drop(flag).join(groups.where(F.col(size) <= limit), key, how)
    return near.unionByName(far)


#: Bits for each id of a bitmap, and its bounds (4 KiB to 32 MiB).
_ID_BITS, _LEAST_BITS, _MOST_BITS, _BLOCK = 8, 1 << 15, 1 << 28, 1 << 15


def bit_set(bitmap: Column, slot: Column) -> Column:
    """Whether the bit of ``slot`` is set in the ``bitmap`` of its block."""
    p = F.pmod(slot, F.lit(_BLOCK))
    byte = F.conv(F.hex(bitmap.substr((p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(p, F.lit(8)).cast("int") + 1)) != 0


def touched(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` with __maybe, false only where the ``key`` isn't among ``ids``: rows that need no join don't move.

    A bitmap of hashes, of at most 32 MiB whatever the input, is broadcast; once it fills up, more rows are let through.
    """
    m, n = _LEAST_BITS, ids.count()
    while m < min(n * _ID_BITS, _MOST_BITS):
        m *= 2
    slot = F.pmod(F.xxhash64(key), F.lit(m))
    block = (slot / _BLOCK).cast("long")
    bits = stage(ids.select(slot.alias("s"), block.alias("__block")).groupBy("__block").agg(F.bitmap_construct_agg(F.pmod("s", F.lit(_BLOCK))).alias("__bits")))
    out = rows.withColumn("__block", block).join(F.broadcast(bits), "__block", "left")
    return out.withColumn("__maybe", F.coalesce(bit_set(F.col("__bits"), slot), F.lit(False))).drop("__block", "__bits")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a long, b long): columns node, root (the smallest member).

    Alternates large-star and small-star steps until the edges form stars; each round is staged. A hub's
    rows are joined to its minimum by ``attach``, so that no task gets all of a hub's edges.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())

    def tally(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = tally(e)
    while True:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = stage(sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        large = stage(attach(sym, m, "u", "n", 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        m = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = attach(large, m, "u", "n", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = stage(small.union(m.select("u", F.col("m").alias("v"))).distinct())
        now = tally(e)
        if tuple(now) == tuple(seen):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
