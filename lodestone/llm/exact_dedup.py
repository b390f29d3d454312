"""Exact deduplication: two-pass Bloom filtering, so that only possibly repeated rows shuffle.

Pass one folds a 64-bit hash of every text to two slots of a bounded bit space and keeps the slots that two or
more texts hit. Pass two tests each row against that bitmap: a row with a slot nobody else hit is unique, and
passes straight through. Only the others are shuffled, on SHA-256, and grouped exactly. The bitmap takes at
most ``MAX_BITS``/8 bytes whatever the input; once it fills up, more rows take the exact path and none is lost.

Nulls count as empty texts; equal texts keep the largest id. Null ids sort first; an empty table gives an empty
result. Two rows that share both text and id are two members of the group, and both are marked kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import attach, stage

#: Bits for each row that the filter is laid out for, and its bounds (4 KiB to 32 MiB).
BITS_PER_ROW, MIN_BITS, MAX_BITS = 16, 1 << 15, 1 << 28
_BLOCK = 32768  # bits in a bitmap_construct_agg value


def _bits(rows: int) -> int:
    m = MIN_BITS
    while m < min(rows * BITS_PER_ROW, MAX_BITS):
        m *= 2
    return m


def _slot(h: Column, m: int, k: int) -> Column:
    """The k-th slot of a hash: its low or its high half."""
    return F.pmod(h if k == 0 else F.shiftrightunsigned(h, 32), F.lit(m))


def _bit(bitmap: Column, slot: Column) -> Column:
    p = F.pmod(slot, F.lit(_BLOCK))
    byte = F.conv(F.hex(bitmap.substr((p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(p, F.lit(8)).cast("int") + 1)) != 0


def repeated_slots(hashes: DataFrame, m: int) -> DataFrame:
    """The bitmap of the slots that two or more rows of ``hashes`` (h long) hit: columns block, bits (4 KiB each)."""
    both = F.array_distinct(F.array(_slot(F.col("h"), m, 0), _slot(F.col("h"), m, 1)))
    twice = hashes.select(F.explode(both).alias("slot")).groupBy("slot").count().where("count > 1")
    return twice.groupBy((F.col("slot") / _BLOCK).cast("long").alias("block")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(_BLOCK))).alias("bits"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    m = _bits(docs.count())
    blocks = m // _BLOCK
    bitmap = repeated_slots(docs.select(F.xxhash64(text).alias("h")), m)
    # one row per 4 KiB block and at most MAX_BITS of them: a proven bound for the broadcast
    bitmap = stage(bitmap.where(F.col("block").between(0, blocks - 1)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    for k in (0, 1):
        b = F.broadcast(bitmap.select(F.col("block").alias(f"b{k}"), F.col("bits").alias(f"bits{k}")))
        rows = rows.join(b, (_slot(F.col("h"), m, k) / _BLOCK).cast("long") == F.col(f"b{k}"), "left")
        rows = rows.withColumn(f"hit{k}", F.coalesce(_bit(F.col(f"bits{k}"), _slot(F.col("h"), m, k)), F.lit(False))).drop(f"b{k}", f"bits{k}")
    rows = stage(rows.select("doc_id", "text_sha256", (F.col("hit0") & F.col("hit1")).alias("maybe")))
    maybe = rows.where("maybe").drop("maybe")
    groups = stage(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    exact = attach(maybe, groups, "text_sha256", "group_size", total)
    through = rows.where("not maybe").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = exact.unionByName(through)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row of its text that stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op7_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)""",
}
