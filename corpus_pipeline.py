"""The corpus pipeline: quality rules, line deduplication, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result in the shared folder, and the next reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import linededup, mixing, packing, rules, simhash
from lodestone.llm._common import stage, touched

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy of quality rules keeps; null and empty texts have too few words and go, repeated rows stay."""
    return rules.passing(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; all rows stay, null texts as they are, and n_chars follows the text."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("__deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, or the first row where ids are null or repeat.

    Fingerprints are those of ``op10``: four-word shingles that differ in four bits of 64 at most. Null and empty texts
    are one group. Rows that go are told by a bitmap first, so that the texts of the others don't move.
    """
    docs, key = docs.select(*COLUMNS), "doc_id"
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        docs, key = stage(docs.withColumn("__row", F.monotonically_increasing_id())), "__row"
    out = simhash.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"))
    gone = stage(out.where("doc_id != component_id").select(F.col("doc_id").alias(key)))
    rows = touched(docs, gone, key)
    stay = rows.where("__maybe").join(gone.hint("merge"), key, "left_anti")
    return rows.where("not __maybe").select(*COLUMNS).unionByName(stay.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the target weights of their domains; rows of one id go or stay together, none is doubled."""
    out = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), thin=True)
    return out.where("copies > 0").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences; a null text is its end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mix), ("packing", pack)]
#: Fingerprints, posteriors and packing are beyond SQL; tests/llm/test_pipeline.py holds the chain, stage by stage, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
