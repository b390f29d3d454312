"""Keyed tables that are only added to: versions of rows and tombstones, the last one of each key in force.

A table is a folder. ``v=N`` holds what version N adds or deletes; ``base=N`` is what was in force at N, written by
``compact``. A reader takes the last complete base and the versions after it. A version is written whole or not at all, and
writing it again replaces it, so a stream's batch that is played again changes nothing. Rows lie by a prefix of
their key's hash, so what is looked up by key reads the prefixes it needs.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that rows are kept by.
PREFIX = 2


def prefix(key: str):
    return F.concat(F.lit("p"), F.left(F.sha2(F.col(key).cast("string"), 256), F.lit(PREFIX)))


def _parts(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The last complete base (-1: none) and the complete versions after it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return -1, []
    done: dict[str, set[int]] = {"v": set(), "base": set()}
    for s in fs.listStatus(p):  # a folder for each version since the last clean-up
        m = re.fullmatch(r"(v|base)=(\d+)", s.getPath().getName())
        if m and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            done[m[1]].add(int(m[2]))
    base = max(done["base"], default=-1)
    return base, sorted(v for v in done["v"] if v > base)


def latest(spark: SparkSession, path: str) -> int:
    """The last version; -1 of a table that isn't there."""
    base, versions = _parts(spark, path)
    return versions[-1] if versions else base


def write(rows: DataFrame, path: str, key: str, deleted: DataFrame | None = None, version: int | None = None) -> int:
    """Writes a version: ``rows``, and tombstones of the ``deleted`` keys. A version that is there is replaced."""
    version = latest(rows.sparkSession, path) + 1 if version is None else version
    out = rows.withColumn("__gone", F.lit(False))
    if deleted is not None:
        out = out.unionByName(deleted.select(key).withColumn("__gone", F.lit(True)), allowMissingColumns=True)
    out.withColumn("__part", prefix(key)).write.mode("overwrite").partitionBy("__part").parquet(f"{path}/v={version}")
    return version


def read(spark: SparkSession, path: str, key: str, at: int | None = None, schema: str | None = None) -> DataFrame:
    """The rows in force, at version ``at`` (not before the last base) or now; of rows of one version and key, any one.

    A table without any version is empty if a ``schema`` is given, and raises if not.
    """
    base, versions = _parts(spark, path)
    if at is not None and at < base:
        raise ValueError(f"version {at} was compacted into {base}")
    versions = [v for v in versions if at is None or v <= at]
    out = None
    for kind, v in [("base", base)] * (base >= 0) + [("v", v) for v in versions]:
        try:
            own = spark.read.option("basePath", f"{path}/{kind}={v}").parquet(f"{path}/{kind}={v}").withColumn("__version", F.lit(v))
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue  # a version without rows
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None and schema is not None:
        return spark.createDataFrame([], schema)
    if out is None:
        raise FileNotFoundError(f"no version in {path}")
    if base >= 0 and not versions:
        return out.drop("__gone", "__part", "__version")
    whole = F.struct(*[F.col(f"`{c}`") for c in out.columns])
    last = out.groupBy("__part", key).agg(F.max_by(whole, "__version").alias("x"))  # a row for each key and version
    return last.select("x.*").where("not __gone").drop("__gone", "__part", "__version")


def compact(spark: SparkSession, path: str, key: str) -> int:
    """Writes the rows in force as a base; older versions can go once no reader is at them."""
    version = latest(spark, path)
    rows = read(spark, path, key).withColumn("__gone", F.lit(False)).withColumn("__part", prefix(key))
    rows.write.mode("overwrite").partitionBy("__part").parquet(f"{path}/base={version}")
    return version


def clean(spark: SparkSession, path: str) -> list[str]:
    """Deletes what the last base has made superfluous; the names of the folders."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, gone = _parts(spark, path)[0], []
    for s in fs.listStatus(p):
        m = re.fullmatch(r"(v|base)=(\d+)", s.getPath().getName())
        if m and int(m[2]) <= base and (m[1], int(m[2])) != ("base", base):
            fs.delete(s.getPath(), True)
            gone.append(s.getPath().getName())
    return sorted(gone)
