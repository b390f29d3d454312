"""Files beside the tables: JSON of records, answers and runs, configuration, marks of a run, and digests.

What is read or written here through Spark may be of any size; what goes through the driver is one small document.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_answers(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Answers of a folder with one JSON document a file, all levels below."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folder)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path (below ``folder``) and sha256 of every file; the tree's digest is ``tree_digest``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.substring_index("path", folder.rstrip("/") + "/", -1).alias("path"), F.sha2("content", 256).alias("digest"))


def tree_digest(files: DataFrame) -> DataFrame:
    """One row: digest of all paths and their digests, in order."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "path", "digest"))), "\n"), 256).alias("digest"))


def transcript_count(spark: SparkSession, folder: str) -> int:
    """How many JSONL files there are below ``folder``; none where it isn't."""
    p, fs = _file(spark, folder)
    if not fs.exists(p):
        return 0
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder).select("path").count()


def canonical_hash(value: object) -> str:
    """The digest of a small document, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_document(spark: SparkSession, path: str, value: object) -> None:
    """A small JSON document, with sorted keys; a reader sees the old one or the new one, never a part or none."""
    jvm = spark.sparkContext._jvm
    p, _ = _file(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if p.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    fs = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _put(fs.create(part, False), value)
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(part, p, over)


def _put(out, value: object) -> None:
    out.write(bytearray((json.dumps(value, sort_keys=True, indent=2, default=str) + "\n").encode()))
    out.close()


def read_document(spark: SparkSession, path: str) -> object:
    return json.loads("".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))


def mark_once(spark: SparkSession, path: str, value: object) -> None:
    """A mark that a run is over; raises where it is already. Of two runs at once, one makes the mark and the other raises."""
    p, fs = _file(spark, path)
    try:
        out = fs.create(p, False)  # fails where the file is
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        raise RuntimeError(f"this has been run: {path}") from None
    _put(out, value)


def code_digest() -> str:
    """The digest of this library's own files."""
    top = Path(__file__).resolve().parents[1]
    return canonical_hash({str(p.relative_to(top)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(top.rglob("*.py"))})


def run_manifest(spark: SparkSession, stage: str, data: str, config: dict, counts: dict, now: dt.datetime | None = None, inputs: str | None = None) -> dict:
    """What a run read and how: run_id with its time, digests of the inputs (unless given), the configuration and the code, and counts."""
    now = now or dt.datetime.now(dt.UTC)
    inputs = inputs or tree_digest(file_digests(spark, data)).first()["digest"]
    return {"run_id": f"{stage}-{now:%Y%m%dT%H%M%SZ}", "stage": stage, "created_at": now.isoformat(), "inputs": inputs, "config": canonical_hash(config), "code": code_digest(), "counts": counts}


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, stage, created_at, inputs, config of the manifests below ``folder``, the oldest first."""
    return read_answers(spark, folder, "run_id string, stage string, created_at string, inputs string, config string").orderBy("created_at", "run_id")


#: Settings and their defaults; lists of (least, most) bound the numbers.
DEFAULTS = {
    "chunk_chars": 4000, "chunk_overlap": 200, "include_thinking": False, "include_tool_results": True, "pilot_size": 0, "pilot_seed": 7, "validation_from": "2026-03-01", "evaluation_from": "2026-03-10",
    "floor": 0.1, "weight": 0.2, "half_life": 30.0, "limit": 10, "retries": 3, "at_once": 4, "regenerations": 3,
}
BOUNDS = {"chunk_chars": (200, 20_000), "pilot_size": (0, 10**9), "floor": (-1.0, 1.0), "weight": (0.0, 5.0), "half_life": (0.01, 36_500.0), "limit": (1, 1000), "retries": (0, 20), "at_once": (1, 64), "regenerations": (0, 20)}


def load_config(path: str | None = None) -> dict:
    """Settings of a JSON or YAML file over the defaults; unknown names and values out of bounds raise."""
    given: dict = {}
    if path:
        told = Path(path).read_text()
        if path.endswith(".json"):
            given = json.loads(told)
        else:
            import yaml

            given = yaml.safe_load(told) or {}
    if unknown := sorted(set(given) - set(DEFAULTS)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = {**DEFAULTS, **given}
    for name, value in out.items():
        if not isinstance(value, type(DEFAULTS[name])) and not (isinstance(value, int) and isinstance(DEFAULTS[name], float)):
            raise ValueError(f"{name} is of another kind: {value!r}")
        if name in BOUNDS and not BOUNDS[name][0] <= value <= BOUNDS[name][1]:
            raise ValueError(f"{name} is out of bounds: {value!r}")
    if not 0 <= out["chunk_overlap"] < out["chunk_chars"]:
        raise ValueError("the overlap must be less than the size")
    return out
