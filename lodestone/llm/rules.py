"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text; the ledger keeps its measurements and one failure bit for each rule.
A policy is a named, versioned mask of rejecting bits, so that applying another version, or asking what each rule
rejects alone, is bit arithmetic over the ledger and never reads the texts again.

Null and empty texts have no words: all measurements are zero, and they fail ``few_words``. A text of any length
is measured whole; repeated rows get a ledger row each, and an empty table gives an empty ledger. Extra columns aren't
in the ledger; ``passing`` keeps them as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

#: Bit number and condition of each rule; bits are never reused.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 20"),
    "repeated_windows": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words and n_symbols >= 5"),
    "duplicate_lines": (3, "n_dup_lines >= 10 and 10 * n_dup_lines > n_words"),
    "long_words": (4, "n_words >= 20 and word_chars > 25 * n_words"),
    "short_words": (5, "n_words >= 20 and word_chars < 2 * n_words"),
}


@dataclass(frozen=True)
class Policy:
    """A version of which rules reject."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("web", 1, tuple(RULES))


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five measurements of a text, in the order of ``MEASURES``."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    chars = sum(map(len, words))
    if not data.isascii():
        chars -= sum(np.bincount(np.frombuffer(data, np.uint8) >> 6, minlength=4)[2:3].tolist())  # continuation bytes
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = data.split(b"\n")
    dup = 0
    if len(lines) > 1:
        lines = [x for x in lines if x and not x.isspace()]
        dup = len(lines) - len(set(lines))
    return n, chars, symbols, dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter([names.setdefault(w, len(names)) for w in words], np.int64, len(words))
    if len(names) > len(words) - WINDOW // 2:
        return 0  # a window found twice repeats eight words, or one word over and over
    for width in (1, 2, 4):  # names of windows of 2, 4 and 8 words, by doubling
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    many = (np.bincount(ids) > 1)[ids]
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(many)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            cols = zip(*[measure(x.as_py()) for x in part.column(1)], strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", *MEASURES])


def fail_bits(prefix: str = "") -> Column:
    """One bit for each failed rule, from the measurements (whose columns may have a prefix)."""
    bits = F.lit(0)
    for bit, cond in RULES.values():
        for m in MEASURES:
            cond = re.sub(rf"\b{m}\b", prefix + m, cond)
        bits = bits + F.when(F.expr(cond), F.lit(1 << bit)).otherwise(F.lit(0))
    return bits.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits of every row of ``docs`` (doc_id, text; other columns are ignored)."""
    return docs.select("doc_id", "text").mapInArrow(_measure_batches, _LEDGER).withColumn("fail_bits", fail_bits())


def apply_policy(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with ``kept``: no rejecting bit of the policy is set."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of the policy: rows that fail it, that only it rejects, and that are kept without it."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    counts = rows.groupBy(hit.alias("bits")).agg(F.count("*").alias("n"))  # one row for each combination of bits
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in policy.rules]))
    x = counts.select("bits", "n", rules.alias("r"))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    return x.groupBy("r.rule").agg(total(fails)("failed"), total(F.col("bits") == F.col("r.bit"))("only"), total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0)("kept_without"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of every whole text of ``documents`` with the base and the default policy's verdicts."""
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0).withColumn("policy", F.lit(f"{DEFAULT.name}@{DEFAULT.version}"))


def passing(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they are; no rows move."""
    at = docs.columns.index("text")
    lead = "__"
    while any(c.lower().startswith(lead) for c in docs.columns):
        lead += "_"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + ", ".join(f"{lead}{m} long" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                cols = zip(*[measure(x.as_py()) for x in part.column(at)], strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.int64()) for c in cols]], names=[*part.schema.names, *[f"{lead}{m}" for m in MEASURES]])

    rows = docs.mapInArrow(run, ddl)
    return rows.where(fail_bits(lead).bitwiseAND(F.lit(policy.mask)) == 0).select(*[f"`{c}`" for c in docs.columns])
