"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is a ring of five segments. If two differ in at most four bits, some chain of consecutive
segments has, for each of its prefixes, no more differing bits than the prefix's share of the budget: none in the
first, at most one in two, two in three, three in four. Candidates meet on a key that every such three-segment
chain must share: the first segment whole, and two of the four halves of the next two (errors there touch two
halves at most, and only one of the second segment's). The chain test then prunes them before the full Hamming
check. Equal fingerprints are one node throughout.

A block of fingerprints with one key is searched breadth first: each is compared with those not yet reached, so
a dense block yields a spanning forest, never its pairs. Keys with over ``BLOCK`` fingerprints are split in parts
and every two parts meet in a task of their own, so a block's memory is bounded and no link is lost.

Null and empty texts have fingerprint zero, and link like any other. Rows without an id link as all others do, and
their component has the smallest id that there is, null if it has none. Rows that repeat an id are rows of their own: an
id with several texts may be in several components, and links none of them. Ties need no order; equal rows are one node,
columns besides doc_id and text aren't read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import attach, components, stage

SHINGLE, LIMIT, SEED = 4, 4, 42
#: First bit and width of the five segments, and of the two halves of each.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Halves (of the chain's second and third segment) that two fingerprints share; the third's own pair is never needed.
HALVES = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]
BLOCK = 4096
_ROWS = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text: a bit is set if over half of the shingle hashes have it."""
    return int(_fingerprints([text or ""], shingle)[0])


def _votes(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _fingerprints(texts: list[str], shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as xxh

    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    out = np.zeros(len(texts), dtype=np.uint64)
    for k, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            out[k] = xxh(line, SEED)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n, votes = len(words) - shingle + 1, np.zeros(64, np.int64)
        for at in range(0, n, _ROWS):  # bounded memory, however long the text
            to = min(n, at + _ROWS)
            a, b = starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist()
            votes += _votes(np.fromiter([xxh(line[i:j], SEED) for i, j in zip(a, b, strict=True)], np.uint64, to - at))
        out[k] = (weights * (2 * votes > n)).sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = _fingerprints([x or "" for x in part.column(1).to_pylist()], shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _mask(parts: list[tuple[int, int]]) -> int:
    return sum(((1 << width) - 1) << first for first, width in parts)


def _chain(start: int, n: int) -> int:
    """Mask of the ``n`` segments from ``start`` on, around the ring."""
    return _mask([SEGMENTS[(start + i) % 5] for i in range(n)])


def _keys() -> list[tuple[int, int]]:
    """(start segment, mask of the bits that the key holds)."""
    out = []
    for start in range(5):
        halves = []
        for i in (1, 2):
            first, width = SEGMENTS[(start + i) % 5]
            halves += [(first, width // 2), (first + width // 2, width - width // 2)]
        out += [(start, _mask([SEGMENTS[start], halves[a], halves[b]])) for a, b in HALVES]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, start: int, limit: int, sides: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links (positions) of a spanning forest of the fingerprints within ``limit`` bits, by chains from ``start``."""
    chains = [(np.uint64(_chain(start, n)), n * limit // 5) for n in (1, 2, 3, 4)]
    free = np.arange(len(fp))
    while len(free) > 1:
        frontier, free = [int(free[0])], free[1:]
        while frontier and len(free):
            i = frontier.pop()
            x = fp[free] ^ fp[i]
            ok = np.ones(len(x), dtype=bool)
            for mask, most in chains:
                ok &= np.bitwise_count(x & mask) <= most
            ok[ok] = np.bitwise_count(x[ok]) <= limit
            if ok.any():
                found = free[ok]
                free = free[~ok]
                frontier += found.tolist()
                yield from ((i, int(j)) for j in found)


def _search(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: set[tuple[int, int]] = set()
            kinds = batch.column(0).to_numpy()
            for kind, fps, reps in zip(kinds, batch.column(1), batch.column(2), strict=True):
                fp, rep = fps.values.to_numpy().view(np.uint64), reps.values.to_numpy()
                for i, j in _forest(fp, int(kind) // len(HALVES), limit):
                    links.add((int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))))
                if len(links) >= 200_000:
                    yield _pairs(links)
                    links = set()
            if links:
                yield _pairs(links)

    return run


def _pairs(links: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(nodes: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the same nodes as all pairs within ``limit`` bits; ``nodes`` has fp and rep, once each."""
    if not 0 <= limit <= 4:
        raise ValueError("the ring of five segments holds budgets up to 4 bits")
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bits")) for k, (_, mask) in enumerate(_keys())])
    rows = nodes.select("fp", "rep", F.explode(keys).alias("k"))
    shared = stage(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    rows = attach(rows, shared, "k", "n", shared.agg(F.sum("n")).first()[0] or 0).select("fp", "rep", "n", "k.kind", "k.bits")
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.when(parts == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), parts).cast("int"))
    # a part meets itself and every other: (low, high), of which one is its own
    meets = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(mine, j).alias("low"), F.greatest(mine, j).alias("high")))
    rows = rows.withColumn("m", F.explode(meets)).select("kind", "bits", "m.low", "m.high", "fp", "rep")
    blocks = rows.groupBy("kind", "bits", "low", "high").agg(F.collect_list(F.struct("fp", "rep")).alias("x")).where(F.size("x") > 1)
    return blocks.select("kind", F.col("x.fp").alias("fp"), F.col("x.rep").alias("rep")).mapInArrow(_search(limit), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id (smallest id reachable by links)."""
    fps = stage(fingerprints(docs, shingle))
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp", F.col("fp").alias("rep")), limit))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = stage(named)
    told = stage(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")))
    named = stage(attach(named, told, "root", "size", nodes.count()).select("fp", "n", "component_id"))
    out = attach(fps, named, "fp", "n", fps.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` whose fingerprints differ in four bits at most."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
