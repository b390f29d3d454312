"""Best-fit packing of token sequences by exact-complement hashing over the length histogram.

Texts are tokenized once; only (id, piece, length, checksum) moves on. How many pieces have each length is a
table of at most ``capacity`` rows, and the whole plan is made on it: full pieces stand alone; then, from the
longest length down, an index of single, pair and triple length sums gives combinations that fill the gap
exactly, consumed under what is still available; the rest is placed by best fit, longest first, in the bin with
the smallest gap that holds it. The plan says which ranks of each length go to which sequences and offsets;
ranking the pieces of a length is distributed, in the order of partitions.

Null texts count as empty: one end token. Equal ids and texts are packed like any others; an empty table packs
to nothing. A text of any length is cut into pieces of ``capacity``, the first of which may be shorter.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm._common import stage

CAPACITY, END = 2048, 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TokenBytes:
    """Ids, as little-endian 32-bit bytes, of a text.

    Added tokens of the JSON file are cut out first, leftmost and longest, and have their own ids; what is between is encoded
    whole, as looking up its chunks in a cache takes longer than their encoding.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that depend on what is beside them aren't supported")
        self._added = {t["content"]: np.asarray([t["id"]], dtype="<u4").tobytes() for t in added}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None
        self._encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, 4 bytes each."""
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        # every other part is an added token
        return b"".join([self._added[p] if k % 2 else self._plain(p) for k, p in enumerate(self._cut.split(text))])

    def _plain(self, text: str) -> bytes:
        return self._encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def _tokenize(path: str, capacity: int, end: int):
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenBytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = encoder.encode(text.as_py() or "") + tail
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
                    out += [(doc, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every text: doc_id, piece, start, length, ids_crc32."""
    return docs.select("doc_id", "text").mapInArrow(_tokenize(tokenizer, capacity, end), _PIECES)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and how many sequences have each, for the histogram ``counts``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    full: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> int:
        kinds = {x: lengths.count(x) for x in lengths}
        m = min(int(left[x]) // k for x, k in kinds.items())
        if m:
            for x, k in kinds.items():
                left[x] -= m * k
            full.append((lengths, m))
        return m

    if left[capacity]:
        take((capacity,))
    for a in range(capacity - 1, 0, -1):
        if not left[a]:
            continue
        gap = capacity - a
        if left[gap]:
            take((a, gap))
        while left[a]:  # pairs: the two-sum of the gap over lengths still available
            b = np.arange(gap - 1, (gap - 1) // 2, -1)
            ok = b[(left[b] > 0) & (left[gap - b] > 0)]
            if not any(take((a, int(x), int(gap - x))) for x in ok if left[a] and x > 0):
                break
        while left[a]:  # triples: longest filler first, then the two-sum of what remains
            done = False
            for b in range(gap - 2, (gap + 2) // 3 - 1, -1):
                if not left[b] or not left[a]:
                    continue
                rest = gap - b
                c = np.arange(min(b, rest - 1), (rest - 1) // 2, -1)
                for x in c[(left[c] > 0) & (left[rest - c] > 0)]:
                    done |= bool(take((a, b, int(x), int(rest - x))))
                    if not left[a] or not left[b]:
                        break
            if not done:
                break
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    for a in range(capacity, 0, -1):  # best fit of the residuals, all of one length at once
        while left[a]:
            gap = next((g for g in range(a, capacity + 1) if bins.get(g)), None)
            if gap is None:
                per = capacity // a
                whole, over = divmod(int(left[a]), per)
                for lengths, m in (((a,) * per, whole), ((a,) * over, int(over > 0))):
                    if m:
                        at = bins.setdefault(capacity - sum(lengths), {})
                        at[lengths] = at.get(lengths, 0) + m
                left[a] = 0
                break
            lengths, m = bins[gap].popitem()
            per = min(gap // a, int(left[a]))
            use = min(m, int(left[a]) // per)
            if m > use:
                bins[gap][lengths] = m - use
            at = bins.setdefault(gap - per * a, {})
            new = lengths + (a,) * per
            at[new] = at.get(new, 0) + use
            left[a] -= use * per
    return full + [(lengths, m) for at in bins.values() for lengths, m in at.items()]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the ranges of ranks: first rank, first sequence, offset; ranks of a range take one sequence each."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, m in patterns:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + m
            offset += x
        base += m
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def _place(places: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                at, table = np.flatnonzero(length == x), places[int(x)]
                k = np.searchsorted(table[:, 0], rank[at], side="right") - 1
                seq[at], off[at] = table[k, 1] + rank[at] - table[k, 0], table[k, 2]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece of ``docs`` (doc_id long, text string; other columns are ignored) with its sequence and offset."""
    pieces = stage(token_pieces(docs, tokenizer, capacity, end).withColumn("part", F.spark_partition_id()))
    by_part = pieces.groupBy("length", "part").count()
    before = by_part.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = _places(plan_packing(counts, capacity))
    own = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["part", "length"]).withColumn("rank", F.col("own") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(places), _PIECES + ", sequence_id long, offset long")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
