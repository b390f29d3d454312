"""A pair of tables co-bucketed on one key: one sorted Parquet file per table and bucket, so that joins need no shuffle.

Rows go through an RDD: each becomes one byte string, (file number, full-row key), whose byte order is the order of the
rows. A partitioner of our own deals them by the file number, ``repartitionAndSortWithinPartitions`` sorts them on the
way (spilling where a partition is large), and the sorted iterator feeds one Parquet writer after the other. The row is
read back from its key, so nothing else moves. A task keeps one row group; a file is written by one task, streaming,
however many rows one key has. Every attempt writes a file of its own, and the driver names those of the attempts that
counted, so lost executors and repeated attempts leave no trace.

``co_bucket`` rewrites a pair of tables that lies in numbered files. A file that holds exactly the rows of one bucket stays
where it is. Children without a parent and those without a key have a bucket of their own, past the others.

Rows sort by the key, then by the other columns left to right; nulls first, strings by UTF-8 bytes, NaN last, -0.0 like
0.0. Repeated rows are kept, as often as they come. Null keys of parents go to the same bucket as those of children, and
join nothing. Empty tables have no files. Columns move by position, so no name can clash; nested types are refused.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm._common import HOT_SHARE, shared_dir, stage

BUCKETS = 600
#: Rows for each task of a shuffle, about; and rows of a row group.
TASK_ROWS, GROUP_ROWS = 100_000, 1 << 16
_RESULT = "table_name string, bucket long, path string, columns string, n_rows long, n_joined long, ids_sha256 string, lineage_sha256 string, rewritten boolean"


class Codec:
    """Rows of an Arrow schema as byte strings: file number, then each column of ``order``, in byte order."""

    def __init__(self, schema: pa.Schema, order: list[int]):
        self.schema, self.order = schema, order
        self.runs: list[list[int] | int] = []  # a run of columns of fixed width, or one of variable width
        for i in order:
            t = schema.field(i).type
            if pa.types.is_string(t) or pa.types.is_binary(t):
                self.runs.append(i)
            elif not (pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_boolean(t) or pa.types.is_date32(t) or pa.types.is_timestamp(t)):
                raise ValueError(f"no byte order for {schema.field(i).name}: {t}")
            elif self.runs and isinstance(self.runs[-1], list):
                self.runs[-1].append(i)
            else:
                self.runs.append([i])
        self.floats = [i for i in order if pa.types.is_floating(schema.field(i).type)]
        self.dtypes = [np.dtype([x for i in run for x in ((f"f{i}", "u1"), (f"v{i}", f">u{self._width(i)}"))]) if isinstance(run, list) else None for run in self.runs]

    def _width(self, i: int) -> int:
        t = self.schema.field(i).type
        return 1 if pa.types.is_boolean(t) else t.bit_width // 8

    def _bits(self, i: int, a: pa.Array) -> np.ndarray:
        """Unsigned numbers in the order of the values; nulls are zero."""
        t, w = self.schema.field(i).type, self._width(i)
        if pa.types.is_boolean(t):
            return a.cast(pa.uint8()).fill_null(0).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(t):
            x = a.fill_null(0).to_numpy(zero_copy_only=False) + 0.0  # -0.0 + 0.0 is 0.0
            x = np.where(np.isnan(x), np.nan, x).astype(f"f{w}")
            u = x.view(f"u{w}")
            top = u.dtype.type(1 << (8 * w - 1))
            return np.where(u & top, ~u, u | top)
        whole = a if pa.types.is_integer(t) else a.view(pa.int32() if w == 4 else pa.int64())
        u = whole.fill_null(0).to_numpy(zero_copy_only=False).view(f"u{w}")
        return u ^ u.dtype.type(1 << (8 * w - 1)) if not pa.types.is_unsigned_integer(whole.type) else u

    def _values(self, i: int, u: np.ndarray, full: np.ndarray) -> pa.Array:
        t, w = self.schema.field(i).type, self._width(i)
        u, null = u.astype(f"u{w}"), ~full
        if pa.types.is_boolean(t):
            return pa.array(u.astype(bool), t, mask=null)
        top = u.dtype.type(1 << (8 * w - 1))
        if pa.types.is_floating(t):
            return pa.array(np.where(u & top, u ^ top, ~u).view(f"f{w}"), t, mask=null, from_pandas=False)
        if pa.types.is_unsigned_integer(t):
            return pa.array(u, t, mask=null)
        x = pa.array((u ^ top).view(f"i{w}"), pa.int32() if w == 4 else pa.int64() if w == 8 else None, mask=null)
        return x if pa.types.is_integer(t) else x.view(t)

    def encode(self, number: np.ndarray, columns: list[pa.Array]) -> list[bytes]:
        parts = [_cut(number.astype(">u2"))]
        for run, dtype in zip(self.runs, self.dtypes, strict=True):
            if dtype is None:
                seen: dict[bytes | None, bytes] = {None: b"\0"}
                values = columns[run].cast(pa.binary()).to_pylist()
                for x in set(values) - {None}:
                    seen[x] = b"\1" + x.replace(b"\0", b"\0\xff") + b"\0\0"
                parts.append([seen[x] for x in values])
            else:
                rows = np.zeros(len(number), dtype)
                for i in run:
                    rows[f"f{i}"] = columns[i].is_valid().to_numpy(zero_copy_only=False)
                    rows[f"v{i}"] = self._bits(i, columns[i])
                parts.append(_cut(rows))
        if self.floats:  # zeros with a sign sort as zeros, and get it back
            signs = [(x == 0) & np.signbit(x) for x in (columns[i].fill_null(0).to_numpy(zero_copy_only=False) for i in self.floats)]
            parts.append(_cut(np.stack(signs, axis=1).astype("u1")))
        return list(map(b"".join, zip(*parts, strict=True)))

    def decode(self, keys: list[bytes]) -> pa.RecordBatch:
        n, at = len(keys), [2] * len(keys)
        out: list[pa.Array | None] = [None] * len(self.schema)
        for run, dtype in zip(self.runs, self.dtypes, strict=True):
            if dtype is None:
                values: list[bytes | None] = []
                for k, (x, p) in enumerate(zip(keys, at, strict=True)):
                    if x[p]:
                        end = x.find(b"\0\0", p + 1)
                        values.append(x[p + 1 : end].replace(b"\0\xff", b"\0"))
                        at[k] = end + 2
                    else:
                        values.append(None)
                        at[k] = p + 1
                out[run] = pa.array(values, pa.binary()).cast(self.schema.field(run).type)
            else:
                w = dtype.itemsize
                rows = np.frombuffer(b"".join([x[p : p + w] for x, p in zip(keys, at, strict=True)]), dtype)
                at = [p + w for p in at]
                for i in run:
                    out[i] = self._values(i, rows[f"v{i}"], rows[f"f{i}"].astype(bool))
        if self.floats:
            signs = np.frombuffer(b"".join([x[p:] for x, p in zip(keys, at, strict=True)]), "u1").reshape(n, -1)
            for k, i in enumerate(self.floats):
                if signs[:, k].any():
                    null = ~out[i].is_valid().to_numpy(zero_copy_only=False)
                    x = out[i].fill_null(0).to_numpy(zero_copy_only=False)
                    out[i] = pa.array(np.where(signs[:, k] == 1, -x, x), self.schema.field(i).type, mask=null, from_pandas=False)
        return pa.RecordBatch.from_arrays(out, schema=self.schema)


def _cut(rows: np.ndarray) -> list[bytes]:
    """Each row's bytes."""
    raw, w = rows.tobytes(), rows.nbytes // max(1, len(rows))
    return [raw[i : i + w] for i in range(0, len(raw), w)]


def _number(key: bytes) -> int:
    """The partitioner: keys go by their file number."""
    return key[0] << 8 | key[1]


def _pack(keys: list[bytes]) -> bytes:
    return np.array([len(keys), *map(len, keys)], "<u4").tobytes() + b"".join(keys)


def _unpack(blob: bytes) -> Iterator[tuple[bytes, None]]:
    n = int.from_bytes(blob[:4], "little")
    ends = (np.cumsum(np.frombuffer(blob, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    at = 4 + 4 * n
    for end in ends:
        yield blob[at:end], None
        at = end


def write_sorted(numbered: DataFrame, schema: StructType, key: str, folder: str, partitions: int) -> list[tuple[int, str, int, str]]:
    """Writes rows into one sorted file for each file number: (number, path, rows, SHA-256 of the keys in file order).

    The first column of ``numbered`` is the number, the others are those of ``schema`` in order, whatever their names.
    The list is as long as there are numbers, 65,536 at most. Files have names of their attempts.
    """
    types = to_arrow_schema(schema)
    first = schema.names.index(key)
    codec = Codec(types, [first, *[i for i in range(len(types)) if i != first]])
    flat = numbered.toDF("n", *[f"c{i}" for i in range(len(types))]).withColumn("n", F.col("n").cast("int"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = codec.encode(b.column(0).to_numpy(), b.columns[1:])
                yield pa.RecordBatch.from_arrays([pa.array([_pack(keys)], pa.binary())], names=["rows"])

    def write(rows: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, str, int, str]]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        for n, own in groupby((x for x, _ in rows), _number):
            name = f"{uuid.uuid4().hex}.parquet"
            count, digest = 0, hashlib.sha256()
            with fs.open_output_stream(f"{path}/{name}") as to, pq.ParquetWriter(to, types) as writer:
                while keys := list(islice(own, GROUP_ROWS)):
                    batch = codec.decode(keys)
                    writer.write_batch(batch)
                    ids = ",".join(["" if x is None else str(x) for x in batch.column(first).to_pylist()])
                    digest.update((ids if not count else f",{ids}").encode())
                    count += len(keys)
            yield n, name, count, digest.hexdigest()

    packed = flat.mapInArrow(encode, "rows binary").rdd.flatMap(lambda r: _unpack(bytes(r[0])))
    dealt = packed.repartitionAndSortWithinPartitions(partitions, _number)
    return [(n, f"{folder}/{name}", count, digest) for n, name, count, digest in dealt.mapPartitions(write).collect()]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, fs, written: list, table_dir: str, label: str) -> dict[int, tuple[str, int, str]]:
    """Names the written files by their numbers: number -> (path, rows, digest)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = {}
    for n, tried, count, digest in written:
        to = f"{table_dir}/{label}-{n:05d}.parquet"
        if not fs.rename(path(tried), path(to)):
            raise OSError(f"{tried} can't be named {to}")
        out[n] = (to, count, digest)
    return out


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """Unsigned CRC-32 of ``s`` and the decimal key; null keys have the bucket after that of children without a parent."""
    return F.coalesce(F.crc32(F.concat(F.lit("s"), key.cast("string"))) % buckets, F.lit(buckets + 1))


def co_bucket(spark: SparkSession, tables: dict[str, DataFrame], starts: dict[str, Column], key: str, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes the pair ``tables`` (parents, then children) into files numbered by ``starts``, then rewrites them by bucket.

    ``starts`` are columns over each table's own columns (numbers from 0 to ``buckets`` + 1). Returns one row per final
    file: table_name, bucket, path, columns, n_rows, n_joined (rows of the bucket's inner join), ids_sha256 (keys in
    file order), lineage_sha256 (number:rows of the starting files), rewritten (false where a starting file stayed).
    """
    if len(tables) != 2 or not 0 < buckets <= 65_534:
        raise ValueError("two tables and 1 to 65,534 buckets are asked for")
    if "://" not in folder and folder.startswith("file:"):
        folder = f"file://{folder[5:]}"
    fs = _fs(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for x in (*tables, "_try"):
        fs.mkdirs(path(f"{folder}/{x}"))
    (parent, a), (child, b) = tables.items()
    ids = a.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n_parents")).join(b.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")), "k", "full")
    ids = stage(ids.where("k is not null").na.fill(0, ["n_parents", "n"]))
    sums = ids.agg(F.sum("n_parents"), F.sum("n")).first()
    total = {parent: sums[0] or 0, child: sums[1] or 0}
    n_joined = dict(ids.groupBy(bucket_of(F.col("k"), buckets)).agg(F.sum(F.col("n_parents") * F.col("n"))).collect())
    # children of keys over 1/HOT_SHARE of the rows, HOT_SHARE keys at most, are told by a list; the others by a merge join
    limit = max(1, total[child] // HOT_SHARE)
    hot = dict(ids.where(F.col("n") > limit).select("k", F.col("n_parents") == 0).collect())
    orphans = ids.where(f"n_parents = 0 and n <= {limit}").select("k", F.lit(True).alias("orphan"))

    def tasks(name: str) -> int:
        return min(buckets + 2, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total[name] // TASK_ROWS))

    rows = []
    for name, df in tables.items():
        at = f"{folder}/{name}"
        first = _put(spark, fs, write_sorted(df.select(starts[name], *[F.col(f"`{c}`") for c in df.columns]), df.schema, key, f"{folder}/_try", tasks(name)), at, "start")
        if not first:
            continue
        k = df.columns.index(key)
        lies = spark.read.schema(df.schema).parquet(at)
        lies = lies.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], F.regexp_extract("_metadata.file_name", r"(\d+)\.parquet$", 1).cast("int").alias("s"))
        mine = lies.withColumn("k", F.col(f"c{k}")).withColumn("bucket", bucket_of(F.col("k"), buckets))
        if name == child:
            here = F.coalesce(F.col("k").isin(list(hot)), F.lit(True)) if hot else F.col("k").isNull()
            alone = F.col("k").isin([k for k, orphan in hot.items() if orphan])
            near = mine.where(here).withColumn("bucket", F.when(alone, buckets).otherwise(F.col("bucket")))
            far = mine.where(~here).join(orphans.hint("merge"), "k", "left").withColumn("bucket", F.when(F.col("orphan"), buckets).otherwise(F.col("bucket")))
            mine = stage(near.unionByName(far.select(*mine.columns)))
        pairs = stage(mine.groupBy("bucket", "s").agg(F.count("*").alias("n")))
        line = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda x: F.concat_ws(":", x["s"], x["n"])))
        lineage = {r[0]: r for r in pairs.groupBy("bucket").agg(F.min("s"), F.max("s"), F.sha2(line, 256)).collect()}
        only = {r[0] for r in pairs.groupBy("s").agg(F.min("bucket").alias("x"), F.max("bucket").alias("y")).where("x = y").collect()}
        stay = {n: s for n, s, t, _ in lineage.values() if s == t and s in only}
        moving = mine.where(~F.col("s").isin(list(stay.values()))) if stay else mine
        moving = moving.select("bucket", *[f"c{i}" for i in range(len(df.columns))])
        last = _put(spark, fs, write_sorted(moving, df.schema, key, f"{folder}/_try", tasks(name)), at, "bucket") if len(stay) < len(lineage) else {}
        for s, (old, _, _) in first.items():
            if s not in stay.values():
                fs.delete(path(old), False)
        for n, (_, _, _, digest) in lineage.items():
            where, count, ids_digest = first[stay[n]] if n in stay else last[n]
            rows.append((name, int(n), where.removeprefix("file://"), ",".join(df.columns), count, int(n_joined.get(n) or 0), ids_digest, digest, n not in stay))
    fs.delete(path(f"{folder}/_try"), True)
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[0], r[1])), _RESULT)


def op11_co_bucketed_pair(spark, sf_dir: str) -> DataFrame:
    """``sales`` and ``sale_lines``, written in files by bucket and by item, then rewritten as one file per table and bucket."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines")}
    b = bucket_of(F.col("sale_id"))
    starts = {"sales": F.when(b % 4 == 1, b - 1).otherwise(b), "sale_lines": F.coalesce(F.crc32(F.col("item_id").cast("string")) % BUCKETS, F.lit(0))}
    return co_bucket(spark, tables, starts, "sale_id", f"{shared_dir(spark)}/op11-{uuid.uuid4().hex}")
