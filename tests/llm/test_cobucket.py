"""The co-bucketed pair against plain Python: codec, files, digests, lineage, starting files that stay."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import cobucket


def _key(row: tuple, order: list[int]):
    """Nulls first, strings by their bytes, NaN last, zeros alike."""

    def one(x):
        if x is None:
            return (0,)
        if isinstance(x, float) and math.isnan(x):
            return (2,)
        return (1, x.encode() if isinstance(x, str) else x)

    return [one(row[i]) for i in order]


def test_byte_order_is_row_order_and_rows_come_back():
    rng = random.Random(5)
    schema = pa.schema([("a", pa.float64()), ("k", pa.int64()), ("t", pa.string()), ("d", pa.date32()), ("u", pa.string()), ("w", pa.timestamp("us")), ("f", pa.float32()), ("b", pa.bool_()), ("i", pa.int16())])
    import datetime as dt

    pick = [
        [None, 0.0, -0.0, 1.5, -2.5, math.inf, -math.inf, math.nan, 5e-324], [None, 0, -1, 7, -(2**63), 2**63 - 1], [None, "", "a", "a\0", "a\0b", "é", "\U0001f600", "￿", "ab"],
        [None, dt.date(1969, 12, 31), dt.date(2024, 2, 29)], [None, "", "\0", "\0\0", "z"], [None, dt.datetime(1960, 1, 1), dt.datetime(2024, 5, 1, 3, 4, 5, 678901)], [None, 0.0, -0.0, 2.5], [None, True, False], [None, -3, 3],
    ]
    rows = [tuple(rng.choice(x) for x in pick) for _ in range(3000)]
    columns = [pa.array([r[i] for r in rows], schema.field(i).type, from_pandas=False) for i in range(len(pick))]
    order = [1, 0, 2, 3, 4, 5, 6, 7, 8]
    codec = cobucket.Codec(schema, order)
    import numpy as np

    keys = codec.encode(np.zeros(len(rows), np.int32), columns)
    back = list(zip(*[c.to_pylist() for c in codec.decode(keys).columns], strict=True))
    assert [tuple(map(repr, r)) for r in back] == [tuple(map(repr, r)) for r in rows]  # repr tells -0.0 and NaN
    by = sorted(range(len(rows)), key=lambda k: keys[k])
    want = sorted(range(len(rows)), key=lambda k: _key(rows[k], order))
    assert [_key(rows[k], order) for k in by] == [_key(rows[k], order) for k in want]
    with pytest.raises(ValueError):
        cobucket.Codec(pa.schema([("x", pa.list_(pa.int64()))]), [0])


def _check(rows, tables, bucket, start, first, types):
    """Every file of the result against the ``tables`` (name -> tuples)."""
    for name, own in tables.items():
        order = [first[name], *[i for i in range(len(types[name])) if i != first[name]]]
        final, begin = defaultdict(list), defaultdict(list)
        for r in own:
            final[bucket[name](r)].append(r)
            begin[start[name](r)].append(r)
        got = {r.bucket: r for r in rows if r.table_name == name}
        assert set(got) == set(final)
        for b, mine in final.items():
            mine.sort(key=lambda r: _key(r, order))
            g, lineage = got[b], Counter(map(start[name], mine))
            table = pq.ParquetFile(g.path).read()
            assert table.schema.names == types[name].names and table.schema.types == types[name].types and g.columns == ",".join(types[name].names)
            assert list(zip(*[c.to_pylist() for c in table.columns], strict=True)) == mine and g.n_rows == len(mine)
            assert g.ids_sha256 == hashlib.sha256(",".join("" if r[first[name]] is None else str(r[first[name]]) for r in mine).encode()).hexdigest()
            assert g.lineage_sha256 == hashlib.sha256(",".join(f"{s}:{n}" for s, n in sorted(lineage.items())).encode()).hexdigest()
            s = next(iter(lineage))
            assert g.rewritten == (len(lineage) > 1 or {bucket[name](r) for r in begin[s]} != {b})
    folder = Path(rows[0].path).parent.parent
    assert {str(p) for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")} == {r.path for r in rows}


def _crc(text: str, buckets: int = 600) -> int:
    return zlib.crc32(text.encode()) % buckets


def test_pair_of_hard_rows(spark, tmp_path):
    rng = random.Random(3)
    names = "k: string, sale: long, bucket: long, s: string, n: long, orphan: double, number: int".replace(":", "")
    parents = [(rng.choice([None, "x", "é"]), x, x, "p", 1, 0.5, (x or 0) % 3) for x in [*range(40), 3, 3, None, None]]
    children = [(rng.choice([None, "", "y"]), 7 if rng.random() < 0.4 else rng.choice([None, *range(60)]), rng.randrange(3), "c", None, rng.choice([-0.0, 1.0]), 5) for _ in range(900)]
    children += children[:50]
    tables = {"p": spark.createDataFrame(parents, names).repartition(3), "c": spark.createDataFrame(children, names).repartition(5)}
    starts = {"p": cobucket.bucket_of(F.col("sale"), 16), "c": F.coalesce(F.col("bucket"), F.lit(0))}
    rows = cobucket.co_bucket(spark, tables, starts, "sale", f"{tmp_path}/pair", 16).collect()
    known = Counter(r[1] for r in parents if r[1] is not None)
    own = lambda r: 17 if r[1] is None else _crc(f"s{r[1]}", 16)
    bucket = {"p": own, "c": lambda r: own(r) if r[1] is None or r[1] in known else 16}
    types = {t: pq.ParquetFile(next(r.path for r in rows if r.table_name == t)).schema_arrow for t in tables}
    assert types["p"].names == ["k", "sale", "bucket", "s", "n", "orphan", "number"]
    _check(rows, {"p": parents, "c": children}, bucket, {"p": own, "c": lambda r: r[2]}, {"p": 1, "c": 1}, types)
    joined = Counter()
    for r in children:
        joined[own(r)] += known[r[1]]
    assert all(r.n_joined == (joined[r.bucket] if r.bucket < 16 else 0) for r in rows)
    assert all(not r.rewritten for r in rows if r.table_name == "p")


def test_pair_of_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "sale long, x string")
    starts = {"p": F.lit(0), "c": F.lit(0)}
    assert cobucket.co_bucket(spark, {"p": empty, "c": empty}, starts, "sale", f"{tmp_path}/none", 4).collect() == []
    some = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "sale long, x string")
    rows = cobucket.co_bucket(spark, {"p": empty, "c": some}, starts, "sale", f"{tmp_path}/orphans", 4).collect()
    assert [(r.table_name, r.bucket, r.n_rows, r.n_joined, r.rewritten) for r in rows] == [("c", 4, 2, 0, True), ("c", 5, 1, 0, True)]


def test_op11_against_plain_python(spark):
    from lodestone.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    rows = queries()["op11_co_bucketed_pair"](spark, sf).collect()
    tables, types = {}, {}
    for t in ("sales", "sale_lines"):
        table = pq.read_table(f"{sf}/{t}.parquet")
        tables[t], types[t] = list(zip(*[c.to_pylist() for c in table.columns], strict=True)), table.schema.remove_metadata()
    known = {r[0] for r in tables["sales"]}
    own = lambda r: 601 if r[0] is None else _crc(f"s{r[0]}")
    bucket = {"sales": own, "sale_lines": lambda r: own(r) if r[0] is None or r[0] in known else 600}
    start = {"sales": lambda r: own(r) - (own(r) % 4 == 1), "sale_lines": lambda r: 0 if r[2] is None else _crc(str(r[2]))}
    _check(rows, tables, bucket, start, {"sales": 0, "sale_lines": 0}, types)
