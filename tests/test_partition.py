"""Partitions over sessions and checkpoints, leaks of three kinds, and views of topics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence, partition

RECORD = "evidence_id string, session_ids array<string>, checkpoint_pks array<string>, topic_key string, partition string"


def _records(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], RECORD)


def _sessions(spark, days):
    return spark.createDataFrame([(s, dt.datetime(2026, 3, d) if d else None) for s, d in days.items()], "session_id string, created_at timestamp")


def test_turns_of_one_checkpoint_link_their_sessions(spark):
    """Two sessions whose only link is a checkpoint that records of each of them name."""
    rows = [("a", ["s0"], ["c1"], None), ("b", ["s1"], ["c1"], None), ("c", ["s2"], ["c2"], None), ("d", ["s3", "s4"], [], None), ("e", ["s4"], None, None), ("f", [], ["c1"], None), ("g", [], [], None), ("h", None, ["c9"], None), ("i", ["c1"], [], None), ("j", ["s5"], [], None)]
    out = partition.partition_records(_records(spark, rows), _sessions(spark, {"s0": 1, "s1": 20, "s2": 1, "s3": 2, "s4": 12, "s5": None, "c1": 2}), "2026-03-05", "2026-03-15")
    got = {r.evidence_id: r.partition for r in out.collect()}
    # s0 and s1 go by the 20th, s3 and s4 by the 12th; the session that is named like a checkpoint isn't it
    assert got == {"a": "evaluation", "b": "evaluation", "c": "train", "d": "validation", "e": "validation", "f": "evaluation", "g": "train", "h": "train", "i": "train", "j": "train"}
    partition.assert_isolated(out)


def test_a_hub_checkpoint_makes_no_pairs(spark):
    rows = [(f"r{k}", [f"s{k}"], ["hub"], None) for k in range(300)]
    edges = partition.record_edges(_records(spark, rows))
    assert edges.count() == 300
    out = partition.partition_records(_records(spark, rows), _sessions(spark, {f"s{k}": 1 + k % 28 for k in range(300)}), "2026-03-05", "2026-03-15")
    assert {r.partition for r in out.collect()} == {"evaluation"}


@pytest.mark.parametrize("kind", ["session", "checkpoint", "topic"])
def test_leaks_raise(spark, kind):
    of = {"session": (["x"], ["c"], "t"), "checkpoint": (["s"], ["x"], "t"), "topic": (["s"], ["c"], "x")}
    other = lambda k: (["s2"] if kind != "session" else ["x"], ["c2"] if kind != "checkpoint" else ["x"], "t2" if kind != "topic" else "x")
    good = spark.createDataFrame([("a", *of[kind], "train"), ("b", *of[kind], "train")], RECORD)
    partition.assert_isolated(good)
    bad = good.union(spark.createDataFrame([("c", *other(kind), "evaluation")], RECORD))
    with pytest.raises(ValueError, match=f"1 of kind {kind} \\(x\\)"):
        partition.assert_isolated(bad)
    with pytest.raises(ValueError, match="no partition"):
        partition.assert_isolated(good.withColumn("partition", F.lit(None).cast("string")))


def test_topic_views(spark):
    day = lambda k: dt.datetime(2026, 3, k)
    ref = lambda n: [(f"f{n}", "parquet", n, None, None, None, None, None, None)]
    ddl = "evidence_id string, evidence_type string, title string, text string, timestamp timestamp, session_ids array<string>, checkpoint_pks array<string>, commit_shas array<string>, files array<string>, partition string, source_refs array<struct<source_file:string,source_kind:string,source_row:long,event_index:long,session_id:string,turn_id:string,checkpoint_pk:string,commit_sha:string,transcript_path:string>>"
    rows = [(f"e{k:02d}", "session", f"T{k}", "x", day(1 + k % 25) if k else None, [f"s{k // 2}"], [f"c{k}"], [], ["a/b.py", f"z{k}/q.py"], "train" if k < 24 else "evaluation", ref(k) * (5 if k == 3 else 1)) for k in range(26)]
    rows += [("late", "session", "L", "x", day(28), ["s90"], [], ["sha"], ["a/b.py"], "validation", ref(99))]
    members = evidence.shaped(spark.createDataFrame(rows, ddl)).drop("partition")
    parts = spark.createDataFrame([(r[0], r[9]) for r in rows], "evidence_id string, partition string")
    records = members.join(parts, "evidence_id")
    topics = evidence.shaped(evidence.topic_evidence(members))
    one = topics.where("topic_key = 'a/b.py'").first()
    got = {r.partition: r for r in partition.topic_views(topics, records).where("topic_key like 'a/b.py@%'").collect()}
    # validation has one session only; evaluation has e24 and e25 of one session
    assert set(got) == {"train"} and one.topic_key == "a/b.py"
    view, own = got["train"], [r for r in rows if r[9] == "train"]
    order = [p for p in one.parent_ids if p in {r[0] for r in own}]
    by = {r[0]: r for r in rows}
    last = sorted(own, key=lambda r: (r[4] or dt.datetime.min, r[0]))[-20:]
    lines = [f"- {r[4].date().isoformat() if r[4] else 'unknown-date'}: {r[2]} [{r[0]}]" for r in last]
    assert view.text == "\n".join(["Observed work topic: a/b.py", *lines])
    assert view.parent_ids == order and view.session_ids == sorted({r[5][0] for r in own}) and view.checkpoint_pks == sorted({r[6][0] for r in own})
    assert view.files == sorted({f for r in own for f in r[8]}) and view.commit_shas == []
    assert [r.source_row for r in view.source_refs] == [x[2] for p in order for x in by[p][10]][:100]
    import hashlib

    assert view.evidence_id == f"{one.evidence_id}:{hashlib.sha256(b'train').hexdigest()[:24]}" and view.topic_key == "a/b.py@train"
    partition.assert_isolated(evidence.shaped(partition.topic_views(topics, records)).join(partition.topic_views(topics, records).select("evidence_id", "partition"), "evidence_id"))


def test_components_of_hard_graphs_take_few_shuffles(spark, monkeypatch):
    """Against plain Python, on chains, stars, loops, nulls and lone nodes; edges that a round has settled aren't written again."""
    import random

    rng = random.Random(4)
    chain = [(f"c{k:04}", f"c{k + 1:04}") for k in range(300)]
    star = [("hub", f"a{k}") for k in range(100)] + [(f"z{k}", "top") for k in range(100)]
    made = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(350)]
    rows = chain + star + made + made[:50] + [("loop", "loop"), ("x", None), (None, "y")]
    alone = ["lone", "n0", None]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in rows + [(x, x) for x in alone]:
        a, b = find(a), find(b)
        if a is not None and b is not None:
            root[max(a, b)] = min(a, b)
    saved, written = partition._saved, []

    def counted(df):
        out = saved(df)
        if set(df.columns) == {"u", "v"}:
            written.append(out.count())
        return out

    monkeypatch.setattr(partition, "_saved", counted)
    out = partition.connected_components(spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame([(x,) for x in alone], "node string")).collect()
    assert len(out) == len(root) and {r.node: r.root for r in out} == {x: find(x) for x in list(root)}
    assert sum(written) < 2.5 * len(rows)
    monkeypatch.setattr(partition, "_HUBS", 10**9)
    again = partition.connected_components(spark.createDataFrame(rows, "src string, dst string")).where("node is not null").collect()
    assert {r.node: r.root for r in again} == {x: find(x) for x in list(root) if x is not None and x != "lone"}
    none = spark.createDataFrame([], "src string, dst string")
    assert partition.connected_components(none).collect() == []
