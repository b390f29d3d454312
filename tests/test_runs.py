"""Batches, versions, streams, cached calls, criticism, isotonic pools, row numbers and documents, against plain Python."""

import datetime as dt
import json
import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import catalogue
from lodestone.operators import answering, batches, benchmark, calibration
from lodestone.sources import artifacts, tables, versions
from lodestone.streaming import ingest

DATA = "/root/testdata/sf0.001"


def _greedy(examples, ranks):
    """The least free colour for each example, in the order of ranks."""
    of = {}
    for e in sorted(examples, key=lambda e: ranks[e[0]]):
        taken = {of[x[0]] for x in examples if x[0] in of and (e[1] in x[2] or x[1] in e[2])}
        of[e[0]] = next(c for c in range(len(examples) + 1) if c not in taken)
    return of


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_are_those_of_greedy_colouring(spark, seed):
    rng = random.Random(seed)
    item = lambda: f"p{int(rng.paretovariate(0.8)) % 30}"
    examples = [(f"e{k}", item(), sorted({item() for _ in range(rng.randrange(0, 5))})) for k in range(150)]
    examples = [(i, p, [x for x in bans if x != p]) for i, p, bans in examples] + [("lone", "q", []), ("null", "q2", None)]
    df = spark.createDataFrame(examples, "example_id string, positive_id string, excluded_positive_ids array<string>")
    ranks = {r.example_id: (r.h, r.example_id) for r in df.select("example_id", F.xxhash64("example_id").alias("h")).collect()}
    plain = [(i, p, bans or []) for i, p, bans in examples]
    want = _greedy(plain, ranks)
    assert {r.example_id: r.colour for r in batches.colours(df).collect()} == want
    rows = batches.conflict_free_batches(df, 4).collect()
    got = {}
    for r in rows:
        got.setdefault(r.batch, {})[r.place] = r.example_id
    dealt, at = {}, 0
    for c in sorted(set(want.values())):
        own = sorted((i for i in want if want[i] == c), key=lambda i: ranks[i])
        for k in range(0, len(own), 4):
            dealt[at] = dict(enumerate(own[k : k + 4]))
            at += 1
    assert got == dealt and len(rows) == len(examples)
    assert batches.conflicts(batches.conflict_free_batches(df, 4), df).count() == 0


def test_batches_of_the_judged_queries(spark):
    rows = catalogue.queries()["training_batches"](spark, DATA).collect()
    t = catalogue._Tables(spark, DATA)
    x = answering.training_triples(t.qrels.select("query_id").distinct(), t.qrels).withColumn("example_id", F.concat_ws("-", "query_id", "positive_id"))
    assert len(rows) == x.count() > 0 and max(r.place for r in rows) < 16
    assert batches.conflicts(spark.createDataFrame(rows), x).count() == 0


def test_versions_of_clients(spark):
    got = {r.client_id: r.change_id for r in catalogue.queries()["versioned_clients"](spark, DATA).collect()}
    rows = duckdb.sql(f"SELECT client_id, seq, change_id, op FROM '{DATA}/client_changes.parquet' WHERE client_id IS NOT NULL AND seq IS NOT NULL ORDER BY seq, change_id").fetchall()
    last = {c: (k, op) for c, _, k, op in rows}
    assert got == {c: k for c, (k, op) in last.items() if op != "D"} and any(op == "D" for _, op in last.values())


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long")
    now = lambda **a: {r.k: r.v for r in versions.read(spark, path, "k", **a).collect()}
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, "k")
    assert versions.read(spark, path, "k", schema="k string, v long").count() == 0 and versions.latest(spark, path) == -1
    versions.write(rows(("a", 1), ("b", 1), (None, 9)), path, "k")
    versions.write(rows(("a", 2)), path, "k", rows(("b", 0)))
    versions.write(rows(), path, "k")
    assert now() == {"a": 2, None: 9} and now(at=0) == {"a": 1, "b": 1, None: 9} and versions.latest(spark, path) == 2
    versions.write(rows(("a", 2)), path, "k", rows(("b", 0)), version=1)  # played again
    assert now() == {"a": 2, None: 9}
    assert versions.compact(spark, path, "k") == 2 and now() == {"a": 2, None: 9}
    versions.write(rows(("b", 5)), path, "k", rows((None, 0)))
    (tmp_path / "t/v=4").mkdir()  # a version that was never finished
    assert now() == {"a": 2, "b": 5} and versions.latest(spark, path) == 3
    with pytest.raises(ValueError):
        versions.read(spark, path, "k", at=1)
    assert versions.clean(spark, path) == ["v=0", "v=1", "v=2"] and now() == {"a": 2, "b": 5}


def test_a_stream_that_is_played_again_changes_nothing(spark, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    say = lambda *x: spark.createDataFrame([(s, t, dt.datetime(2026, 1, d)) for s, t, d in x], "source string, text string, at timestamp").write.mode("append").parquet(source)
    run = lambda checkpoint: ingest.ingest(spark.readStream.schema("source string, text string, at timestamp").parquet(source), table, f"{tmp_path}/{checkpoint}").awaitTermination()
    now = lambda: {r.source: r.text for r in versions.read(spark, table, "source").collect()}
    say(("x", "one", 1), ("y", "mail a@b.org", 1), ("y", "older", 0 + 1))
    run("c")
    say(("x", "two", 2), ("z", "three", 2))
    run("c")
    assert now()["x"] == "two" and now()["z"] == "three"
    say(("z", None, 3))
    run("c")
    assert set(now()) == {"x", "y"} and versions.latest(spark, table) == 2
    before = now()
    run("c")  # nothing new
    run("another")  # all batches at once, as version 0
    assert set(before) == {"x", "y"} and now()["x"] == "two"


def test_windowed_counts(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 10, m)
    for k, rows in enumerate([[("a", at(1)), ("a", at(4)), ("b", at(6))], [("a", at(50))], [("b", at(51))], [("a", at(2)), ("b", at(52))], [("a", at(59))]]):
        spark.createDataFrame(rows, "event_type string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("event_type string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = ingest.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window.start.minute, r.event_type): r.n for r in spark.table("counts").collect()}
    # what comes at 10:02 when 10:50 has been seen is too late
    assert got[(0, "a")] == 2 and got[(5, "b")] == 1


class Counted:
    """A provider that counts its calls in files, fails as told, and tells how many run at once."""

    def __init__(self, folder, fail=()):
        self.folder, self.fail = str(folder), fail

    def __call__(self, request):
        import os
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(request["q"])
        tries = sum(open(f"{self.folder}/{n}").read() == request["q"] for n in os.listdir(self.folder))
        kind = dict(self.fail).get(request["q"])
        if kind == "always" or kind == "twice" and tries < 3:
            raise RuntimeError("503 try later")
        if kind == "shape":
            return {"grade": "high"}
        if kind == "bound":
            return {"grade": 9}
        return {"grade": len(request["q"]) % 4, "_usage": {"total_tokens": 7, "cost": 0.5}}


def test_calls_are_kept_and_checked(spark, tmp_path):
    made = tmp_path / "calls"
    made.mkdir()
    cache = f"{tmp_path}/cache"
    grade = {"type": "object", "properties": {"grade": {"$ref": "#/$defs/G"}}, "$defs": {"G": {"type": "integer", "minimum": 0, "maximum": 3}}}
    asked = [(k, json.dumps({"q": q})) for k, q in enumerate(["a", "bb", "bb", "flaky", "dead", "odd", "big"])]
    df = spark.createDataFrame(asked, "query_id long, request string")
    provider = Counted(made, (("flaky", "twice"), ("dead", "always"), ("odd", "shape"), ("big", "bound")))
    run = lambda **a: {r.query_id: r for r in answering.cached_complete(df, cache, provider, stage="judge", schema=grade, retries=2, **a).collect()}
    first = run()
    assert json.loads(first[0].response)["grade"] == 1 and first[1].response == first[2].response and first[3].calls == 3
    assert "503" in first[4].error and first[4].calls == 3 and "type integer" in first[5].error and first[5].calls == 1 and "bounds" in first[6].error
    calls = len(list(made.iterdir()))
    assert calls == 1 + 1 + 3 + 3 + 1 + 1
    again = run()
    assert len(list(made.iterdir())) == calls + 5, "only what failed is asked again"
    assert all(again[k].response == first[k].response and again[k].calls == 0 for k in (0, 1, 2, 3))
    assert {(r.stage, r.requests, r.tokens, r.cost) for r in answering.usage(answering.read_cache(spark, cache)).collect()} == {("judge", 3, 21, 1.5), (None, 3, 21, 1.5)}
    other = {r.query_id: r for r in answering.cached_complete(df.where("query_id = 0"), cache, provider, stage="other", schema=grade).collect()}
    assert other[0].calls == 1, "another stage asks anew"


def test_misfits():
    schema = answering.strict_schema({"type": "object", "properties": {"a": {"type": ["string", "null"]}, "b": {"type": "array", "items": {"enum": [1, 2]}}}})
    fit = lambda x: answering.misfit(x, schema)
    assert fit({"a": None, "b": [1, 2]}) is None and fit({"a": "x", "b": []}) is None
    assert "lacks b" in fit({"a": "x"}) and "has c" in fit({"a": "x", "b": [], "c": 1}) and "b[1]" in fit({"a": "x", "b": [1, 3]}) and "type object" in fit([1])
    assert "type string" in fit({"a": True, "b": []})


def test_criticism_takes_two_shuffled_passes_in_the_evaluation(spark):
    ids = [f"e{k}" for k in range(6)]
    ev = spark.createDataFrame([(i, "turn", "t", f"text of {i}", None, [], [], []) for i in ids], "evidence_id string, evidence_type string, title string, text string, timestamp timestamp, session_ids array<string>, commit_shas array<string>, files array<string>")
    q = spark.createDataFrame([("q1", "a question?", "supported", "neutral", "evaluation", None, ids, [], []), ("q2", "b", "supported", "neutral", "train", None, ids[:1], ["gone"], None), ("q3", "c", "unsupported", "neutral", "evaluation", None, [], [], [])], "query_id string, query string, answerability string, temporal_mode string, partition string, expected_claims string, generation_source_ids array<string>, primary_positive_ids array<string>, supporting_positive_ids array<string>")
    asked = {(r.query_id, r["pass"]): json.loads(r.request) for r in benchmark.critic_requests(q, ev).collect()}
    assert set(asked) == {("q1", 0), ("q1", 1), ("q2", 0), ("q3", 0), ("q3", 1)}
    shown = {k: [i["evidence_id"] for i in v.get("items") or []] for k, v in asked.items()}
    assert sorted(shown["q1", 0]) == sorted(shown["q1", 1]) == ids and shown["q1", 0] != shown["q1", 1] and shown["q2", 0] == ["e0"] and shown["q3", 0] == []
    good = {"accepted": True, "groundedness": 5, "answerability": 4, "evidence_sufficiency": 4, "naturalness": 3}
    say = [("q1", 0, good, None), ("q1", 1, {**good, "naturalness": 2}, None), ("q2", 0, good, None), ("q3", 0, good, None), ("q3", 1, None, "timeout")]
    answers = spark.createDataFrame([(a, b, json.dumps(c) if c else None, d) for a, b, c, d in say], "query_id string, pass int, response string, error string")
    errors = spark.createDataFrame([("q1", []), ("q2", []), ("q3", [])], "query_id string, errors array<string>")
    got = {r.query_id: r for r in benchmark.assessments(q, answers, errors).collect()}
    assert (got["q1"].accepted, got["q2"].accepted, got["q3"].accepted) == (False, True, False)
    assert [s.naturalness for s in got["q1"].scores] == [3, 2] and got["q3"].critic_failures == ["timeout"]
    assert {r.query_id: r.accepted for r in benchmark.assessments(q, answers, errors, False).collect()}["q2"]
    bad = spark.createDataFrame([("q2", ["length"])], "query_id string, errors array<string>")
    assert not {r.query_id: r.accepted for r in benchmark.assessments(q, answers, bad).collect()}["q2"]


def _pav(rows):
    pools = []
    for x in sorted({s for s, _ in rows}):
        own = [y for s, y in rows if s == x]
        pools.append([x, x, len(own), sum(own)])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
            b = pools.pop()
            pools[-1] = [pools[-1][0], b[1], pools[-1][2] + b[2], pools[-1][3] + b[3]]
    return pools


def test_isotonic_pools(spark):
    rng = random.Random(6)
    for n in (1, 7, 400):
        rows = [(round(rng.random(), 2 if n < 400 else 3), int(rng.random() < 0.5 * (k % 3 > 0))) for k in range(n)]
        df = spark.createDataFrame(rows, "score double, label int").repartition(5)
        got = sorted(tuple(r) for r in calibration.pools(df, 2).collect())
        assert got == [(a, b, float(c), float(d)) for a, b, c, d in _pav(rows)]
    up = spark.createDataFrame([(k / 100, int(k >= 50)) for k in range(100)], "score double, label int")
    assert calibration.isotonic(up) == ([0.0, 0.49, 0.5, 0.99], [0.0, 0.0, 1.0, 1.0])
    assert calibration.isotonic(spark.createDataFrame([], "score double, label int")) == ([], [])


def test_folds_are_predicted_from_the_others(spark):
    from bisect import bisect_left

    rng = random.Random(3)
    rows = [(f"q{k % 23}", round(rng.random(), 2), int(rng.random() < 0.4)) for k in range(300)]
    df = spark.createDataFrame(rows, "query_id string, score double, label int")
    of = {r.query_id: r.fold for r in calibration.folds(df.select("query_id").distinct(), "query_id").collect()}

    def predicted(fold, x):
        pools = _pav([(s, y) for q, s, y in rows if of[q] != fold])
        xs, ys = zip(*[(v, d / c) for a, b, c, d in pools for v in dict.fromkeys((a, b))], strict=True)
        if x <= xs[0] or x >= xs[-1]:
            return ys[0] if x <= xs[0] else ys[-1]
        k = bisect_left(xs, x)
        return ys[k - 1] + (x - xs[k - 1]) * (ys[k] - ys[k - 1]) / (xs[k] - xs[k - 1])

    for r in calibration.out_of_fold(df, "query_id").collect():
        assert abs(r.predicted - predicted(of[r.query_id], r.score)) < 1e-9


def test_balanced_logistic_fit_against_newton(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) * [1, 2, 3, 1, 5, 1]
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) > 1).astype(float)
    names = list(calibration.FEATURES)
    model = calibration.answerability(spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in names) + ", label int"))
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(300)]
    weight = np.where(y == 1, 150 / y.sum(), 150 / (300 - y.sum()))
    b, ridge = np.zeros(7), np.diag([1.0] * 6 + [0.0]) * weight.sum() / 300
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (p - y)) + ridge @ b)
    assert np.allclose([*model["weights"], model["bias"]], b, atol=1e-4)


def test_row_numbers_run_through_all_files(spark, tmp_path):
    path = f"{tmp_path}/data"
    for k, n in enumerate((3, 0, 4, 1)):
        spark.createDataFrame([(f"k{j % 2}", f"p{k}{j}", "ok") for j in range(n)], "checkpoint_pk string, patch string, status string").coalesce(1).write.parquet(f"{path}/{k}")
    import glob
    import os

    os.makedirs(f"{path}/commits.parquet")
    for k in range(4):
        for f in glob.glob(f"{path}/{k}/*.parquet"):
            os.rename(f, f"{path}/commits.parquet/part-{k}.parquet")
    rows = sorted((r.source_row, r.patch) for r in tables.read_table(spark, path, "commits").collect())
    assert rows == list(enumerate(["p00", "p01", "p02", "p20", "p21", "p22", "p23", "p30"]))
    last = {r.checkpoint_pk: r.patch for r in tables.last_wins(tables.read_table(spark, path, "commits"), "checkpoint_pk").collect()}
    assert last == {"k0": "p30", "k1": "p23"}


def test_documents_and_marks(spark, tmp_path):
    path = f"{tmp_path}/d.json"
    artifacts.write_document(spark, path, {"a": 1})
    artifacts.write_document(spark, path, {"a": 2})
    assert artifacts.read_document(spark, path) == {"a": 2} and not [p for p in tmp_path.iterdir() if p.suffix == ".part"]
    won = []

    def mark():
        try:
            artifacts.mark_once(spark, f"{tmp_path}/mark", {"by": 1})
            won.append(1)
        except RuntimeError:
            won.append(0)

    threads = [threading.Thread(target=mark) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [0, 0, 0, 1] and artifacts.read_document(spark, f"{tmp_path}/mark") == {"by": 1}


def test_families_of_conflicts_are_numbered_not_rounds(spark, monkeypatch):
    """Queries whose examples all ban each other: the greedy colours in one numbering, named with each example or once."""
    rng = random.Random(4)
    own = {q: [f"q{q}p{k}" for k in range(rng.randrange(1, 30))] for q in range(5)}
    own[5], own[6] = ["shared", "a", "b"], ["shared", "c"]
    examples = [(f"e{q}-{p}-{n}", p, [x for x in own[q] if x != p]) for q in own for p in own[q] for n in range(1 + (q == 1))]
    df = spark.createDataFrame(examples, "example_id string, positive_id string, excluded_positive_ids array<string>")
    ranks = {r.example_id: (r.h, r.example_id) for r in df.select("example_id", F.xxhash64("example_id").alias("h")).collect()}
    want, seen, rounds = _greedy(examples, ranks), [], batches._rounds
    monkeypatch.setattr(batches, "_rounds", lambda x, ties: seen.append(x.count()) or rounds(x, ties))
    assert {r.example_id: r.colour for r in batches.colours(df).collect()} == want
    named = spark.createDataFrame([(i, p, i.split("-")[0]) for i, p, _ in examples], "example_id string, positive_id string, family string")
    members = spark.createDataFrame([(f"e{q}", p) for q in own for p in own[q]], "family string, item string")
    assert {r.example_id: r.colour for r in batches.colours(named, members).collect()} == want
    assert seen == [5, 5]
