"""All commands, one after the other, on a few sessions of logs."""

import datetime as dt
import json

import pytest

from lodestone.__main__ import main


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    data, out = f"{top}/data", f"{top}/out"
    day = lambda k: dt.datetime(2026, 2, 20) + dt.timedelta(days=4 * k)
    ids = [f"s{k}" for k in range(6)]
    save = lambda rows, ddl, name: spark.createDataFrame(rows, ddl).write.parquet(f"{data}/{name}.parquet")
    save([(s, "r", day(k), f'["c{k // 2}"]', '["src/app/main.py"]') for k, s in enumerate(ids)], "session_id string, repo_id string, created_at timestamp, checkpoint_ids string, files_touched string", "sessions")
    save([("s0", "transcripts/a.jsonl"), ("s1", None)], "session_id string, transcript_path string", "session_logs")
    turns = [(f"t{k}{j}", s, role, kind, f"{word} number {k} of the parser", day(k)) for k, s in enumerate(ids) for j, (role, kind, word) in enumerate([("user", "user_prompt", "Fix error"), ("assistant", "assistant_response", "Changed code"), ("user", "progress", "Noise")])]
    save([*turns, ("x", "gone", "user", "user_prompt", "orphan turn", None)], "turn_id string, session_id string, role string, turn_type string, content string, timestamp timestamp", "conversations")
    save([(f"c{k}", f'["s{2 * k}", "s{2 * k + 1}"]', "[]", "garbage") for k in range(3)], "checkpoint_pk string, session_pks string, commit_shas string, files_touched string", "checkpoints")
    save([("c0", "ok", "diff --git a\n+x\ndiff --git b\n-y", "abc", "Mend the scanner"), ("c1", "error", "", "bad", "no"), ("c9", "ok", None, "lone", "Orphan")], "checkpoint_pk string, status string, patch string, commit_sha string, commit_message string", "commits")
    (top / "data/transcripts").mkdir()
    (top / "data/transcripts/a.jsonl").write_text('{"type":"user","message":{"content":"transcript words"}}\nnot json\n')
    spark.createDataFrame([("q1", "error number 3 of the parser"), ("q2", "latest code of the parser")], "query_id string, query string").write.parquet(f"{top}/queries.parquet")
    return str(top), data, out


def test_commands(spark, folders):
    top, data, out = folders
    run = lambda *a: main([*a, "--data", data, "--out", out], spark)
    assert json.loads(run("validate"))["sessions"] == 6
    made = json.loads(run("prepare"))
    assert made["quality"]["duplicate_ids"] == 0 and made["quality"]["empty"] == 0
    rows = spark.read.parquet(f"{out}/evidence")
    kinds = {r.evidence_type: r["count"] for r in rows.groupBy("evidence_type").count().collect()}
    assert kinds["session"] == 6 and kinds["checkpoint"] == 3 and kinds["commit"] == 3 and kinds["transcript"] == 1 and kinds["conversation"] == 13 and kinds["topic"] >= 1
    of = {r.s: r.partition for r in rows.where("evidence_type = 'session'").selectExpr("session_ids[0] s", "partition").collect()}
    # pairs share a checkpoint, and go by their later day: February 24, March 4, March 12
    assert of == {"s0": "train", "s1": "train", "s2": "validation", "s3": "validation", "s4": "evaluation", "s5": "evaluation"}
    first = json.loads(run("index"))
    audited = json.loads(run("audit"))
    assert [r.split("-")[0] for r in audited["runs"]] == ["prepare", "index"] and audited["stale"] == []
    assert first["vectors"] == rows.where("evidence_type != 'transcript'").count() and json.loads(run("index")) == first
    hits = [json.loads(x) for x in run("query", "--text", "error number 3 of the parser").splitlines()]
    assert hits[0]["final_rank"] == 1 and "number 3" in hits[0]["text"]
    old = [json.loads(x) for x in run("query", "--text", "error number 3", "--as-of", "2026-02-25").splitlines()]
    assert old and all(h["timestamp"] <= "2026-02-25" for h in old)
    told = json.loads(run("answer", "--text", "error number 3"))
    assert told["answerability"] == "supported" and told["valid"] and told["citations"]
    assert json.loads(run("audit"))["outside"] == 0
    best = rows.where("text like '%number 3%' and evidence_type = 'conversation'").selectExpr("'q1' query_id", "evidence_id", "3 grade")
    best.write.parquet(f"{top}/qrels.parquet")
    asked = ("--queries", f"{top}/queries.parquet", "--qrels", f"{top}/qrels.parquet")
    scores = {r["variant"]: r for r in map(json.loads, run("evaluate", *asked).splitlines())}
    assert set(scores) == {"dense", "lexical", "hybrid"} and scores["lexical"]["mrr_10"] > 0
    trial = json.loads(run("experiment", *asked))
    assert trial["floor"] in (0.0, 0.1, 0.2) and 0 < trial["ndcg"] <= 1
    fit = json.loads(run("calibrate", *asked))
    assert len(fit["knots"][0]) == len(fit["knots"][1]) > 0 and 0 <= fit["ece"] <= 1


    run("prepare")  # the same evidence, written anew: what was made of the old one is told
    assert {r.split("-")[0] for r in json.loads(run("audit"))["stale"]} == {"index", "experiment", "calibrate"}
    run("index")
    assert "index" not in {r.split("-")[0] for r in json.loads(run("audit"))["stale"]}

    # a benchmark of the evidence itself
    made = json.loads(run("generate"))
    assert made["kept"] > 0
    judged = json.loads(run("judge"))
    assert judged["3"] >= made["kept"]
    assert json.loads(run("usage"))["all"]["requests"] > 0 and json.loads(run("criticize"))["kept"] == made["kept"]
    trained = json.loads(run("train"))
    assert trained["conflicts"] == 0 and trained["batches"] <= trained["examples"]
    asked = ("--queries", f"{out}/queries", "--qrels", f"{out}/judgments")
    done = json.loads(run("answer-benchmark", *asked))
    assert done["answered"] >= done["valid"] > 0 and json.loads(run("answer-benchmark", *asked))["answered"] == done["answered"] - done["valid"]


def test_commands_need_their_inputs(spark):
    for a in (["query"], ["evaluate", "--text", "x"], ["nothing"]):
        with pytest.raises(SystemExit):
            main(a, spark)
