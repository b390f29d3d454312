import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import answering, evidence, partition
from lodestone.sources import tables


def _windows(value, size, overlap):
    """Cuts by hand: the window's end is the last line end of its second half, else its size."""
    out, at, half = [], 0, max(1, size // 2)
    while value:
        end = len(value)
        if end - at > size:
            ends = [k for k in range(at + half, at + size) if value[k] == "\n"]
            end = ends[-1] if ends else at + size
        out.append(value[at:end].strip())
        if end == len(value):
            break
        at = max(at + 1, end - overlap)
    return out


def test_windows_against_cuts_by_hand(spark):
    import random

    rng = random.Random(2)
    texts = ["", "  \n ", None, "a", "x" * 100, "x" * 101, "é\n" * 120, "word " * 80, "\n" * 50 + "y" * 300 + "\n" * 50]
    texts += ["".join(rng.choice("ab é\n" if k % 2 else "abcdefghij \n") for _ in range(rng.randrange(1, 900))) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for size, overlap in ((100, 20), (100, 0), (7, 3), (10, 9), (1, 0), (2, 1)):
        got = {}
        for r in evidence.chunks(docs, size, overlap).collect():
            got.setdefault(r.k, []).append((r.chunk_index, r.text))
        for k, x in enumerate(texts):
            want = _windows((x or "").strip(), size, overlap)
            assert [y for _, y in sorted(got.get(k, []))] == want, (k, size, overlap)
    with pytest.raises(ValueError):
        evidence.chunks(docs, 5, 5)


def test_redaction_leaves_nothing_sensitive(spark):
    rows = [("mail a.b@c.org now",), ('api_key = "abcdefgh1"',), ("see /home/me/x.txt",), ("plain",)]
    out = spark.createDataFrame(rows, "t string").select(text.redact(F.col("t")).alias("t"))
    assert out.where(text.is_sensitive(F.col("t"))).count() == 0


def test_events_keep_bad_and_blank_lines(spark):
    df = spark.createDataFrame([("p", '{"type":"user","message":{"content":"hi"}}\r\n\nnot json\n')], "path string, value string")
    got = [(r.event_index, r.type) for r in tables.parse_events(df).orderBy("event_index").collect()]
    assert got == [(0, "user"), (1, "malformed"), (2, "malformed")]
    assert [r.text for r in evidence.transcript_evidence(tables.parse_events(df)).collect()] == ["hi"]


def test_paths_stay_inside():
    with pytest.raises(ValueError):
        tables.check_relative("../x")


def test_batches_without_conflicts():
    examples = [{"positive_id": "a", "excluded_positive_ids": ["b"]}, {"positive_id": "b"}, {"positive_id": "c"}, {"positive_id": "a"}]
    batches = answering.conflict_free_batches(examples, 2)
    assert sorted(i for b in batches for i in b) == [0, 1, 2, 3] and all({0, 1} != set(b) and {0, 3} != set(b) for b in batches)


def test_leaks_raise(spark):
    rows = spark.createDataFrame([("s", "train"), ("s", "evaluation")], "session string, partition string")
    with pytest.raises(ValueError):
        partition.assert_isolated(rows, ["session"])
