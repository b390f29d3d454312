import random

from lodestone.llm import linededup, mixing

from ._docs import hard_rows, table


def brute_lines(rows, least):
    """Deletes every run of lines of the given weight that occurs earlier, by trying all runs."""
    seqs = {d: (t or "").split("\n") for d, t, *_ in rows}
    weight = {d: [len([w for w in x.replace("\t", " ").split(" ") if w.strip()]) for x in s] for d, s in seqs.items()}
    first = {}
    gone = {d: set() for d in seqs}
    for d in sorted(seqs):
        s, w = seqs[d], weight[d]
        for i in range(len(s)):
            for e in range(i + 1, min(len(s), i + 40) + 1):
                if sum(w[i:e]) >= least:
                    k = tuple(s[i:e])
                    if k in first:
                        gone[d].update(range(i, e))
                    else:
                        first[k] = (d, i)
    return {d: "\n".join(x for i, x in enumerate(s) if i not in gone[d]) for d, s in seqs.items()}


def test_line_dedup(spark):
    rng = random.Random(6)
    pool = ["", "", "a b c", "d", "e f g h i j", "k l", "m n o p", " ", "q"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))), None, None, 0) for k in range(40)]
    rows += [(100 + k, rows[k][1], None, None, 0) for k in (3, 4, 5)] + [(200, None, "en", "s", 0), (201, "", None, None, 0)]
    for least in (1, 5, 12):
        got = {r.doc_id: r.text or "" for r in linededup.dedup_lines(table(spark, rows, extra=True), least).collect()}
        assert got == brute_lines(rows, least)


def test_line_dedup_cases(spark):
    rows = hard_rows()
    out = linededup.dedup_lines(table(spark, rows))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r.text or "" for r in out.collect()} == brute_lines(rows, linededup.MIN_WORDS)
    assert linededup.dedup_lines(table(spark, [])).count() == 0
    twice = linededup.dedup_lines(table(spark, [(1, "a " * 30, None, None, 0)] * 2)).collect()
    assert sorted(len(r.text) for r in twice) == [0, 60]


def corpus(n=400):
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for k in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.randrange(30, 90))]
        kind = rng.choice(["high", "high", "high", "low", "toxic"])
        if kind == "low":
            ws = [w + "***" for w in ws]
        if kind == "toxic":
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["vileword", "badword"]))
        rows.append((k, " ".join(ws), None, None, 0))
        if k % 2:
            labels.append((k, int(kind != "low"), int(kind == "toxic")))
    return rows, labels


def test_mixing(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels + [(99999, 1, 1), (1, None, None)][:1], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + [(900, None, None, None, 0), (901, "", None, None, 0)], extra=True)
    out = mixing.mix(docs, lab, {"high": 0.5, "low": 0.3, "toxic": 0.2}).collect()
    total = sum(r.tokens for r in out)
    for k, (d, want) in enumerate([("high", 0.5), ("low", 0.3), ("toxic", 0.2)]):
        assert abs(sum(r.tokens * r.p[k] * r.rate for r in out) / total - want) < 0.01, d
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 and abs(sum(r.p) - 1) < 1e-9 for r in out)
    truth = {k: (0 if q else 1) if not t else 2 for k, q, t in labels}
    assert sum(max(range(3), key=lambda j: r.p[j]) == truth[r.doc_id] for r in out if r.doc_id in truth) > 0.9 * len(truth)
    thin = mixing.mix(docs, lab, thin=True).collect()
    assert all(r.copies <= 1 for r in thin)
    assert all(r.copies == 1 for r in thin if r.p[0] == max(r.p))


def test_mixing_follows_a_step_by_step_solver(spark):
    rows, labels = corpus(120)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = mixing.mix(table(spark, rows), lab).collect()
    total, want = sum(r.tokens for r in out), [mixing.TARGETS[d] for d in mixing.DOMAINS]
    rate = [1.0] * len(out)
    for _ in range(mixing.ROUNDS):  # one rate for each document, with no table of bins
        e = [sum(r.tokens / total * r.p[k] * x for r, x in zip(out, rate, strict=True)) for k in range(3)]
        at_one = [sum(r.tokens / total * r.p[k] for r in out) for k in range(3)]
        e = [(e[k] - want[k]) / at_one[k] for k in range(3)]
        rate = [max(0.0, x * (1 - mixing.STEP * mixing.PULL) + mixing.STEP * mixing.PULL - mixing.STEP * sum(p * y for p, y in zip(r.p, e, strict=True))) for r, x in zip(out, rate, strict=True)]
    assert all(abs(r.rate - x) < 1e-3 for r, x in zip(out, rate, strict=True))


def test_mixing_empty(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(table(spark, []), lab).count() == 0
