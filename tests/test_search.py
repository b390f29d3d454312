"""BM25 by floors and dense cells against everything against everything."""

import random

from pyspark.sql import functions as F

from lodestone import catalogue
from lodestone.operators import dense, lexical

DATA = "/root/testdata/sf0.01"


def _plain(weighed, asked, k):
    """All postings of all terms of all queries."""
    from lodestone.functions import scoring

    points = F.round(F.sum(F.col("weight") * scoring.query_weight(F.col("idf"), F.col("qtf"))), lexical.ROUND)
    return lexical.top(weighed.join(asked, "term").groupBy("query_id", "evidence_id").agg(points.alias("score")).where("score > 0"), "score", k)


def _near(a, b):
    return len(a) == len(b) and all(x[:2] == y[:2] and x[3] == y[3] and abs(x[2] - y[2]) < 1e-5 for x, y in zip(a, b, strict=True))


def test_ranking_by_floors_is_the_ranking_of_everything(spark):
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(500)] + [(600, None), (601, ""), (602, "w1"), (603, "w1")]
    asked = [(f"q{k}", " ".join(word() for _ in range(n))) for k, n in enumerate([1, 1, 2, 3, 5, 8, 20, 60, 200, 0])] + [("common", "w1 w1 w2"), ("none", "unknown words"), ("null", None)]
    d = spark.createDataFrame(docs, "evidence_id long, text string")
    q = spark.createDataFrame(asked, "query_id string, query string")
    weighed, terms, stats = lexical.index(d)
    weighed, words = lexical._saved(weighed), lexical.query_terms(q).join(terms, "term")
    assert stats.first()["n"] == len(docs)
    for k in (1, 3, 10, 1000):
        got = sorted(tuple(r) for r in lexical.score(weighed, words, k).select("query_id", "evidence_id", "score", "rank").collect())
        want = sorted(tuple(r) for r in _plain(weighed, words, k).select("query_id", "evidence_id", "score", "rank").collect())
        assert _near(got, want), k
        assert _near(sorted(tuple(r) for r in lexical.bm25_topk(d, q, k).select("query_id", "evidence_id", "score", "rank").collect()), want), k
    empty = spark.createDataFrame([], "evidence_id long, text string")
    assert lexical.bm25_topk(empty, q).collect() == []


def test_common_words_are_not_joined_to_all_they_occur_in(spark):
    """Whole documents as questions: few of the postings that share a word are weighed."""
    t = catalogue._Tables(spark, DATA)
    weighed, terms, _ = lexical.index(t.ev)
    weighed, words = lexical._saved(weighed), lexical.query_terms(t.dq).join(terms, "term")
    seen = []
    sums = lexical._sums

    def counted(*a):
        seen.append(a[0].join(a[1].select("query_id", "term"), "term").count())
        return sums(*a)

    lexical._sums = counted
    try:
        got = lexical.score(weighed, words, 10).count()
    finally:
        lexical._sums = sums
    every = weighed.join(words, "term").count()
    print("postings joined", seen, "of", every)
    assert got and sum(seen) < 0.5 * every


def test_cells(spark):
    got = catalogue.queries()["dense_cells_topk"](spark, DATA)
    exact = catalogue.queries()["dense_topk"](spark, DATA)
    assert dense.recall(got, exact).first()["recall"] >= 0.9
    t = catalogue._Tables(spark, DATA)
    centres = dense.fit_cells(t.corpus, cells=5)
    index = dense.cell_index(t.corpus, centres, 16)
    assert index.select(F.explode("ids").alias("i")).select(F.count("*"), F.count_distinct("i")).first() == (t.corpus.count(),) * 2
    assert index.agg(F.max(F.size("ids"))).first()[0] < 64
    whole = dense.cell_search(index, centres, t.asked, 50, 5, 2)
    key = ("query_id", "evidence_id", "rank")
    assert {tuple(r[c] for c in key) for r in whole.collect()} == {tuple(r[c] for c in key) for r in exact.collect()}


def test_cells_of_hard_tables(spark):
    ddl = "evidence_id long, vec array<double>"
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, vec array<double>")
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(40)] + [(50, [0.0, 0.0])], ddl)
    centres = dense.fit_cells(same, cells=3)
    out = dense.cell_search(dense.cell_index(same, centres, 4), centres, q, 5, 3).collect()
    assert [r.evidence_id for r in sorted(out, key=lambda r: (r.query_id, r.rank))] == [0, 1, 2, 3, 4] * 2
    none = spark.createDataFrame([], ddl)
    centres = dense.fit_cells(none)
    assert dense.cell_search(dense.cell_index(none, centres), centres, q, 5).collect() == []


def test_many_whole_documents_are_ranked_by_blocks(spark, monkeypatch):
    """No row is made for a pair that shares a word, blocks of any size rank as everything does, and repeated ids are one text."""
    t = catalogue._Tables(spark, DATA)
    rng = random.Random(3)
    docs = [(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(0, 50)))) for k in range(300)]
    docs += [(k, docs[k][1] + " w1 w2") for k in range(0, 40)] + [(400, docs[7][1]), (401, docs[7][1]), (402, None)]
    d = spark.createDataFrame(docs, "evidence_id long, text string")
    q = d.where("evidence_id % 3 = 0").groupBy(F.col("evidence_id").alias("query_id")).agg(F.max("text").alias("query"))
    weighed, terms, _ = lexical.index(d)
    weighed, words = lexical._saved(weighed), lexical.query_terms(q).join(terms, "term")
    columns = ("query_id", "evidence_id", "score", "rank")
    want = sorted(tuple(r) for r in _plain(weighed, words, 7).select(*columns).collect())
    for sizes in ({}, {"TEXTS": 50, "FEW": 10, "QUERIES": 11, "CELLS": 200, "DENSE": 3, "PAIRS": 40}):
        for name, value in sizes.items():
            monkeypatch.setattr(lexical, name, value)
        assert _near(sorted(tuple(r) for r in lexical.bm25_topk(d, q, 7).select(*columns).collect()), want)
        assert _near(sorted(tuple(r) for r in lexical.score(weighed, words, 7).select(*columns).collect()), want)
    monkeypatch.undo()
    made = []
    best = lexical.top

    def counted(hits, *a):
        made.append(hits.count())
        return best(hits, *a)

    monkeypatch.setattr(lexical, "top", counted)
    lexical.bm25_topk(t.ev, t.dq, 5)
    assert 0 < sum(made) <= t.dq.count() * 5 * lexical.SPREAD


def test_postings_are_counted_where_texts_lie(spark):
    """Counting a text's words shuffles no postings: the plan has no exchange but the deal of small inputs."""
    d = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, "A a_1 7 7 b")], "evidence_id long, text string")
    x = lexical.counted(d)
    assert {r.evidence_id: (r.length, [tuple(y) for y in r.terms]) for r in x.collect()} == {1: (3, [("a", 1), ("b", 2)]), 2: (0, []), 3: (0, []), 4: (5, [("7", 2), ("a", 1), ("a_1", 1), ("b", 1)])}
    assert "Aggregate" not in x._jdf.queryExecution().optimizedPlan().toString()
    rows = lexical.sparse(d.union(spark.createDataFrame([(4, "A")], d.schema))).collect()
    assert {r.evidence_id: list(r.indices) for r in rows} == {1: [1, 3], 4: [0, 1, 1, 2, 3]}


def test_the_sample_of_cells_is_cut_before_it_is_sent(spark):
    """The rows of the least hashes, of which each task sends those under a bound, not as many as the whole sample has."""
    rows = spark.range(0, 5000, 1, 8).select(F.col("id").alias("evidence_id"), F.array(F.col("id").cast("double")).alias("vec"))
    got = dense._sample(rows, 5000, 100)
    h = F.xxhash64("evidence_id")
    assert [r[0] for r in got.select("evidence_id").collect()] == [r[0] for r in rows.orderBy(h).limit(100).select("evidence_id").collect()]
    assert "Filter" in got._jdf.queryExecution().optimizedPlan().toString()
    assert dense._sample(rows, 5000, 4000).count() == 4000 and dense._sample(rows.limit(0), 0, 10).count() == 0


def test_texts_are_ranked_without_being_shuffled(spark, monkeypatch):
    """What finds the best of each query has no exchange, whether queries are broadcast or not, and stores few bytes for each word."""
    rng = random.Random(5)
    docs = [(k, " ".join(f"W{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(0, 50)))) for k in range(300)] + [(7, "w1 w2"), (7, "w1"), (None, "w1 w1"), (None, "W1 w5"), (301, None)]
    d = spark.createDataFrame(docs, "evidence_id long, text string").repartition(6)
    q = d.where("evidence_id % 3 = 0").select(F.col("evidence_id").alias("query_id"), F.col("text").alias("query"))
    weighed, terms, _ = lexical.index(d)
    columns = ("query_id", "evidence_id", "score", "rank")
    want = _plain(lexical._saved(weighed), lexical.query_terms(q).join(terms, "term"), 7).select(*columns).collect()
    best, plans = lexical.top, []
    monkeypatch.setattr(lexical, "top", lambda hits, *a: plans.append(hits._jdf.queryExecution().executedPlan().toString()) or best(hits, *a))
    monkeypatch.setattr(lexical, "QUERIES", 20)
    key = lambda r: (r[0], r[3])
    for bounded in (True, False):
        monkeypatch.setattr(lexical, "_bounded", lambda *a, b=bounded: b)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 << 20 if bounded else -1)
        try:
            got = lexical.bm25_topk(d, q, 7).select(*columns).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert _near(sorted(map(tuple, got), key=key), sorted(map(tuple, want), key=key))
    assert len(plans) == 2 and all("CoGroup" not in p and "Exchange hash" not in p for p in plans) and "CartesianProduct" in plans[1]
    text = F.col("text")
    assert d.where(lexical.token_line(text) != F.array_join(lexical.tokens(text), " ")).count() == 0
    one = lexical._packed(d).selectExpr("sum(length(terms) + length(counts)) as bytes", "sum(aggregate(posts, 0L, (a, x) -> a + x)) as posts").first()
    assert one["bytes"] <= 3 * one["posts"]


def test_few_queries_make_no_row_for_a_pair(spark, monkeypatch):
    """Vectors go through matrix products where they lie: the rows that are ranked are the best of each block."""
    t, rng = catalogue._Tables(spark, DATA), random.Random(2)
    made, best = [], dense.top
    monkeypatch.setattr(dense, "top", lambda hits, *a: made.append(hits.count()) or best(hits, *a))
    q = t.asked.limit(5)
    got = dense.knn(t.corpus.repartition(2), q, 7)
    assert dense._bounded(q) and made[0] <= 2 * 5 * 7
    exact = best(t.corpus.crossJoin(q.withColumnRenamed("vec", "q")).select("query_id", "evidence_id", F.round(dense.dot(F.col("vec"), F.col("q")), dense.ROUND).alias("score")), "score", 7)
    assert got.exceptAll(exact.select(got.columns)).count() == 0 and got.count() == exact.count()
    c = spark.createDataFrame([(f"é{k}", [float(rng.randrange(3)), 1.0]) for k in range(40)], "evidence_id string, vec array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0])], "query_id string, vec array<double>")
    exact = best(c.crossJoin(q.withColumnRenamed("vec", "q")).select("query_id", "evidence_id", F.round(dense.dot(F.col("vec"), F.col("q")), dense.ROUND).alias("score")), "score", 9)
    assert dense.knn(c, q, 9).exceptAll(exact).count() == 0 and dense.knn(c, q.limit(0), 9).count() == dense.knn(c.limit(0), q, 9).count() == 0


def test_many_queries_leave_vectors_where_they_lie(spark, monkeypatch):
    """However many queries there are, what finds the best of each has no exchange of vectors, and ranks as all pairs do."""
    rng = random.Random(6)
    c = spark.createDataFrame([(k, [float(rng.randrange(4)), float(rng.randrange(3))]) for k in range(90)], "evidence_id long, vec array<float>").repartition(5)
    q = c.where("evidence_id % 4 = 0").withColumnRenamed("evidence_id", "query_id")
    pairs = c.crossJoin(q.withColumnRenamed("vec", "q")).select("query_id", "evidence_id", F.round(dense.dot(F.col("vec"), F.col("q")), dense.ROUND).alias("score"))
    best, plans = dense.top, []
    want = sorted(map(tuple, best(pairs, "score", 6).collect()))
    monkeypatch.setattr(dense, "top", lambda hits, *a: plans.append(hits._jdf.queryExecution().executedPlan().toString()) or best(hits, *a))
    c, q = lexical._saved(c), lexical._saved(q)
    for small in (False, True):  # the blocks of queries
        monkeypatch.setattr(dense, "_bounded", lambda df, b=small: b and "qids" in df.columns)
        monkeypatch.setattr(dense, "BLOCK", 7)
        assert sorted(map(tuple, dense.knn(c, q, 6).select("query_id", "evidence_id", "score", "rank").collect())) == want
    assert len(plans) == 2 and all("Exchange hash" not in p for p in plans)
    assert dense.knn(c, q.limit(0), 6).count() == dense.knn(c.limit(0), q, 6).count() == 0


def test_only_asked_words_are_counted_apart(spark, monkeypatch):
    """Words that no query has are not shuffled, an asked term keeps its count, and its hash is no other word's."""
    words = spark.createDataFrame([(f"w{k % 3000}", 1 + k % 2) for k in range(6000)], "term string, n long")
    asked = spark.createDataFrame([("a", f"w{k}", 1) for k in range(0, 40)] + [("b", "w1", 2), ("b", "none", 1)], "query_id string, term string, qtf long")
    df, hashed = lexical._counted_terms(words, asked)
    got = {r.term: r.df for r in df.collect()}
    want = {r.term: r.df for r in words.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    assert all(got[f"w{k}"] == want[f"w{k}"] for k in range(40)) and got.items() <= want.items() and len(got) < 100
    monkeypatch.setattr(lexical, "_meet", lambda terms, seed, real=lexical._meet: seed < 2 or real(terms, seed))
    again, other = lexical._counted_terms(words, asked)
    told = again.select(other(F.col("term")).alias("h"), F.xxhash64(F.lit(2), "term").alias("want")).collect()
    assert told and all(r.h == r.want for r in told) and {f"w{k}" for k in range(40)} <= {r.term for r in again.collect()}


def test_packed_blocks_compress(spark):
    """Postings of long texts take about a byte each once compressed: common words have low numbers, and steps are short."""
    import zlib

    rng = random.Random(9)
    d = spark.createDataFrame([(k, " ".join(f"w{int(rng.paretovariate(0.5)) % 90000}" for _ in range(400))) for k in range(400)], "evidence_id long, text string").coalesce(1)
    rows = lexical._packed(d).select("terms", "counts", F.aggregate("posts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).collect()
    assert sum(len(zlib.compress(r.terms, 1)) + len(zlib.compress(r.counts, 1)) for r in rows) < 1.1 * sum(r.n for r in rows)


def test_texts_of_the_same_words_are_ranked_once(spark, monkeypatch):
    """Copies of texts and of queries make no pairs of their own, and each of them is ranked as if it were alone, ties by id."""
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    rows = [(k, [texts[k % 40], texts[k % 40].upper().replace(" ", " , "), None][k % 3 if k % 11 == 0 else k % 2]) for k in range(400)] + [(None, texts[0])]
    d = spark.createDataFrame(rows, "evidence_id long, text string").repartition(5)
    q = spark.createDataFrame([(k, texts[k % 7]) for k in range(30)] + [(None, texts[3])], "query_id long, query string")
    weighed, terms, _ = lexical.index(d)
    want = _plain(lexical._saved(weighed), lexical.query_terms(q).join(terms, "term"), 15)
    made, best = [], lexical.top
    monkeypatch.setattr(lexical, "top", lambda hits, *a: made.append(hits.count()) or best(hits, *a))
    got = lexical.bm25_topk(d, q, 15)
    columns, key = ("query_id", "evidence_id", "score", "rank"), lambda r: (r[0] is not None, r[0] or 0, r[3])
    told = lambda x: sorted((tuple(r) for r in x.select(*columns).collect()), key=key)
    a, b = told(got), told(want)
    assert [r[:2] + r[3:] for r in a] == [r[:2] + r[3:] for r in b] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, b, strict=True))
    assert 0 < made[0] <= 7 * 40  # the different queries with the different texts


def test_words_are_found_as_the_pattern_finds_them(spark, monkeypatch):
    """Packing finds words in the bytes of many texts at once; they are the pattern's, and end where their text ends."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("aZ_09.:/- é\n\x00😀x") for _ in range(rng.randrange(0, 30))) for _ in range(600)] + [None, "", "9a", "a9", "-1.5:b/c-", "12.34", "a.", ".a"]
    d = spark.createDataFrame(list(enumerate(texts)), "evidence_id long, text string").coalesce(1)
    for size in (1 << 22, 50):
        monkeypatch.setattr(lexical, "SLICE", size)
        monkeypatch.setattr(lexical, "TEXTS", 100)
        got = lexical._packed(d).select(F.explode(F.arrays_zip("words", "posts")).alias("x")).groupBy("x.words").agg(F.sum("x.posts").alias("n"))
        want = d.select(F.explode(F.array_distinct(lexical.tokens(F.col("text")))).alias("words")).groupBy("words").agg(F.count("*").alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert lexical._packed(d).agg(F.sum("total")).first()[0] == d.agg(F.sum(F.size(lexical.tokens(F.col("text"))))).first()[0]
