"""Neighbours by shared metadata against all pairs."""

import random

from lodestone.operators import benchmark


def test_neighbours_of_few_classes_are_those_of_all_pairs(spark, monkeypatch):
    """Many rows with the same metadata: as many ids as are asked for meet a query, not all of them."""
    rng = random.Random(5)
    some = lambda kind, n: [f"{kind}{rng.randrange(n)}" for _ in range(rng.randrange(3))]
    rows = [(k, some("s", 3), some("c", 2), some("f", 3)) for k in range(600)] + [(900, None, ["c0", "c0", None], None)]
    ddl = "session_ids array<string>, checkpoint_pks array<string>, files array<string>"
    seeds = [(f"q{k % 30}", *rows[k][1:]) for k in range(0, 120)] + [("none", [], [], []), ("odd", None, [None], ["f9"])]
    want = []
    for q in {s[0] for s in seeds}:
        mine = [{v for s in seeds if s[0] == q for v in s[c] or [] if v} for c in (1, 2, 3)]
        hits = [(sum(p * len(mine[c] & set(r[c + 1] or [])) for c, p in enumerate((3, 2, 1))), r[0]) for r in rows]
        want += [(q, i, s, n + 1) for n, (s, i) in enumerate(sorted((h for h in hits if h[0]), key=lambda h: (-h[0], h[1]))[:5])]
    made, best = [], benchmark.top

    def counted(hits, *a):
        made.append(hits.count())
        return best(hits, *a)

    monkeypatch.setattr(benchmark, "top", counted)
    got = benchmark.metadata_neighbours(spark.createDataFrame(seeds, f"query_id string, {ddl}"), spark.createDataFrame(rows, f"evidence_id long, {ddl}"), 5)
    assert sorted((r.query_id, r.evidence_id, r.score, r.rank) for r in got.collect()) == sorted(want)
    assert sum(made) < 3000  # all pairs that share something are over 10,000


def test_pairs_that_share_only_their_heaviest_term(spark):
    """The first term of a text has no weight before it and is looked up as the others are."""
    rows = spark.createDataFrame([(1, "one"), (2, "one"), (3, "other words")], "query_id long, query string")
    assert [(r.a, r.b, r.cosine) for r in benchmark.similar_pairs(rows, 0.9).collect()] == [(1, 2, 1.0)]
