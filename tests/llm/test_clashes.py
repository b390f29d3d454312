"""Extra columns under exactly the names that the operators use inside, and ids that are null or repeat."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import linededup, mixing, rules, simhash

from ._docs import hard_rows, table

NAMES = {
    "rules": ["__n_words", "__word_chars", "n_words", "fail_bits", "___n_words"],
    "lines": ["__uid", "__x", "__lines", "__Deleted", "__runs", "__spans", "uid", "row", "s", "e"],
    "mix": ["rate", "tokens", "p", "copies", "b_hits", "b_symbols", "__w", "row", "domain", "Tokens_"],
}


def _docs(spark, names):
    docs = table(spark, hard_rows())
    return docs.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])


def _same(out, names):
    return all(r[n] == f"{n} {r.doc_id}" for r in out for n in names)


def test_rules_keep_clashing_columns(spark):
    docs = _docs(spark, NAMES["rules"])
    out = rules.passing(docs)
    rows = out.collect()
    assert out.columns == docs.columns and _same(rows, NAMES["rules"])
    assert {r.doc_id for r in rows} == {r.doc_id for r in rules.passing(table(spark)).collect()} and rows


def test_line_dedup_keeps_clashing_columns(spark):
    docs = _docs(spark, NAMES["lines"])
    out = linededup.dedup_lines(docs)
    rows = out.collect()
    assert out.columns == [*docs.columns, "__lines_", "__deleted_", "__runs_"] and _same(rows, NAMES["lines"])
    plain = {r.doc_id: (r.text, r["__lines"], r["__deleted"]) for r in linededup.dedup_lines(table(spark)).collect()}
    assert {r.doc_id: (r.text, r["__lines_"], r["__deleted_"]) for r in rows} == plain


def test_mixing_keeps_clashing_columns(spark):
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(20)], "doc_id long, quality int, toxic int")
    docs = _docs(spark, NAMES["mix"])
    out = mixing.mix(docs, labels)
    rows = out.collect()
    assert out.columns == [*docs.columns, "p_", "tokens__", "rate_", "copies_"] and _same(rows, NAMES["mix"])
    plain = {r.doc_id: (r.tokens, r.rate, r.copies) for r in mixing.mix(table(spark), labels).collect()}
    assert {r.doc_id: (r.tokens__, r.rate_, r.copies_) for r in rows} == plain


def _chain():
    """Texts A, M and B of which A links M, and M links B, but A doesn't link B."""
    import random

    rng = random.Random(0)
    bits = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    while True:
        m = list(base)
        m[rng.randrange(400)] = "x"
        b = list(m)
        b[rng.randrange(400)] = "y"
        b[rng.randrange(400)] = "z"
        texts = [" ".join(x) for x in (base, m, b)]
        if bits(texts[0], texts[1]) <= 4 and bits(texts[1], texts[2]) <= 4 < bits(texts[0], texts[2]):
            return texts


@pytest.mark.parametrize("ids", [(3, 5, 7), (3, None, 7), (None, None, 7), (None, None, None), (3, 3, 7), (9, 9, 9)])
def test_simhash_links_run_through_rows_without_an_id(spark, ids):
    a, m, b = _chain()
    rows = [(ids[0], a, None, None, 0), (ids[1], m, None, None, 0), (ids[2], b, None, None, 0), (None, "far away text " * 40, None, None, 0), (1, "another one " * 50, None, None, 0)]
    out = simhash.near_duplicates(table(spark, rows, extra=True)).collect()
    least = min((i for i in ids if i is not None), default=None)
    of = {r.fingerprint: r.component_id for r in out}
    assert [of[f"{simhash.fingerprint(x):016x}"] for x in (a, m, b)] == [least] * 3 and len(out) == len(rows)
    assert of[f"{simhash.fingerprint(rows[3][1]):016x}"] is None and of[f"{simhash.fingerprint(rows[4][1]):016x}"] == 1


def test_simhash_of_an_id_with_several_texts(spark):
    rows = [(1, "first text of one " * 30, None, None, 0), (1, "quite another text here " * 30, None, None, 0), (2, "quite another text here " * 30, None, None, 0)]
    out = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect())
    assert len(out) == 3 and {r[2] for r in out} == {1} and len({r[1] for r in out}) == 2
