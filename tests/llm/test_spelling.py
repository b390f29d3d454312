"""Spelling variants against plain Python: the words, every near pair, forms and roots, at every block size."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import spelling

from ._docs import SCHEMA, table


def brute_words(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def edits(w, letters):
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {w}


def brute_variants(n):
    letters = set("".join(n))
    near = {w: [v for v in edits(w, letters) if v in n] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def misspelt(seed=4):
    """Texts whose words have variants of variants, at the first, the middle and the last character."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdéß") for _ in range(rng.randrange(7, 15))) for _ in range(25)]
    base += ["aaaaaaaa", "aaaaaaaaa", "Straßenbahn", "STRAẞENBAHN", "ÀÉÎÕÜÿ÷×Àéîõü"]
    rows = []
    for k in range(240):
        text = []
        for _ in range(40):
            w = base[min(rng.randrange(30), rng.randrange(30))]
            for _ in range((rng.random() < 0.2) + (rng.random() < 0.05)):
                i, c = rng.randrange(len(w) + 1), rng.choice("abcdé")
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            text.append(w)
        rows.append((k, rng.choice([" ", "\n", "-", "1"]).join(text), None, None, 0))
    rows += [(None, "without id straßenbahn " * 40, None, None, 0), (7, None, None, None, 0), (7, "", None, None, 0), rows[0], rows[0], (901, "chaining " * 3000 + "chaininx " * 250 + "chainynx " * 20, None, None, 0), (900, "x" * 200_000 + " " + "lengthy " * 30_000, None, None, 0)]
    return rows


@pytest.mark.parametrize("block", [20_000, 5, 1])
def test_variants(spark, block):
    rows = misspelt()
    found = spelling.stage(spelling.words(table(spark, rows, extra=block == 5)))
    n = brute_words(rows)
    assert {tuple(r) for r in found.collect()} == set(n.items())
    out = spelling.spelling_variants(found, block=block)
    got = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in out.collect()]
    want = brute_variants(n)
    assert len(got) == len(want) and set(got) == want
    assert any(r[3] and r[3] != r[5] for r in want), "a chain of forms is in the fixture"


def test_pairs_come_once_in_each_direction(spark):
    n = brute_words(misspelt(9))
    found = spark.createDataFrame(list(n.items()), "word string, n long")
    for block in (20_000, 2):
        got = [(r.word, r.near) for r in spelling.near_words(found, block).collect()]
        letters = set("".join(n))
        want = {(w, v) for w in n for v in edits(w, letters) if v in n}
        assert len(got) == len(set(got)) and set(got) == want


def test_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.spelling_variants(spelling.words(empty)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", max_size=6), max_size=40), st.text("abc", max_size=6))
def test_automaton_numbers_and_finds(strings, s):
    ordered = sorted(strings)
    a = spelling.Automaton(ordered)
    assert [a._ends(a.root, 0, x, 0) for x in ordered] == list(range(len(ordered)))
    assert {ordered[k] for k in a.one_error(s)} == edits(s, "abc") & strings
    assert len({(f, *((c, t) for c, (t, _) in x.items())) for f, x in zip(a.final, a.steps, strict=True)}) == len(a.steps), "no two nodes are alike"
