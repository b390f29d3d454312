import collections
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing, rules

from ._docs import hard_rows, table

WS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    w = WS.findall(text)
    wins = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té#|", max_size=120))
def test_measures(text):
    assert rules.measure(text) == brute_measures(text)


def test_ledger(spark):
    rows = hard_rows()
    got = rules.apply_policy(rules.ledger(table(spark, rows, extra=True))).collect()
    assert {(r.doc_id, tuple(r[m] for m in rules.MEASURES)) for r in got} == {(d, brute_measures(t)) for d, t, *_ in rows}
    for r in got:
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert bool(r.fail_bits & rules.BASE.mask) == base
        assert r.kept == (not r.fail_bits)
    assert rules.ledger(table(spark, [])).count() == 0


def test_ablations_and_versions(spark):
    led = rules.ledger(table(spark))
    rows = led.collect()
    for r in rules.ablations(led).collect():
        bit = 1 << rules.RULES[r.rule][0]
        assert r.failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.only == sum(x.fail_bits == bit for x in rows)
        assert r.kept_without == sum(not x.fail_bits & ~bit for x in rows)
    assert rules.apply_policy(led, rules.BASE).where("kept").count() >= rules.apply_policy(led).where("kept").count()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, packing.TokenBytes(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB é1.,'s\n\t   \x1c\x85<|endoftext|>"), st.characters(codec="utf-8")), max_size=60))
def test_chunks_encode_as_whole_texts(tokenizer, text):
    t, own = tokenizer
    assert np.frombuffer(own.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_own_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, own, end = Tokenizer.from_file(path), packing.TokenBytes(path), "<|endoftext|>"
    assert t.encode(f"hello {end} world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    for text in (end, end * 3, f"hello {end} world", f"a{end}b", f" {end}\n\n {end} ", f"<|endoftext{end}|>", f"x  {end}  y", f"it{end}'s \t{end}\té 1{end}2"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_pack(spark, tokenizer):
    import public_tokenizers

    rows = hard_rows()
    out = packing.pack(table(spark, rows, extra=True), public_tokenizers.path("byte_bpe_50k.json")).collect()
    pieces = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for d, t, *_ in rows:
        ids = tokenizer[0].encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for k, r in enumerate(sorted(pieces[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(table(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_plan_uses_every_piece_once(counts):
    plan = packing.plan_packing(counts, 64)
    used = collections.Counter()
    for lengths, m in plan:
        assert sum(lengths) <= 64 and m > 0
        for x in lengths:
            used[x] += m
    assert used == collections.Counter(counts)
    total = sum(k * v for k, v in counts.items())
    assert sum(m for _, m in plan) <= 1 + 2 * total / 64 + max(counts.values(), default=0)


def test_plan_finds_exact_complements():
    assert sum(m for _, m in packing.plan_packing({60: 5, 40: 5, 50: 2, 30: 3, 35: 3}, 100)) == 5 + 1 + 3 - 1


def test_a_text_is_encoded_in_one_call():
    """Different words cost no call each, and a text between added tokens is encoded whole."""
    import public_tokenizers

    own, calls = packing.TokenBytes(public_tokenizers.path("byte_bpe_50k.json")), []
    real = own._encoding

    class Counted:
        def __getattr__(self, name):
            return lambda *a, **k: calls.append(name) or getattr(real, name)(*a, **k)

    text = "  ".join(f"word{k}\n x{k * k}" for k in range(500))
    want = np.asarray(real.encode_ordinary(text), "<u4").tobytes()
    own._encoding = Counted()
    assert own.encode(text) == want and len(calls) == 1
    end = own._added["<|endoftext|>"]
    assert own.encode(text + "<|endoftext|>" + text) == want + end + want and len(calls) == 3
