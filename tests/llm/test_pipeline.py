"""The whole pipeline against plain Python, stage after stage, on a small corpus."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
import regex
import xxhash

import corpus_pipeline
from lodestone.llm import linededup, mixing, rules

from ._docs import SCHEMA, hard_rows, words
from .test_dedup import brute_components, brute_fingerprint
from .test_lines_and_mix import brute_lines, corpus
from .test_text import WS, brute_measures


def small_corpus():
    rng = random.Random(11)
    rows, labels = corpus(240)
    rows = [(d, t.replace("***", "").upper() if "***" in t else t, *rest) for d, t, *rest in rows]  # low ones pass the rules
    rows += [(1000 + d, t, *rest) for d, t, *rest in hard_rows()]
    passages = ["\n".join(words(rng, 14, 5000) for _ in range(3)) for _ in range(3)]
    for k in range(12):  # passages that several texts share
        rows.append((2000 + k, "\n".join([words(rng, 40, 5000), passages[k % 3], words(rng, 40, 5000)]), "en", "src0", 0))
    for k in range(6):  # near copies: one word of many is another
        w = words(rng, 900, 5000).split()
        rows.append((3000 + 2 * k, " ".join(w), None, None, 0))
        rows.append((3001 + 2 * k, " ".join(w[:450] + ["other"] + w[451:]), None, None, 0))
    rows += [(4000 + k, rows[k][1], "fr", "src1", 0) for k in range(0, 30, 3)]
    rows += [(5000 + k, words(rng, 10, 3) + " " + "spam " * 40, None, None, 0) for k in range(5)]
    return [(d, t, lang, src, len(t or "")) for d, t, lang, src, _ in rows], labels


def brute_kept(rows):
    """Rows that no rule of the default policy rejects."""
    out = []
    for r in rows:
        n, chars, symbols, lines, repeats = brute_measures(r[1])
        bad = n < 20 or 100 * repeats > 30 * n or (10 * symbols > n and symbols >= 5) or (lines >= 10 and 10 * lines > n)
        if not (bad or chars > 25 * n or chars < 2 * n):
            out.append(r)
    return out


def brute_mix(rows, labels):
    """Ids that mixing keeps: naive Bayes, one rate for each document, thinned."""
    texts = {r[0]: r[1] or "" for r in rows}
    letters = {d: regex.findall(r"\p{L}+", t.lower()) for d, t in texts.items()}
    domain = {d: "toxic" if t else "high" if q else "low" for d, q, t in labels if d in texts}
    n = collections.Counter(domain.values())
    toxic, others = n["toxic"], sum(n.values()) - n["toxic"]
    seen = {True: collections.Counter(), False: collections.Counter()}
    for d, name in domain.items():
        seen[name == "toxic"].update(set(letters[d]))
    odds = {w: math.log((c + 0.5) / (toxic + 1)) - math.log((seen[False][w] + 0.5) / (others + 1)) for w, c in seen[True].items() if c >= max(3, toxic // 100)}
    lexicon = set(sorted((w for w, x in odds.items() if x > 2.5), key=lambda w: (-odds[w], w))[: mixing.LEXICON])

    def bins(d):
        t, w = texts[d], letters[d]
        size = max(1, len(WS.findall(t)))
        over = lambda x, edges: sum(x > e for e in edges)
        return (
            over(sum(c in "#*$%&|<>" for c in t) / size, [0.1, 0.5]),
            over(sum("A" <= c <= "Z" for c in t) / size, [0.5, 2.0]),
            over(len(set(w)) / max(1, len(w)), [0.15, 0.3, 0.45]),
            over(len(set(w) & lexicon), [0, 1, 3]),
        )

    b = {d: bins(d) for d in texts}
    counts = collections.Counter((k, name, b[d][k]) for d, name in domain.items() for k in range(4))
    p = {}
    for d in texts:
        logs = [math.log((n[x] + 1) / (len(domain) + 3)) + sum(math.log((counts[k, x, b[d][k]] + 1) / (n[x] + 4)) for k in range(4)) for x in mixing.DOMAINS]
        e = [math.exp(x - max(logs)) for x in logs]
        p[d] = [x / sum(e) for x in e]
    ids = sorted(texts)
    post = np.array([p[d] for d in ids])
    tokens = np.array([len(WS.findall(texts[d])) for d in ids], float)
    share = post * (tokens / tokens.sum())[:, None]
    want = np.array([mixing.TARGETS[x] for x in mixing.DOMAINS]) / sum(mixing.TARGETS.values())
    at_one, rate, last = np.maximum(share.sum(0), 1e-6), np.ones(len(ids)), None
    for _ in range(mixing.ROUNDS):
        error = (rate @ share - want) / at_one
        if last is not None and abs(error - last).max() < mixing.EXACT:
            break
        last = error
        rate = np.maximum(0, rate * (1 - mixing.STEP * mixing.PULL) + mixing.STEP * mixing.PULL - mixing.STEP * (post @ error))
    high = post[:, 0] == post.max(1)
    rate = np.where(high, 1.0, np.minimum(1.0, rate / (rate[high].min() or 1.0)))
    draw = [xxhash.xxh64_intdigest(d.to_bytes(8, "little"), xxhash.xxh64_intdigest(b"mix", 42)) % (1 << 30) / (1 << 30) for d in ids]
    return {d for d, x, y in zip(ids, rate, draw, strict=True) if math.floor(x + y) > 0}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    rows, labels = small_corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


@pytest.fixture(scope="module")
def result(spark, folder):
    """The rows of each stage but the last."""
    from lodestone.llm._common import stage

    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = stage(f(spark, docs, folder))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        out.append({tuple(r) for r in docs.collect()})
    return out


def test_stages_follow_plain_python(result):
    rows, labels = small_corpus()
    rows = brute_kept(rows)
    assert {r[0] for r in rows} == {r[0] for r in result[0]} and result[0] == set(rows)
    texts = brute_lines(rows, linededup.MIN_WORDS)
    rows = [(d, texts[d], lang, src, len(texts[d])) for d, _, lang, src, _ in rows]
    assert result[1] == set(rows) and any(r[4] == 0 for r in rows)
    # texts emptied by line dedup share the zero fingerprint, so one row of them stays
    of = brute_components({r[0]: brute_fingerprint(r[1]) for r in rows})
    rows = [r for r in rows if of[r[0]] == r[0]]
    assert result[2] == set(rows) and not {3001, 3003, 3005} & {r[0] for r in rows}
    kept = brute_mix(rows, labels)
    assert {r[0] for r in result[3]} == kept and result[3] <= set(rows)
    assert len(kept) < len(rows)


def test_run_packs_what_the_stages_keep(spark, folder, result):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, text, *_ in result[-1]:
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    out = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [x for x, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert rules.passing(spark.createDataFrame([], SCHEMA)).count() == 0
