import hashlib

import numpy as np

from lodestone.llm import exact_dedup, simhash, suffix

from ._docs import hard_rows, table


def brute_exact(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    return {(d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows}


def test_exact(spark):
    rows = hard_rows()
    assert {tuple(r) for r in exact_dedup.exact_dedup(table(spark, rows, extra=True)).collect()} == brute_exact(rows)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_exact_with_a_full_filter(spark, monkeypatch):
    rows = hard_rows() * 1 + [(100 + k, f"t{k % 40}", None, None, 1) for k in range(300)]
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 1 << 15)
    monkeypatch.setattr(exact_dedup, "_slot", lambda h, m, k, f=exact_dedup._slot: f(h, 64, k))
    assert {tuple(r) for r in exact_dedup.exact_dedup(table(spark, rows)).collect()} == brute_exact(rows)


def test_exact_marks_rows_that_are_wholly_equal(spark):
    out = exact_dedup.exact_dedup(table(spark, [(1, "a", None, None, 1)] * 3)).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in out] == [(1, 3, True)] * 3


def brute_fingerprint(text):
    import xxhash

    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_simhash(spark):
    rows = hard_rows()
    fps = {d: brute_fingerprint(t) for d, t, *_ in rows}
    want = {(d, f"{fps[d]:016x}", c) for d, c in brute_components(fps).items()}
    assert {tuple(r) for r in simhash.near_duplicates(table(spark, rows, extra=True)).collect()} == want
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_links_dense_and_split_blocks(spark):
    rng = np.random.default_rng(3)
    fps = {}
    for center in rng.integers(0, 1 << 63, 6, dtype=np.uint64).tolist():
        for _ in range(60):
            x = center
            for b in rng.integers(0, 64, rng.integers(0, 9)).tolist():
                x ^= 1 << b
            fps.setdefault(x, len(fps))
    signed = [(x - (1 << 64) if x >> 63 else x, d) for x, d in fps.items()]
    want = brute_components({d: x for x, d in fps.items()})
    nodes = spark.createDataFrame(signed, "fp long, rep long")
    for block in (4096, 7):
        from lodestone.llm._common import components

        got = {r.node: r.root for r in components(simhash.links(nodes, block=block)).collect()}
        assert {d: got.get(d, d) for d in want} == want


def test_every_pair_within_four_bits_shares_a_chain():
    rng = np.random.default_rng(5)
    keys = simhash._keys()
    for _ in range(4000):
        a = int(rng.integers(0, 1 << 63, dtype=np.uint64))
        b = a
        for bit in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
            b ^= 1 << bit
        fp = np.array([a, b], np.uint64)
        assert any((a ^ b) & mask == 0 and list(simhash._forest(fp, start, 4)) for start, mask in keys)


def covered(rows, units, length, elsewhere):
    """Positions of units in strings of ``length`` that start elsewhere too, by row; or that another row has."""
    seen = {}
    for k, u in enumerate(units):
        for p in range(len(u) - length + 1):
            seen.setdefault(tuple(u[p : p + length]), []).append((k, p))
    cover = [set() for _ in rows]
    for at in seen.values():
        if len(at) > 1 and (not elsewhere or len({k for k, _ in at}) > 1):
            for k, p in at:
                cover[k].update(range(p, p + length))
    return cover


def runs(positions):
    return sum(1 for p in positions if p - 1 not in positions)


def brute_spans(rows, length, words=51):
    data = [(t or "").encode() for _, t, *_ in rows]
    out = set()
    for r, b, c, w in zip(rows, data, covered(rows, data, length, False), covered(rows, [b.split() for b in data], words, True), strict=True):
        out.add((r[0], len(b), len(c), runs(c), hashlib.sha256(bytes(x for p, x in enumerate(b) if p not in c)).hexdigest(), runs(w), len(w)))
    return out


def test_suffix_repeats(spark):
    rows = hard_rows()
    rng = np.random.default_rng(2)
    parts = ["".join(rng.choice(list("abcd "), 150)) for _ in range(6)]
    for _ in range(40):
        rows.append((len(rows), "".join(parts[k][: int(rng.integers(40, 150))] for k in rng.integers(0, 6, 8)), None, None, 0))
    want = brute_spans(rows, 400)
    assert {tuple(r) for r in suffix.remove_repeats(table(spark, rows, extra=True)).collect()} == want
    want = brute_spans(rows, 90, 14)
    for group in (suffix.GROUP, 2):
        assert {tuple(r) for r in suffix.remove_repeats(table(spark, rows), 90, 30, group, 14, 4).collect()} == want
    assert suffix.remove_repeats(table(spark, [])).count() == 0


def test_suffix_passages_need_another_document(spark):
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**9, n))
    a, b = word(60), word(60)
    # twice in one text alone; once alone and once in two texts, with other white space; 50 words only
    texts = [f"{a} {word(9)} {a}", f"{b} {word(20)} {b}", word(30) + "\n" + b.replace(" ", "  "), word(50), "x " * 300]
    rows = [(k, t, None, None, 0) for k, t in enumerate([*texts, texts[3] + " tail"])]
    got = suffix.remove_repeats(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_passages, r.n_passage_words) for r in got} == {0: (0, 0), 1: (2, 120), 2: (1, 60), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
    assert {tuple(r) for r in got} == brute_spans(rows, 400)


def test_suffix_groups_hold_every_occurrence(spark):
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    part = word(500)
    rows = [(k, word(50 * k + 49) + str(k) + part + str(k + 4) + word(70), None, None, 0) for k in range(4)]
    found = suffix.groups(table(spark, rows).selectExpr("doc_id uid", "text")).distinct().collect()
    union = {k: {p for r in found if r.uid == k for p in range(r.s, r.e)} for k in range(4)}
    assert union == {k: set(range(50 * k + 50, 50 * k + 550)) for k in range(4)}
    assert all(len({r.uid for r in found if r.repeat == x}) == 4 for x in {r.repeat for r in found})


def test_suffix_long_texts_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefgh    "), 30000))
    rows = [(1, long + long[5000:5600] + "x" * 900, None, None, 0), (2, long[29000:], None, None, 0), (3, "y" * 399 + long[100:499], None, None, 0)]

    def anchors():
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([rows[0][1]])], names=["uid", "text"])
        found = [tuple(x) for b in suffix._find(400, 128, 51, 8)(iter([batch])) for x in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        assert len(found) == len(set(found))
        return set(found)

    whole = anchors()
    monkeypatch.setattr(suffix, "_CHUNK", 2000)
    assert anchors() == whole
    monkeypatch.undo()
    assert {tuple(r) for r in suffix.remove_repeats(table(spark, rows)).collect()} == brute_spans(rows, 400)


def test_suffix_rows_with_equal_ids(spark):
    text = "abc" * 200
    out = suffix.remove_repeats(table(spark, [(1, text, None, None, 0), (1, text, None, None, 0)])).collect()
    assert [(r.n_removed, r.n_spans) for r in out] == [(600, 1)] * 2
