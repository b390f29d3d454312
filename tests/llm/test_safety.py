import hashlib
import random
import re

import numpy as np

from lodestone.llm import license as licences
from lodestone.llm import pii, toxicity

from ._docs import hard_rows, table

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        s = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(rx, text or "") if brute_valid(k, m.group())] for k, rx in RX.items()}


def pii_rows():
    rng = random.Random(4)
    bits = ["a.b@c.de", "x@y", "é@ü.com", "1.2.3.4", "256.1.1.1", "001.02.3.4", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539148803436468", "79927398713", "+1 (017) 555-7713", "+49.30.123", "+1 2 ", "12-34", "ß😀", "a@b.c_d@e.f", "0" * 14, "the", "of", "\n"]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))), None, None, 0) for k in range(120)]
    rows += [(200, "1 " * 30000, None, None, 0), (201, "7" * 5000, None, None, 0), (202, "a." * 3000 + "b@c" + ".d" * 4000, None, None, 0)]
    return rows + [(300 + k, t, a, b, c) for k, t, a, b, c in hard_rows()]


def test_base_spans(spark):
    rows = pii_rows()
    got = {r.doc_id: r for r in pii.find(table(spark, rows, extra=True)).collect()}
    for d, t, *_ in rows:
        want = brute_base(t)
        assert {k: [(s.start, s.end) for s in got[d][k]] for k in pii.KINDS} == want, t[:200]
    assert pii.find(table(spark, [])).count() == 0


def test_digest(spark, tmp_path):
    rows = pii_rows()[:60]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op2_contextual_pii(spark, str(tmp_path)).collect():
        base = brute_base(rows[r.doc_id][1])
        told = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.spans.startswith(told) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)


def test_patterns_discover_identifiers(spark):
    rows = [(k, f"Please reach me at u{k}@mail.org today. And {k}{k}77 boxes", None, None, 0) for k in range(8)]
    rows += [(20, "Please reach me at j0hn(at)mail tonight", None, None, 0), (21, "we sold 12345 boxes of 55555 things", None, None, 0)]
    got = {r.doc_id: [(s.start, s.end) for s in r["id"]] for r in pii.find(table(spark, rows)).collect()}
    assert rows[8][1][got[20][0][0] : got[20][0][1]] == "j0hn(at)mail"
    assert all(not v for d, v in got.items() if d != 20)


def test_every_base_span_is_a_seed(spark):
    phones = [f"+1 (743) 555-38{k:02d}" for k in range(10, 18)]
    rows = [(k, f"you may dial at once {p} for help", None, None, 0) for k, p in enumerate(phones)]
    rows += [(10 + k, f"then write straight to {n}.doe@example.com please", None, None, 0) for k, n in enumerate(["jane", "john", "mary", "paul", "lisa", "omar", "nina", "tess"])]
    rows += [(30, "you may dial at once 743x5553824 for help", None, None, 0), (31, "room 10 floor 20 write straight to k77(at)example for it", None, None, 0)]
    got = {r.doc_id: [rows_text[s.start : s.end] for s in r["id"]] for r in pii.find(table(spark, rows)).collect() for rows_text in [dict(x[:2] for x in rows)[r.doc_id]]}
    assert got[30] == ["743x5553824"] and got[31] == ["k77(at)example"]
    assert all(not v for d, v in got.items() if d < 30)


def test_secrets_teach_their_context(spark):
    rng = random.Random(5)
    rows = [(k, f"set token = {rng.getrandbits(160):040x}a"[:52] + " in the file", None, None, 0) for k in range(8)]
    rows += [(20, "set token = hunter2-and-3 in the file", None, None, 0), (21, f"the commit {rng.getrandbits(160):040x} is old, chapter 12345 too", None, None, 0)]
    got = {r.doc_id: [t[s.start : s.end] for s in r["id"]] for r in pii.find(table(spark, rows)).collect() for t in [dict(x[:2] for x in rows)[r.doc_id]]}
    assert got[20] == ["hunter2-and-3"] and got[21] == []
    assert all(len(got[k]) == 1 for k in range(8))


def test_long_runs_take_linear_time(spark):
    import time

    texts = ["x" * 1_000_000 + " x@y 1", "7" * 1_000_000, "1." * 300_000, "+1 " * 200_000, "a@" * 300_000 + "1", "a1 b2@c.de " * 30_000]
    rows = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    began = time.time()
    got = {r.doc_id: {k: len(r[k]) for k in pii.KINDS} for r in pii.find(table(spark, rows), rounds=1).collect()}
    assert time.time() - began < 100
    assert {k: {kind: n for kind, n in v.items() if n} for k, v in got.items()} == {0: {}, 1: {}, 2: {"ip": 75_000}, 3: {}, 4: {}, 5: {"email": 30_000}}


def test_graph_scores(spark):
    rng = random.Random(9)
    found = [(f"v{rng.randrange(30)}", k) for k in range(90)]
    seeds = {f"v{k}" for k in range(0, 30, 2)}
    found = [(v, v in seeds, [f"s:{rng.randrange(6)}", f"q{rng.randrange(12)}"]) for v, _ in found]
    df = spark.createDataFrame(found, "value string, seed boolean, patterns array<string>")
    for rounds in (1, 6):
        trusted, values = pii.score(df, rounds, 3, 0.5)
        edges = {(p, v) for v, _, ps in found for p in ps}
        conf, last = {v: float(v in seeds) for v, *_ in found}, None
        for _ in range(rounds):
            of = {p: [v for q, v in edges if q == p] for p, _ in edges}
            p = {q: sum(1.0 if v in seeds else 0.0 if q[0] == "s" else conf[v] / 2 for v in vs) / (len(vs) + 1) for q, vs in of.items()}
            ok = {q: sum(v in seeds for v in vs) >= 3 for q, vs in of.items()}
            conf = {v: 1.0 if v in seeds else 1 - float(np.prod([1 - p[q] for q, w in edges if w == v and ok[q]])) for v in conf}
            now = (sum(p.values()) / len(p), sum(ok[q] and p[q] >= 0.5 for q in p))
            if last and now[1] == last[1] and abs(now[0] - last[0]) < pii.STILL:
                break
            last = now
        assert {r.pattern: round(r.conf, 6) for r in trusted.collect()} == {q: round(p[q], 6) for q in p if ok[q] and p[q] >= 0.5}
        assert {r.value: round(r.conf, 6) for r in values.collect()} == {v: round(c, 6) for v, c in conf.items()}


def toxic_rows(n=600):
    rng = random.Random(12)
    vocab = [f"{a}{b}{c}" for a in "bdfgkp" for b in "aeiou" for c in "lmnrst"]
    out = []
    for k in range(n):
        ws, bad = [rng.choice(vocab) for _ in range(rng.randrange(10, 80))], k % 4 == 0
        for _ in range(3 if bad else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "moron,", "Scum"]))
        out.append((k, " ".join(ws), int(bad)))
    return out


def test_toxicity(spark):
    rows = toxic_rows()
    docs = table(spark, [(k, t, None, None, 0) for k, t, _ in rows] + [(9000, None, None, None, 0), (9001, "", None, None, 0), (9002, "x" * 100_000, None, None, 0)])
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(None, None, None)], "doc_id long, quality int, toxic int")
    texts, ys = toxicity.training_rows(docs, labels)
    assert len(texts) == sum(not toxicity.held_out(k) for k, *_ in rows)
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(texts, ys)).collect()}
    held = [(k, y) for k, _, y in rows if toxicity.held_out(k)]
    assert np.mean([out[k].predicted == y for k, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert out[9000].predicted == out[9001].predicted == 0 and len(out) == len(rows) + 3


def test_toxicity_without_telling_words():
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}{d}{e}" for a in "bdfgkp" for b in "aeiou" for c in "lmnrst" for d in "aeiou" for e in "bcdfghjk"]

    def text(bad):  # toxic texts have half of the words somewhat more often, none of them eight times as often
        own, other = (vocab[::2], vocab[1::2]) if bad else (vocab[1::2], vocab[::2])
        return " ".join(rng.choice(own if rng.random() < 0.65 else other) for _ in range(500))

    ys = [k % 2 for k in range(800)]
    texts = [text(y) for y in ys]
    coder = toxicity.Coder()
    assert toxicity._residues([coder.encode(t) for t in texts[:600]], np.array(ys[:600]), 8.0) == ([], [])
    m = toxicity.fit(texts[:600], ys[:600])
    tools = m.tools()
    got = [m.score(m.gaps(coder, tools, t)) >= 0.5 for t in texts[600:]]
    assert np.mean(np.array(got) == np.array(ys[600:])) > 0.9


def test_toxicity_lengths_are_those_of_plain_compression():
    rows = toxic_rows()
    m = toxicity.fit([t for _, t, _ in rows], [y for *_, y in rows])
    gaps = m.gaps(toxicity.Coder(), m.tools(), rows[0][1])
    import xxhash
    import zstandard

    words = re.findall(r"[a-z]+", rows[0][1].lower())
    codes = [xxhash.xxh64_digest(w.encode()) for w in words]
    size = []
    for content in (m.ordinary, m.toxic):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(3, min_match=5, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        size.append([len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(b"".join(codes[k : k + 8]) + bytes(32))) for k in range(0, len(codes), 8)])
    assert gaps.tolist() == [a - b for a, b in zip(*size, strict=True)] and gaps.max() >= m.gap


def test_toxicity_learns_once_from_repeated_ids(spark):
    docs = table(spark, [(1, "b", None, None, 0), (1, "a", None, None, 0), (3, None, None, None, 0)], extra=True)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(docs, labels) == (["a", None], [1, 0])


def test_toxicity_without_labels():
    for texts, ys in (([], []), (["a b"], [0]), (["a b"], [1])):
        m = toxicity.fit(texts, ys)
        assert 0 <= m.score(m.gaps(toxicity.Coder(), m.tools(), "some text")) <= 1


def test_licences(spark):
    s = licences.train()
    for family, notices in licences.TEMPLATES.items():
        for t in notices:
            assert s.classify(licences.words_of(t))[0] == family, t
    assert s.classify(licences.words_of("Licensed under the Purple Monkey License, version 9."))[0] == "unknown"
    filler = " ".join(f"word{k % 97}" for k in range(500))
    rows = [(0, None, None, None, 0), (1, "", None, None, 0), (2, filler, None, None, 0), (3, filler + " Licensed under CC BY-NC 4.0. " + filler + "\nAll rights reserved.", None, None, 0), (4, "the general public version", None, None, 0)]
    got = {r.doc_id: (r.n_paragraphs, r.families) for r in licences.scan(table(spark, rows, extra=True), s).collect()}
    assert got == {0: (0, ""), 1: (0, ""), 2: (1, ""), 3: (2, "CC-BY-NC,proprietary"), 4: (1, "")}
    assert licences.scan(table(spark, []), s).count() == 0


def test_every_notice_of_a_paragraph():
    s = licences.train()
    told = lambda text: [(k, c) for k, c, _ in s.scan(text)[1]]
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    filler = " ".join(f"word{k % 97}" for k in range(150))
    assert told(f"{mit} {apache}") == [(0, "MIT"), (0, "Apache-2.0")]
    assert told(f"{mit} {filler} {apache} {filler} {mit}") == [(0, "MIT"), (0, "Apache-2.0"), (0, "MIT")]
    assert told(f"{mit}\n\n{apache}\n{mit}") == [(0, "MIT"), (2, "Apache-2.0"), (3, "MIT")]
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    assert told(gpl) == [(0, "GPL-3.0")]
    assert told(f"{filler}\n * " + gpl.replace("\n", "\n * ") + f"\n\n{mit}") == [(1, "GPL-3.0"), (6, "MIT")]
    assert told("no notice\nat all in these\nlines of text") == []


NOTICES = [
    ("This file is free software under the terms of the GPL version 2 or (at your option) any later version.", "GPL-2.0"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "AGPL-3.0"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "GPL-3.0"),
    ("Licensed under MIT.", "MIT"), ("Our little tool is licensed under MIT. Have fun with it.", "MIT"), ("SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("Anyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "MPL-2.0"), ("SPDX-License-Identifier: Whatever-9.9", "unknown"), ("Licensed under the Glorp License, version 4.", "unknown"),
    ("The weather was fine and the ferry left the harbour at noon.", ""), ("He has a licence to drive, and the copyright of his songs is his own.", ""),
]


def test_everyday_notices(spark):
    found = licences.scan(table(spark, [(k, t, None, None, 0) for k, (t, _) in enumerate(NOTICES)] + [(99, "word " * 200_000 + "Licensed under MIT.", None, None, 0)] * 2)).collect()
    got = {r.doc_id: ",".join(sorted({s.split(":")[1] for s in r.spans.split(",") if s})) for r in found}
    assert {k: got[k] for k in range(len(NOTICES))} == {k: w for k, (_, w) in enumerate(NOTICES)}
    assert got[99] == "MIT" and len(found) == len(NOTICES) + 2
