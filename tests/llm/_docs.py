"""Small document tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", fp long, n long, key string, h string, uid string, part string, size string, value string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def hard_rows(seed=1):
    rng = random.Random(seed)
    shared = words(rng, 120)
    rows = [None, "", " ", "\n\n", "one", "one", "ünïcode wörd " * 30, shared, shared, shared]
    rows += [words(rng, rng.randrange(1, 60)) + "\n" + shared + "\n" + words(rng, 30) for _ in range(6)]
    rows += [words(rng, 5000), "ab " * 4000, words(rng, 200) + " " + words(rng, 3).upper()]
    rows += [shared.replace("w1", "w2", k) for k in range(1, 4)]
    return [(k, t, "en" if k % 3 else None, None, len(t or "")) for k, t in enumerate(rows)]


def table(spark, rows=None, extra=False):
    rows = hard_rows() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, SCHEMA)
    return spark.createDataFrame([(*r, None, 7, "k", "h", "u", "p", "s", "v") for r in rows], EXTRA)
