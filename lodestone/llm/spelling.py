"""Spelling variants: frequent words and the rarer ones that differ from them by one character.

An error leaves one half of a word as it is. Words meet on that half, exactly: the first one for errors behind it, the
last one for errors before it. The rest of the words of a group, read forward behind a first half and backward before a
last half, is a minimal acyclic automaton whose paths number its words (perfect hashing), so that a path that completes
a word with one error names the word it ends at. A pair counts in the half that holds its edit, taken as far right as it
can be, so no pair comes twice.

A half that more than ``BLOCK`` words share is refined: its words meet anew on all but a quarter, then on all but an
eighth, until the part that may differ is one character, which few words can share; so a task's automaton is bounded,
and no group of words is ever compared in pairs.

Words are case-folded for A-Z only. Null and empty texts have no words; a null id counts as an empty string. Ties of
frequency go to the smallest word by code points. Repeated rows count as often as they come, an empty table gives an
empty result, and columns besides doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import documents, stage

LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO, BLOCK = 7, 2, 10, 20_000
#: One occurrence in so many is misspelt by a character left out.
SLIP = 31
_A, _a = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of all texts of ``docs`` (doc_id, text), with the slips that the checksum of id and run asks for."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _A, _a).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """Minimal acyclic automaton of sorted distinct strings. steps[node][char] is (node, words of this node before it)."""

    def __init__(self, strings: list[str]):
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._count: list[int] = []
        self._seen: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]
        last = ""
        for s in strings:
            k, most = 0, min(len(s), len(last))
            while k < most and s[k] == last[k]:
                k += 1
            self._freeze(path, last, k)
            path += [[False, {}] for _ in s[k:]]
            path[-1][0] = True
            last = s
        self._freeze(path, last, 0)
        self.root = self._node(*path[0])

    def _freeze(self, path: list[list], chars: str, depth: int) -> None:
        """Nodes below ``depth`` get no more branches."""
        while len(path) > depth + 1:
            node = self._node(*path.pop())
            path[-1][1][chars[len(path) - 1]] = node

    def _node(self, final: bool, kids: dict[str, int]) -> int:
        mark = (final, *kids.items())
        if (found := self._seen.get(mark)) is not None:
            return found
        self._seen[mark] = k = len(self.steps)
        total, steps = int(final), {}
        for c, t in kids.items():
            steps[c] = (t, total)
            total += self._count[t]
        self.steps.append(steps)
        self.final.append(final)
        self._count.append(total)
        return k

    def _ends(self, node: int, number: int, s: str, at: int) -> int:
        """Number of the string that is the rest of ``s`` from ``at`` on, below ``node``; -1 if there is none."""
        steps = self.steps
        for c in s[at:]:
            step = steps[node].get(c)
            if step is None:
                return -1
            node, number = step[0], number + step[1]
        return number if self.final[node] else -1

    def one_error(self, s: str) -> set[int]:
        """Numbers of the strings that differ from ``s`` by one character inserted, deleted or replaced."""
        found, node, number, steps, ends = set(), self.root, 0, self.steps, self._ends
        for i in range(len(s) + 1):
            c = s[i : i + 1]
            for d, (t, before) in steps[node].items():
                if d != c:  # a character that equals the next one is inserted behind it
                    found.add(ends(t, number + before, s, i))
                    if c:
                        found.add(ends(t, number + before, s, i + 1))
            if not c:
                break
            found.add(ends(node, number, s, i + 1))
            step = steps[node].get(c)
            if step is None:
                break
            node, number = step[0], number + step[1]
        found.discard(-1)
        return found


def _group(window: str, rows: list[tuple[str, int, bool]]) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, its n) of the words that share all but ``window`` (level|part|prefix|suffix)."""
    level, part, prefix, suffix = window.split("|")
    lo, end = len(prefix), len(suffix)
    back = -1 if int(part) % 2 == 0 else 1
    rests = sorted((w[lo : len(w) - end][::back], w, n) for w, n, _ in rows)
    numbered = Automaton([r for r, _, _ in rests])
    asking = {w for w, _, asks in rows if asks}
    for rest, w, n in rests:
        if w in asking:
            hi = len(w) - end
            for k in numbered.one_error(rest):
                _, v, m = rests[k]
                i, most = lo, min(len(w), len(v))
                while i < most and w[i] == v[i]:
                    i += 1
                if i < hi or hi == len(w):  # the edit, as far right as it can be, lies in this window
                    yield w, n, v, m


def _search(whole: bool):
    """``whole``: every pair; else one row for each word of a group with its near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out: list[tuple] = []
        for window, own in groupby(rows, key=lambda r: r[0]):
            mine = [r[1:] for r in own]
            if len(mine) > 1:
                near = _group(window, mine)
                out += ((w, 1, m, v) for w, _, v, m in near) if whole else _best(near)
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _best(near: Iterator[tuple[str, int, str, int]]) -> Iterator[tuple]:
    for w, own in groupby(near, key=lambda r: r[0]):
        k, best = 0, None
        for _, _, v, m in own:
            k += 1
            best = min(best or (-m, v), (-m, v))
        yield w, k, -best[0], best[1]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    w, k, m, v = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(w), pa.array(k, pa.int64()), pa.array(m, pa.int64()), pa.array(v)], names=["word", "n_near", "near_n", "near"])


def _windows(level: int, parts: list[Column], asked: Column) -> Column:
    """Windows of a word, as those of its own length ask for them and as those one shorter or longer do: key, asks."""
    pieces, out = 1 << level, []
    for j in parts:
        keys = []
        for longer in (0, -1, 1):
            n = F.length("word") + longer
            lo, hi = F.floor(n * j / pieces).cast("int"), F.floor(n * (j + 1) / pieces).cast("int")
            end = n - hi
            key = F.concat_ws("|", F.lit(str(level)), j.cast("string"), F.substring("word", F.lit(1), lo), F.substring("word", F.length("word") - end + 1, end))
            keys.append(F.when((lo < hi) & (lo + end <= F.length("word")), key))
        out.append(F.transform(F.array_distinct(F.array_compact(F.array(*keys))), _asks(keys[0], asked)))
    return F.explode(F.flatten(F.array(*out)))


def _asks(mine: Column, asked: Column):
    return lambda key: F.struct(key.alias("key"), (key.eqNullSafe(mine) & asked).alias("asks"))


def _near(found: DataFrame, whole: bool, block: int) -> DataFrame:
    """Searches the windows of ``found`` (word, n; staged), level by level while windows are too full."""
    level, parts, asked, rows, out = 1, [F.lit(0), F.lit(1)], F.lit(True), found, None
    longest = found.agg(F.max(F.length("word"))).first()[0] or 0
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        rows = rows.select("word", "n", _windows(level, parts, asked).alias("x")).select("x.key", "word", "n", "x.asks")
        full = stage(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block).select("key")) if 1 << level <= longest else None
        last = full is None or not full.limit(1).count()
        fit = rows if last else rows.join(full, "key", "left_anti")
        done = fit.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_search(whole), "word string, n_near long, near_n long, near string")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        again = rows.join(full, "key", "left_semi").select("word", "n", F.split("key", r"\|")[1].cast("int").alias("part"), "asks")
        rows = stage(again.groupBy("word", "n", "part").agg(F.max("asks").alias("asked")))
        level, parts, asked = level + 1, [F.col("part") * 2, F.col("part") * 2 + 1], F.col("asked")


def near_words(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair of words of ``found`` (word, n; each word once) at one error: word, near, near_n; both ways round."""
    return _near(found, True, block).select("word", "near", "near_n")


def spelling_variants(found: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form (the near word with the largest n, if ``ratio`` times the word's), form_n, root, for every word."""
    best = _near(found, False, block)
    own = found.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    both = own.unionByName(best.select("word", F.lit(None).cast("long").alias("n"), "n_near", "near_n", "near"))
    first = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    all_ = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("x"))
    fits = -F.col("x.less") >= ratio * F.col("n")
    all_ = stage(all_.select("word", "n", "n_near", F.when(fits, F.col("x.near")).alias("form"), F.when(fits, -F.col("x.less")).alias("form_n")))
    # frequencies rise by the ratio with each form, so chains are short, and each round doubles what is followed
    roots = stage(all_.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(ahead, "root", "left_semi").limit(1).count():
            break
        roots = stage(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return all_.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` with their near words, the form they are a variant of, and its root."""
    return spelling_variants(stage(words(documents(spark, sf_dir))))
