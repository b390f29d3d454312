"""Removal of repeated passages by common-prefix interval trees over anchored suffixes.

Which positions can start or hold a repeat is found first: the minimizers of all windows of ``length`` units
(hashes of ``gram`` units) are anchors, and two equal windows have the same anchor at the same place. An anchor's
context is every unit of the windows that hold it. Anchors whose hash occurs once end there, and occurrences
with equal contexts (by a 128-bit digest) are one member from then on, counted, so copies of any number cost one.

The members of an anchor form an enhanced suffix array: sorted by what follows, with common-prefix lengths. A
stack scan over these gives the interval tree; every interval is a set of members with a common right extension.
Walking it bottom-up, each interval's members are put in order of what precedes them: where neighbours' common
left extension differs from that of others the interval splits in repeats that cannot be extended, and the
longest left extension of each member, with the interval's depth, is the repeat that all its occurrences share.
``groups`` lists these repeats, each with all of its occurrences. There is no array over the whole corpus: arrays are of
anchors, so that they are built apart. An anchor with over ``GROUP`` members is not brought to one task: its windows
are hashed and counted by a shuffle instead, with the same spans.

It is done for two kinds of units in one scan. Units of bytes: a repeat of ``LENGTH`` bytes or more, wherever else it
starts, covers its bytes, which are removed. Units of words (runs of anything but the six ASCII separators): ``WORDS`` words
or more that another document has too are a passage, whatever its bytes; passages are reported, not removed.

Null texts count as empty. A text shorter than ``length`` units holds no repeat. Repeats don't cross texts;
both overlapping repeats count. Rows with equal ids are different documents. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import attach, stage, touched

LENGTH, GRAM, GROUP = 400, 128, 32768
#: A passage has so many words at least, and its anchors so many.
WORDS, WORD_GRAM, CODE = 51, 8, 8
BYTES_KIND, WORDS_KIND = 0, 1
_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Roller:
    """64-bit hashes of every substring of one length, by prefix sums modulo 2^64 of mixed byte values."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of ``values`` (mixed 64-bit numbers)."""
        if len(self.up) <= len(values):
            n = max(_CHUNK + 4 * LENGTH, len(values) + 1)
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, size: int) -> np.ndarray:
        h = (prefix[size:] - prefix[:-size]) * self.down[: len(prefix) - size]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * self.down[start]
        h ^= h >> np.uint64(31)
        return h * np.uint64(0x94D049BB133111EB) ^ (end - start).astype(np.uint64)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and code of each word of ``data``."""
        inner = np.concatenate(([False], ~_APART[data], [False]))
        edge = np.flatnonzero(inner[1:] != inner[:-1])
        start, end = edge[::2], edge[1::2]
        codes, at = np.empty(len(start), np.uint64), 0
        while at < len(start):  # prefix sums over a part of bounded size, or one long word
            to = max(at + 1, int(np.searchsorted(end, start[at] + _CHUNK, side="right")))
            p = self.prefix(self.values[data[start[at] : end[to - 1]]])
            codes[at:to] = self.spans(p, start[at:to] - start[at], end[at:to] - start[at])
            at = to
        codes ^= codes >> np.uint64(29)
        codes *= np.uint64(0xBF58476D1CE4E5B9)
        return start, codes ^ (codes >> np.uint64(32))


_APART = np.zeros(256, bool)
_APART[[32, 9, 10, 11, 12, 13]] = True


def _anchors(gram: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost least hash of each of ``windows`` (first positions), ``width`` hashes each."""
    low = (gram & ~np.uint64(0xFFFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    best = np.minimum(low[windows], low[windows + (width - size)])
    return np.unique(best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _find(length: int, gram: int, words: int, word_gram: int):
    """Anchors of each text: kind, uid, pos, anchor hash, digest of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for batch in batches:
            at = 0
            uids, data = batch.column(0).to_numpy(), batch.column(1)
            sizes = pc.binary_length(pc.fill_null(data, "")).to_numpy()
            while at < len(sizes):  # as many whole texts as fit a chunk, or one long text
                to, total = at, 0
                while to < len(sizes) and (to == at or total + sizes[to] <= _CHUNK):
                    total += int(sizes[to])
                    to += 1
                texts = [x.as_py().encode() if x.is_valid else b"" for x in data[at:to]]
                bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
                # a line end apart, so that no word crosses texts
                whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
                apart = bounds + np.arange(len(bounds))
                plain = np.delete(whole, apart[1:] - 1)
                yield from _of_units(roll, roll.values[plain], plain, bounds, uids[at:to], length, gram, BYTES_KIND, 1)
                start, codes = roll.words(whole)
                yield from _of_units(roll, codes, codes, np.searchsorted(start, apart), uids[at:to], words, word_gram, WORDS_KIND, CODE)
                at = to

    return run


def _of_units(roll: Roller, values: np.ndarray, data: np.ndarray, bounds: np.ndarray, uids: np.ndarray, length: int, gram: int, kind: int, unit: int) -> Iterator[pa.RecordBatch]:
    """Anchors among ``values`` (a number for each unit) of texts that ``bounds`` parts; digests are of ``data``."""
    total = len(values)
    if total < length:
        return
    view, last = memoryview(np.ascontiguousarray(data)).cast("B"), np.empty(0, np.int64)
    for a in range(0, total, _CHUNK):  # a very long text goes in overlapping parts
        lo, hi = max(0, a - 2 * length), min(total, a + _CHUNK + 2 * length)
        first = np.arange(a, max(a, min(a + _CHUNK, total - length + 1)))
        first = first[np.searchsorted(bounds, first, side="right") == np.searchsorted(bounds, first + length - 1, side="right")]
        if not len(first):
            continue
        p = roll.prefix(values[lo:hi])
        pos = _anchors(roll.hashes(p, gram), first - lo, length - gram + 1)
        pos = pos[~np.isin(pos + lo, last)]  # those of the part before
        h = (p[pos + gram] - p[pos]) * roll.down[pos]
        pos += lo
        last = pos
        d = np.searchsorted(bounds, pos, side="right") - 1
        s, e = np.maximum(pos + gram - length, bounds[d]), np.minimum(pos + length, bounds[d + 1])
        # the digest tells where the anchor lies in its context
        ctx = [hashlib.blake2b(view[x * unit : z * unit], digest_size=16, salt=y.to_bytes(8, "little")).digest() for x, y, z in zip(s.tolist(), (pos - s).tolist(), e.tolist(), strict=True)]
        cols = [pa.array(np.full(len(pos), kind, np.int8)), pa.array(uids[d]), pa.array((pos - bounds[d]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(ctx, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["kind", "uid", "pos", "h", "ctx"])


_MEMBER = "h long, uid long, other long, pos int, n long, hot boolean, before binary, after binary"


def _contexts(sizes: dict[int, tuple[int, int]]):
    """What precedes and follows each asked anchor of a text, out to the ends of the windows that hold it; for words, their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for batch in batches:
            rows, held = [], 0
            for uid, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data, codes = (text.as_py() or "").encode(), None
                for x in asked.as_py():
                    length, gram = sizes[x["kind"]]
                    a, z = max(0, x["pos"] + gram - length), x["pos"] + length
                    if x["kind"] == BYTES_KIND:
                        before, after = data[a : x["pos"]][::-1], data[x["pos"] : z]
                    else:
                        if codes is None:
                            codes = roll.words(np.frombuffer(data, np.uint8))[1]
                        before, after = codes[a : x["pos"]][::-1].tobytes(), codes[x["pos"] : z].tobytes()
                    rows.append((x["kind"], x["h"], uid, x["other"], x["pos"], x["n"], x["hot"], before, after))
                    held += len(before) + len(after)
                if held > 4 << 20:
                    yield _context_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _context_batch(rows)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "h", "uid", "other", "pos", "n", "hot", "before", "after"])


def _common(ordered: list[bytes]) -> np.ndarray:
    """Common-prefix lengths of neighbours."""
    out = np.zeros(max(0, len(ordered) - 1), np.int64)
    for k in range(len(out)):
        a, b = ordered[k], ordered[k + 1]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            out[k] = n
            continue
        x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
        out[k] = int(np.argmax(x != y))
    return out


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the common-prefix tree, children before parents."""
    stack = [(0, 0)]
    for k, x in enumerate([*lcp, 0]):
        first = k
        while stack[-1][0] > x:
            depth, first = stack.pop()
            yield depth, first, k
        if stack[-1][0] < x:
            stack.append((x, first))


def _elsewhere(gaps: np.ndarray, docs: list[tuple[int, int]]) -> np.ndarray:
    """For members in left order the longest left extension that one of another document shares; ``gaps`` are neighbours' own.

    A member is told by its least and greatest document; two that are one document and the same one don't count.
    """
    best = np.full(len(docs), -1, np.int64)
    for order in (1, -1):
        reach = -1
        at = range(len(docs)) if order == 1 else range(len(docs) - 1, -1, -1)
        last = None
        for k in at:
            if last is not None:
                gap = int(gaps[min(k, last)])
                other = docs[k] != docs[last] or docs[k][0] != docs[k][1]
                reach = gap if other else min(gap, reach)
                best[k] = max(best[k], reach)
            last = k
    return best


def repeats(before: list[bytes], after: list[bytes], length: int, unit: int = 1, docs: list[tuple[int, int]] | None = None) -> list[list[tuple[int, int]]]:
    """For each member the extents (left, right), in units, of repeats of ``length`` units or more around the anchor.

    ``before`` is reversed. Left extents that another member of the interval shares are found between
    neighbours in the order of what precedes; with ``docs`` (least and greatest document of each member) only
    what another document shares counts.
    """
    n = len(after)
    right = sorted(range(n), key=after.__getitem__)
    left = sorted(range(n), key=before.__getitem__)
    lcp = _common([after[i] for i in right]) // unit
    lcs = _common([before[i] for i in left]) // unit
    rank = np.empty(n, np.int64)
    rank[left] = np.arange(n)
    ranks = rank[right]
    reach = int(lcs.max()) if n > 1 else 0
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for depth, first, last in intervals(lcp.tolist()):
        if depth + reach < length:
            continue
        own = np.sort(ranks[first : last + 1])
        # common left extension of neighbours within the interval: the least between their ranks
        gaps = np.minimum.reduceat(np.append(lcs, 0), np.column_stack((own[:-1], own[1:])).ravel())[::2] if len(own) > 1 else lcs[:0]
        best = np.maximum(np.append(gaps, 0), np.insert(gaps, 0, 0)) if docs is None else _elsewhere(gaps, [docs[left[k]] for k in own])
        for k in np.flatnonzero(best + depth >= length):
            if best[k] >= 0:
                out[left[own[k]]].append((int(best[k]), depth))
    return out


def _search(length: int, unit: int, each: bool):
    """Repeats in each anchor's group, and where, for members that are one occurrence.

    With ``each`` there is a row for every repeat, with its digest; else one for what a member's repeats, which all hold
    the anchor, cover together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group in batch.column(0):
                x = group.as_py()
                before, after = [m["before"] for m in x], [m["after"] for m in x]
                docs = [(m["uid"], m["other"]) for m in x] if unit > 1 else None
                found = repeats(before, after, length, unit, docs)
                for m, spans in zip(x, found, strict=True):
                    # all windows of a context that several documents have repeat already
                    if m["n"] == 1 or (unit > 1 and m["uid"] == m["other"]):
                        own = set(spans) if each else {(max(a for a, _ in spans), max(b for _, b in spans))} if spans else ()
                        for a, b in own:
                            told = hashlib.blake2b(m["before"][: a * unit] + b"|" + m["after"][: b * unit], digest_size=16).digest() if each else None
                            rows.append((told, m["h"], m["uid"], m["pos"], m["n"], a, b))
            if rows:
                types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["repeat", "h", "uid", "pos", "n", "left", "right"])

    return run


_FOUND = "repeat binary, h long, uid long, pos int, n long, left int, right int"


def _windows(length: int, unit: int):
    """Digests of all windows around an anchor, for anchors with too many members for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, uid, other, pos, n, before, after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lead = len(before) // unit
                data = np.frombuffer(before, np.dtype(f"V{unit}"))[::-1].tobytes() + after
                at = [k for k in range(lead + 1) if len(data) - k * unit >= length * unit]
                if at:
                    w = [hashlib.blake2b(data[k * unit : (k + length) * unit], digest_size=16).digest() for k in at]
                    same = lambda v, t: pa.array([v] * len(at), t)
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), same(h, pa.int64()), same(uid, pa.int64()), same(other, pa.int64()), same(pos, pa.int32()), same(n, pa.int64()), pa.array([lead - k for k in at], pa.int32())], names=["w", "h", "uid", "other", "pos", "n", "left"])

    return run


def _runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The union of spans, as runs in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((max(s, 0), e))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words"]
    for batch in batches:
        out = []
        for doc, text, spans, passages in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            kept, to, removed = hashlib.sha256(), 0, 0
            runs = [(s, min(e, len(data))) for s, e in _runs(spans)]
            for s, e in runs:
                kept.update(data[to:s])
                removed += e - s
                to = e
            kept.update(data[to:])
            held = _runs(passages)
            n = len(data.split()) if held else 0
            out.append((doc, len(data), removed, len(runs), kept.hexdigest(), len(held), sum(min(e, n) - s for s, e in held)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def groups(texts: DataFrame, kind: int = BYTES_KIND, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Occurrences of maximal repeats of ``texts`` (uid, text): repeat (its digest), uid, s, e in units; what lies beyond a text means its end.

    A repeat that is longer than its anchors' contexts comes in parts that overlap.
    """
    found, members, near = _tree(texts, {kind: (length, gram)}, group, True)
    return _spread(found, members, near.where(F.col("kind") == kind), {kind: (length, gram)}).select("repeat", "uid", "s", "e")


def _tree(texts: DataFrame, sizes: dict[int, tuple[int, int]], group: int, each: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors, their members (occurrences with one context), and the repeats found in the trees."""
    b, w = sizes.get(BYTES_KIND, (1 << 40, 1)), sizes.get(WORDS_KIND, (1 << 40, 1))
    found = stage(texts.select("uid", "text").mapInArrow(_find(*b, *w), "kind byte, uid long, pos int, h long, ctx binary"))
    # only hashes move to tell which occur again, and only the anchors of these go on
    again = stage(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    found = stage(touched(found, again, "h").where("__maybe").drop("__maybe"))
    # anchors of one kind and hash, by their contexts; 128 bits of digest stand for a context
    members = found.groupBy("kind", "h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos")).alias("at"), F.max("uid").alias("other"))
    members = stage(members)
    anchors = members.groupBy("kind", "h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = stage(anchors.select(F.struct("kind", "h").alias("key"), "kinds"))
    asked = attach(members.withColumn("key", F.struct("kind", "h")), kinds, "key", "kinds", members.count())
    asked = asked.select("kind", "h", "n", "other", (F.col("kinds") > group).alias("hot"), F.col("at.uid").alias("uid"), F.col("at.pos").alias("pos"))
    lists = stage(asked.groupBy("uid").agg(F.collect_list(F.struct("kind", "h", "other", "pos", "n", "hot")).alias("asked")))
    with_text = touched(texts.select("uid", "text"), lists.select("uid"), "uid").where("__maybe").drop("__maybe").join(lists.hint("merge"), "uid")
    ctx = stage(with_text.mapInArrow(_contexts(sizes), "kind byte, " + _MEMBER))
    near = None
    for kind, (length, _) in sizes.items():
        unit = CODE if kind == WORDS_KIND else 1
        own = ctx.where(F.col("kind") == kind)
        tree = own.where("not hot").groupBy("h").agg(F.collect_list(F.struct("h", "uid", "other", "pos", "n", "before", "after")).alias("x")).select("x").mapInArrow(_search(length, unit, each), _FOUND)
        wide = own.where("hot").select("h", "uid", "other", "pos", "n", "before", "after").mapInArrow(_windows(length, unit), "w binary, h long, uid long, other long, pos int, n long, left int")
        wide = stage(wide)
        if unit == 1:  # a window that holds two anchors is hashed for both
            start = F.struct("uid", F.col("pos") - F.col("left"))
            lo, hi = F.min(start), F.max(start)
        else:
            lo, hi = F.min("uid"), F.max("other")
        twice = stage(wide.groupBy("w").agg(lo.alias("lo"), hi.alias("hi"), F.count("*").alias("c")).where("lo != hi").select("w", "c"))
        far = attach(wide, twice, "w", "c", wide.count()).where("n = 1" if unit == 1 else "uid = other")
        far = far.select(F.col("w").alias("repeat"), "h", "uid", "pos", "n", "left", (F.lit(length) - F.col("left")).alias("right"))
        both = tree.unionByName(far).withColumn("kind", F.lit(kind).cast("byte"))
        near = both if near is None else near.unionByName(both)
    return found, members, stage(near)


def _spread(found: DataFrame, members: DataFrame, near: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """All occurrences (kind, repeat, uid, s, e) of what repeats: whole contexts that several have, and repeats of members."""
    ends = lambda c: F.when(F.col("kind") == WORDS_KIND, c.get(WORDS_KIND, 0)).otherwise(c.get(BYTES_KIND, 0))
    length, gram = ends({k: v[0] for k, v in sizes.items()}), ends({k: v[1] for k, v in sizes.items()})
    # copies of a whole context: all of it repeats; words only where two documents have it
    copied = members.where("n > 1")
    elsewhere = (F.col("kind") == BYTES_KIND) | (F.col("at.uid") != F.col("other"))
    total = copied.agg(F.sum("n")).first()[0] or 0
    keyed = found.withColumn("k", F.struct("kind", "h", "ctx"))
    sure = stage(copied.where(elsewhere).select(F.struct("kind", "h", "ctx").alias("k"), "n"))
    sure = attach(keyed.select("kind", "k", "uid", "pos"), sure, "k", "n", total)
    sure = sure.select("kind", F.col("k.ctx").alias("repeat"), "uid", (F.col("pos") + gram - length).alias("s"), (F.col("pos") + length).alias("e"))
    # a member of one document that occurs there several times: its repeats are those of each occurrence
    single = near.where("n = 1 or kind = 0").select("kind", "repeat", "uid", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("right")).alias("e"))
    if WORDS_KIND in sizes:
        several = near.where(f"n > 1 and kind = {WORDS_KIND}").select("kind", "h", "uid", "pos", "repeat", "left", "right")
        own = members.where(f"n > 1 and kind = {WORDS_KIND}").select("kind", "h", "ctx", "at.uid", "at.pos")
        several = several.join(own, ["kind", "h", "uid", "pos"]).select("kind", "h", "ctx", "uid", "repeat", "left", "right")
        again = found.join(several, ["kind", "h", "ctx", "uid"]).select("kind", "repeat", "uid", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("right")).alias("e"))
        single = single.unionByName(again)
    return sure.unionByName(single)


def repeated_spans(texts: DataFrame, sizes: dict[int, tuple[int, int]] | None = None, group: int = GROUP) -> DataFrame:
    """Spans (kind, uid, s, e) that cover the repeats of ``texts`` (uid, text), uid being unique."""
    sizes = sizes or {BYTES_KIND: (LENGTH, GRAM), WORDS_KIND: (WORDS, WORD_GRAM)}
    return _spread(*_tree(texts, sizes, group), sizes).select("kind", "uid", "s", "e")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages and n_passage_words of every row of ``docs``."""
    texts = docs.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        texts = stage(texts.withColumn("uid", F.monotonically_increasing_id()))  # ids don't tell the rows apart
    spans = repeated_spans(texts, {BYTES_KIND: (length, gram), WORDS_KIND: (words, word_gram)}, group)
    # windows of one text overlap, so its distinct spans are few beside its bytes
    of = lambda kind, name: F.collect_set(F.when(F.col("kind") == kind, F.struct("s", "e"))).alias(name)
    merged = stage(spans.groupBy("uid").agg(of(BYTES_KIND, "spans"), of(WORDS_KIND, "passages")))
    rows = touched(texts, merged.select("uid"), "uid")
    none = F.array().cast("array<struct<s:int,e:int>>")
    near = rows.where("__maybe").drop("__maybe").join(merged.hint("merge"), "uid", "left")
    plain = rows.where("not __maybe").drop("__maybe").withColumn("spans", none).withColumn("passages", none)
    out = near.unionByName(plain).select("doc_id", "text", "spans", "passages")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long")


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` without the bytes of 400-byte strings that also start elsewhere, and their passages that others have."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
