"""BM25 as tables: postings, term and corpus statistics, and ranking by floors or by products of blocks.

Each text is counted where it lies; only the document frequencies of terms are shuffled. A ranking of many queries packs texts
in blocks where they lie, stores these once, a byte or two for each text's word, and multiplies each block of queries with each block
of texts where that is read: terms of many queries as a dense product, all others posting by posting. A task keeps the k best of each
query, so no row is made for a pair of a query and a text that share a word, and stop words are never joined to all they occur in.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import scoring
from lodestone.functions.text import token_line, tokens
from lodestone.operators.partition import _saved

#: Scores are sums of many terms; rounding makes equal texts tie, whatever the order of the sums.
ROUND = 6
#: Postings that a query's rare terms may have, for each hit asked for; and what sums may be off by.
SEEDS, SLACK = 8, 1e-5
#: Queries of a stored index, at most, that are joined to their postings one by one.
ONE_BY_ONE = 64
#: Texts, words and queries of a block, at most; texts of a piece that a small table is dealt in, at least, and its pieces at most.
TEXTS, WORDS, QUERIES, FEW, SPREAD = 4096, 1 << 21, 8192, 1024, 64
#: Blocks of texts of a task, about, where they are dealt out anew.
PIECE = 64
#: Bytes of texts whose words are found at once.
SLICE = 1 << 18
#: Terms that go through the dense product at most, cells of a piece of scores, and postings of rare terms summed at once.
DENSE, CELLS, PAIRS = 1024, 1 << 21, 1 << 16
#: Bits for each asked term of a bitmap of their hashes, its bounds (4 KiB to 32 MiB), and bits of a row of it.
BITS, LEAST_BITS, MOST_BITS, BLOCK_BITS = 8, 1 << 15, 1 << 28, 1 << 15
#: Terms in over 1/HOT of all postings, HOT at most, are joined by broadcast.
HOT = 20_000


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n (one at least) and avgdl."""
    n = F.size(tokens(F.col(text_col)))
    return docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.coalesce(F.sum(n) / F.greatest(F.count("*"), F.lit(1)), F.lit(0.0)).alias("avgdl"))


def term_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", scoring.bm25_idf(F.col("n"), F.col("df")).alias("idf"))  # stats: one row


def weights(posts: DataFrame, terms: DataFrame, stats: DataFrame, id_col: str = "evidence_id") -> DataFrame:
    """id, term, weight."""
    w = scoring.bm25_weight(F.col("idf"), F.col("tf"), F.col("length"), F.col("avgdl"))
    return _by_term(posts, terms).crossJoin(F.broadcast(stats)).select(id_col, "term", w.alias("weight"))


def _by_term(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """``posts`` joined to their ``terms`` (with df): hot terms by broadcast, so that their postings don't move."""
    most = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] // HOT
    hot = terms.where(F.col("df") > most)
    near = posts.join(F.broadcast(hot), "term")
    rare = posts.join(F.broadcast(hot.select("term")), "term", "left_anti")
    return near.unionByName(rare.join(terms.where(F.col("df") <= most), "term"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    rows = queries.select(id_col, F.explode(tokens(F.col(text_col))).alias("term"))
    return rows.groupBy(id_col, "term").agg(F.count("*").alias("qtf"))


def counted(docs: DataFrame) -> DataFrame:
    """evidence_id, length, rows, terms (array of term and tf): each text's terms, counted where it lies.

    Rows of one id and length are one text, as in the postings; only where ids repeat are words grouped by them. Small
    inputs that come in fewer pieces than there are cores are dealt out first.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores, "evidence_id")
    w = docs.select("evidence_id", tokens(F.col("text")).alias("w")).withColumn("length", F.size("w")).withColumn("rows", F.lit(1).cast("long"))
    if docs.groupBy("evidence_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        w = w.groupBy("evidence_id", "length").agg(F.flatten(F.collect_list("w")).alias("w"), F.count("*").alias("rows"))
    s = w.select("evidence_id", "length", "rows", F.array_sort("w").alias("s"))
    # the places where a run of equal words starts, then the lengths of the runs
    s = s.withColumn("at", F.filter(F.transform("s", lambda x, i: F.when((i > 0) & (x == F.get("s", i - 1)), -1).otherwise(i)), lambda i: i >= 0))
    tf = lambda i, k: (F.coalesce(F.get("at", k + 1), F.size("s")) - i).cast("long")
    return s.select("evidence_id", "length", "rows", F.transform("at", lambda i, k: F.struct(F.get("s", i).alias("term"), tf(i, k).alias("tf"))).alias("terms"))


def _stats(each: DataFrame) -> DataFrame:
    """One row: n (one at least) and avgdl of ``counted`` texts."""
    x = each.agg(F.greatest(F.coalesce(F.sum("rows"), F.lit(0)), F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("length") * F.col("rows")), F.lit(0)).alias("total"))
    return x.select("n", (F.col("total") / F.col("n")).alias("avgdl"))


def index(docs: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """weights (evidence_id, term, weight), terms (term, df, idf) and stats (one row), from one reading of the texts.

    Statistics count all documents; weights and terms are those ``asked`` for (term), where given, and postings are cut to
    these before any shuffle.
    """
    own, terms, stats = _indexed(docs, asked)
    return weights(own, terms, stats), terms, stats


def _indexed(docs: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (evidence_id, length, term, tf), terms and stats of an ``index``."""
    each = _saved(counted(docs))
    stats = _saved(_stats(each))
    own = each.select("evidence_id", "length", F.explode("terms").alias("x")).select("evidence_id", "length", "x.term", "x.tf")
    if asked is not None:
        wanted = asked.select("term").distinct()
        own = own.join(F.broadcast(wanted) if _bounded(asked) else wanted, "term", "left_semi")
    return own, _saved(term_stats(own, stats)), stats


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """query_id, evidence_id, score, rank; statistics count all documents, and texts are neither shuffled nor written but as packed counts.

    Texts of the same words are one text to the ranking, and so are queries; what is ranked is opened to all of them at the end.
    """
    blocks = _saved(_packed(docs), "zstd")
    n, total, many, texts = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("rows", "total")], F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    n = max(n, 1)
    asked = _saved(query_terms(queries))
    df, hashed = _counted_terms(blocks.select(F.explode(F.arrays_zip("words", "posts")).alias("x")).select(F.col("x.words").alias("term"), F.col("x.posts").alias("n")), asked)
    words = asked.join(df.select("term", scoring.bm25_idf(F.lit(n), F.col("df")).alias("idf")), "term")
    average, k1, b = max(total / n, 1.0), scoring.K1, scoring.B

    def weight(tf: np.ndarray, length: np.ndarray) -> np.ndarray:  # the idf is the query's
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.maximum(length, 1) / average))

    own = F.col("idf") * scoring.query_weight(F.col("idf"), F.col("qtf"))
    kept, copies, firsts = _copies(blocks, k)
    x = blocks.select("block", "ids", F.transform("words", hashed).alias("keys"), "parts", "lengths", "sizes", "terms", "counts")
    x = x.join(F.broadcast(kept) if many * TEXTS <= MOST_BITS else kept, "block")  # a bit for each text
    if 2 * firsts < texts:  # what is left may lie in few pieces
        x = x.repartition(max(2 * docs.sparkSession.sparkContext.defaultParallelism, many // PIECE))
    return _ranked(x, words.select("query_id", hashed(F.col("term")).alias("key"), own.alias("own")), k, weight, copies if firsts < texts else None)


def _copies(blocks: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """block, kept: bits of the texts with the least id of all with their words; first, copies: the next ids after it, as many as k may need; the number of first ones."""
    x = blocks.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("pos", "x")).select("block", F.col("pos").cast("long").alias("pos"), F.col("x.ids").alias("evidence_id"), F.col("x.digests").alias("digest"))
    w = Window.partitionBy("digest").orderBy("evidence_id").rowsBetween(Window.unboundedPreceding, 0)
    x = _saved(x.withColumn("r", F.row_number().over(w)).withColumn("first", F.first("evidence_id").over(w)).where(F.col("r") <= k))
    kept = x.where("r = 1").groupBy("block").agg(F.bitmap_construct_agg("pos").substr(1, -(-TEXTS // 8)).alias("kept"))
    copies = x.where("r > 1").groupBy("first").agg(F.sort_array(F.collect_list("evidence_id")).alias("copies"))
    return _saved(kept), copies, x.where("r = 1").count()


def _counted_terms(words: DataFrame, asked: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """term, df of the words (term, n) that queries may ask for (term), and a hash that tells an asked term from all other words.

    A bitmap of the asked terms' hashes is broadcast, of 32 MiB at most, so no other words move but those that share a bit. A word that
    has an asked term's hash shares its bit; where two of the words that are left have one hash, another seed is taken.
    """
    terms = _saved(asked.select("term").distinct())
    m, many, seed = LEAST_BITS, terms.count(), 0
    while m < min(many * BITS, MOST_BITS):
        m *= 2
    while True:
        slot = F.pmod(F.xxhash64(F.lit(seed), "term"), F.lit(m))
        block = (slot / BLOCK_BITS).cast("long")
        bits = terms.select(slot.alias("s"), block.alias("__block")).groupBy("__block").agg(F.bitmap_construct_agg(F.pmod("s", F.lit(BLOCK_BITS))).alias("b"))
        eight = lambda i: F.conv(F.hex(F.col("b").substr(8 * i + 1, F.lit(8))), 16, -10).cast("long")
        bits = _saved(bits.select("__block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), eight).alias("__bits")))
        p = F.pmod(slot, F.lit(BLOCK_BITS)).cast("int")  # the first byte is the highest of its eight
        bit = F.getbit(F.get("__bits", F.shiftright(p, 6)), (F.lit(7) - F.shiftright(p, 3) % 8) * 8 + p % 8)
        near = words.withColumn("__block", block).join(F.broadcast(bits), "__block").where(bit == 1)
        df = _saved(near.groupBy("term").agg(F.sum("n").alias("df")))
        if not _meet(df, seed):
            return df, lambda term: F.xxhash64(F.lit(seed), term)
        seed += 1


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as blocks, made where the texts lie: a block's words are named once, and a text has their numbers and counts.

    block: its name; rows, total: texts and their words; digests: a hash of each text's words, for ``ids``; words, posts: the words of the block and the texts of each; ids: of texts with words;
    parts: the lengths of each text (several where ids repeat); sizes: the different words for each length; terms, counts: numbers and
    counts of the words. The last five are packed in as few bytes as they need, all low bytes first, so that high ones take next to
    nothing once compressed; terms are steps from number to number, as words of many texts have low numbers. Small inputs that come in fewer pieces than there are
    cores are dealt out first; only where ids repeat are texts grouped by them.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        pieces = min(cores, SPREAD, max(1, -(-docs.count() // FEW)))
        if docs.rdd.getNumPartitions() < pieces:
            docs = docs.repartition(pieces, "evidence_id")
    kind = dict(docs.dtypes)["evidence_id"]
    one = F.lit(1).cast("long")
    if docs.groupBy("evidence_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        w = docs.select("evidence_id", token_line(F.col("text")).alias("line")).withColumn("length", F.when(F.col("line") == "", 0).otherwise(F.size(F.split("line", " "))))
        w = w.groupBy("evidence_id", "length").agg(F.array_join(F.collect_list("line"), " ").alias("line"), F.count("*").alias("n"))
        w = w.groupBy("evidence_id").agg(F.collect_list(F.struct("line", "n")).alias("x"))
    else:
        w = docs.select("evidence_id", F.array(F.struct(F.coalesce("text", F.lit("")).alias("line"), one.alias("n"))).alias("x"))
    w = w.select("evidence_id", F.col("x.line").alias("lines"), F.col("x.n").alias("rows"))
    return w.mapInArrow(_packs(TEXTS, WORDS, SLICE), f"block binary, rows long, total long, ids array<{kind}>, digests array<binary>, words array<string>, posts array<long>, {_PACKED}")


#: How a block's postings are stored.
_PACKED = "parts binary, lengths binary, sizes binary, terms binary, counts binary"


def _packs(most: int, words: int, piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of ``most`` texts and about ``words`` words at most; nested whole, as executors needn't have this package.

    Words are found in the bytes of many texts at once, ``piece`` bytes or one text at least, as the pattern of tokens finds them.
    """
    kinds, lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)  # digits 1, what only goes on with a word 2, what starts one 3
    kinds[np.frombuffer(b"0123456789", np.uint8)] = 1
    kinds[np.frombuffer(b".:/-", np.uint8)] = 2
    kinds[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_", np.uint8)] = 3
    lower[65:91] += 32

    def found(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The tokens of the texts, and how many each has."""
        kind = kinds[data]
        known = kind > 0
        starts = known.copy()  # of runs of known bytes, each in one text
        starts[1:] &= ~known[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        starts[inner] = known[inner]
        at = np.arange(len(data), dtype=np.int32)
        word = known & (np.maximum.accumulate(np.where(kind == 3, at, -1)) >= np.maximum.accumulate(np.where(starts, at, 0)))
        number = (kind == 1) & ~word
        first = starts & (word | number)
        first[1:] |= (word[1:] & ~word[:-1]) | (number[1:] & ~number[:-1])
        token = word | number
        text = lower[data[token]]
        begin = np.append(np.flatnonzero(first[token]), len(text)).astype(np.int32)
        counts = np.diff(np.searchsorted(np.flatnonzero(first), offsets))
        return pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(text)), counts

    def tokens(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if not len(lines):
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        wide = pa.types.is_large_string(lines.type)
        offsets = np.frombuffer(lines.buffers()[1], np.int64 if wide else np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)
        out, a = [], 0
        while a < len(lines):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + piece, side="right")) - 1)
            out.append(found(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            a = b
        return pa.concat_arrays([x for x, _ in out]), np.concatenate([x for _, x in out])

    def digest(words: pa.Array, parts: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """A hash of each text's words in their order, and of its lengths: equal ones are equal texts."""
        begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        data, sizes = memoryview(words.buffers()[2] or b""), np.diff(begin)
        ends, lines = np.cumsum(tokens), np.cumsum(parts)
        out = []
        for a, b in zip((lines - parts).tolist(), lines.tolist(), strict=True):
            lo, hi = int(ends[a] - tokens[a]) if b > a else 0, int(ends[b - 1]) if b > a else 0
            h = hashlib.blake2b(sizes[lo:hi].tobytes(), digest_size=16)
            h.update(data[begin[lo] : begin[hi]])
            h.update(np.stack([tokens[a:b], lengths[a:b]]).astype(np.int64).tobytes())
            out.append(h.digest())
        return out

    def small(x: np.ndarray) -> bytes:
        width = np.min_scalar_type(int(x.max(initial=0))).itemsize
        return np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(len(x), width).T.tobytes()

    def steps(term: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each number less the one before it in its text; the first as it is."""
        first = np.zeros(len(term), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return np.where(first, term, term - np.concatenate([term[:1], term[:-1]]))

    def block(ids: pa.Array, lines: pa.Array, rows: pa.Array) -> pa.RecordBatch:
        parts = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
        words, counted = tokens(pc.list_flatten(lines))
        many = pc.list_flatten(rows).to_numpy()
        length = counted // many  # lines of one id and length are joined
        digests = digest(words, parts, counted, length)
        coded = words.dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        full = np.flatnonzero(length > 0)
        text = np.repeat(np.arange(len(parts)), parts)[full]  # of each length above 0
        width = max(1, len(names))
        often = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")
        place = np.empty(len(names), np.int64)
        place[often] = np.arange(len(names))
        names = names.take(pa.array(often))
        del words, coded
        at = np.repeat(np.arange(len(full)) * width, counted[full])
        at += place[codes]
        del codes
        at.sort()
        ends = np.append(np.flatnonzero(at[1:] != at[:-1]), len(at) - 1)[: len(at)]
        posts, counts = at[ends], np.diff(ends, prepend=-1)
        del at
        part, term = posts // width, posts % width
        kept, own = np.unique(text, return_counts=True)
        data = {
            "block": pa.array([uuid.uuid4().bytes], pa.binary()),
            "rows": pa.array([int(many.sum())], pa.int64()),
            "total": pa.array([int((length * many).sum())], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), ids.take(pa.array(kept))),
            "digests": pa.array([[digests[x] for x in kept.tolist()]], pa.list_(pa.binary())),
            "words": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
            "posts": pa.array([np.bincount(term, minlength=len(names))], pa.list_(pa.int64())),
        }
        sizes = np.bincount(part, minlength=len(full))
        packed = {"parts": own, "lengths": length[full], "sizes": sizes, "terms": steps(term, sizes), "counts": counts}
        return pa.RecordBatch.from_pydict(data | {c: pa.array([small(x)], pa.binary()) for c, x in packed.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in range(3)]
            flat = np.concatenate([[0], np.cumsum(pc.binary_length(pc.list_flatten(columns[1])).to_numpy())]) / 6
            seen = flat[np.concatenate([[0], np.cumsum(pc.list_value_length(columns[1]).to_numpy(zero_copy_only=False))])]  # words, about, before each text
            a = 0
            while a < batch.num_rows:
                b = min(batch.num_rows, a + most, max(a + 1, int(np.searchsorted(seen, seen[a] + words, side="right")) - 1))
                yield block(*[c.slice(a, b - a) for c in columns])
                a = b

    return run


def score(weighed: DataFrame, asked: DataFrame, k: int = 50) -> DataFrame:
    """The best k of each query: ``weighed`` postings (evidence_id, term, weight; stored) against its terms (query_id, term, qtf, idf)."""
    if asked.select("query_id").distinct().count() <= ONE_BY_ONE:
        return _by_floors(weighed, asked, k)
    wanted = _saved(asked.select("term").distinct())
    hashed = _apart(wanted)
    posts = weighed.join(F.broadcast(wanted) if _bounded(wanted) else wanted, "term", "left_semi")
    x = posts.groupBy("evidence_id").agg(F.collect_list(F.struct(hashed(F.col("term")).alias("key"), "weight")).alias("x"))
    kind = dict(weighed.dtypes)["evidence_id"]
    blocks = _saved(x.select("evidence_id", F.col("x.key").alias("keys"), F.col("x.weight").alias("weights")).mapInArrow(_weighed(TEXTS), f"ids array<{kind}>, keys array<long>, {_PACKED}"))
    own = scoring.query_weight(F.col("idf"), F.col("qtf"))
    return _ranked(blocks, asked.select("query_id", hashed(F.col("term")).alias("key"), own.alias("own")), k, None)


def _weighed(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of ``most`` texts with weights in place of counts; nested whole, as executors needn't have this package."""

    def small(x: np.ndarray) -> bytes:
        width = np.min_scalar_type(int(x.max(initial=0))).itemsize
        return np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(len(x), width).T.tobytes()

    def steps(term: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each number less the one before it in its text; the first as it is."""
        first = np.zeros(len(term), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return np.where(first, term, term - np.concatenate([term[:1], term[:-1]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                ids, keys, weights = (batch.column(c).slice(a, most) for c in range(3))
                names, term = np.unique(pc.list_flatten(keys).to_numpy(), return_inverse=True)
                sizes = pc.list_value_length(keys).to_numpy(zero_copy_only=False)
                ones = np.ones(len(sizes), np.int64)
                order = np.lexsort((term, np.repeat(np.arange(len(sizes)), sizes)))
                packed = [small(ones), small(ones), small(sizes), small(steps(term[order], sizes)), pc.list_flatten(weights).to_numpy().astype(float)[order].tobytes()]
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(pa.concat_arrays([ids])), one(pa.array(names, pa.int64())), *[pa.array([x], pa.binary()) for x in packed]], names=["ids", "keys", "parts", "lengths", "sizes", "terms", "counts"])

    return run


def _by_floors(weighed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ranking of a few queries, by joins with the postings that can change it.

    A query's rare terms find some texts, whose whole scores give a floor that the k-th best reaches at least. Common terms whose
    greatest weights together stay under it can't lift a text into the ranking alone; so only the other terms are joined to
    their postings, texts that can't reach the floor go, and the whole scores of those that are left are summed from their own.
    """
    most = weighed.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("posts"), F.max("weight").alias("top"))
    own = scoring.query_weight(F.col("idf"), F.col("qtf"))
    terms = _saved(asked.join(most, "term").select("query_id", "term", own.alias("own"), "posts", (F.col("top") * own).alias("most")))
    rare = Window.partitionBy("query_id").orderBy("posts", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = terms.withColumn("before", F.coalesce(F.sum("posts").over(rare), F.lit(0))).where(F.col("before") < SEEDS * k)
    seeded = top(_sums(weighed, seeds), "score", k)
    floors = _whole(weighed, terms, seeded).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - SLACK).otherwise(0.0).alias("floor"))
    common = Window.partitionBy("query_id").orderBy(F.desc("posts"), "term").rowsBetween(Window.unboundedPreceding, 0)
    split = terms.join(floors, "query_id", "left").fillna(0.0, ["floor"]).withColumn("lift", F.sum("most").over(common))
    split = _saved(split.withColumn("idle", F.col("lift") < F.col("floor")))
    rest = split.groupBy("query_id", "floor").agg(F.coalesce(F.max(F.when(F.col("idle"), F.col("lift"))), F.lit(0.0)).alias("rest"))
    able = _sums(weighed, split.where("not idle")).join(rest, "query_id").where("score + rest >= floor")
    return top(_whole(weighed, terms, able), "score", k)


def _sums(weighed: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, evidence_id, score over some terms of each query."""
    hits = weighed.join(terms.select("query_id", "term", "own"), "term")
    return hits.groupBy("query_id", "evidence_id").agg(F.sum(F.col("weight") * F.col("own")).alias("score"))


def _whole(weighed: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, evidence_id, score over all terms, of ``pairs`` of a query and a text."""
    hits = weighed.join(pairs.select("query_id", "evidence_id"), "evidence_id").join(terms.select("query_id", "term", "own"), ["query_id", "term"])
    return hits.groupBy("query_id", "evidence_id").agg(F.round(F.sum(F.col("weight") * F.col("own")), ROUND).alias("score")).where("score > 0")


def _apart(terms: DataFrame) -> Callable[[Column], Column]:
    """A hash of terms that tells all ``terms`` (each once) apart: the first seed under which no two of them meet."""
    seed = 0
    while _meet(terms, seed):
        seed += 1
    return lambda term: F.xxhash64(F.lit(seed), term)


def _meet(terms: DataFrame, seed: int) -> bool:
    """Whether two of the ``terms`` have one hash."""
    return terms.groupBy(F.xxhash64(F.lit(seed), "term")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def _ranked(blocks: DataFrame, words: DataFrame, k: int, weight: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, copies: DataFrame | None = None) -> DataFrame:
    """query_id, evidence_id, score, rank of stored blocks of texts (as ``_packed``, each id once) for words (query_id, key, own).

    Every block of queries meets every block of texts where that is read, so nothing is shuffled but the k best that a task keeps of
    each query; memory has a bound, and the number of pairs alone is the product of both sides. A block of queries goes to a task once,
    with the first of its texts. ``weight`` maps counts and lengths to weights; without it the counts are weights. Of a block that has
    ``kept`` only these texts are ranked, and ``copies`` (first, copies) come after their first.
    """
    each = words.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("key", "own"))).alias("x"))
    asked = _saved(each.groupBy("x").agg(F.min("query_id").alias("query_id"), F.collect_list(F.struct("query_id")).alias("all")))
    nq, same = asked.agg(F.count("*"), F.coalesce(F.max(F.size("all")), F.lit(0))).first()
    nq = max(1, -(-nq // QUERIES))
    part = F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")
    q = asked.groupBy(part.alias("qb")).agg(F.collect_list(F.struct("query_id", "x")).alias("x"))
    q = _saved(q.select("qb", F.col("x.query_id").alias("qids"), F.transform("x.x", F.size).alias("qsizes"), F.flatten("x.x").alias("x")).select("qb", "qids", "qsizes", F.col("x.key").alias("qkeys"), F.col("x.own").alias("own")))
    types = _element(blocks, "ids"), dict(words.dtypes)["query_id"]
    texts = blocks.select(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"), *([] if "kept" in blocks.columns else [F.lit(None).cast("binary").alias("kept")]), *[c for c in blocks.columns if c != "block"])
    pairs = q.hint("shuffle_replicate_nl").crossJoin(texts)  # each block of queries with all texts of the task in turn
    pairs = pairs.select("qb", *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("qids", "qsizes", "qkeys", "own")], *[c for c in texts.columns if c != "at"])
    best = pairs.mapInArrow(_product(k, weight, CELLS, DENSE, PAIRS, ROUND), f"query_id {types[1]}, evidence_id {types[0]}, score double")
    found = top(best, "score", k)
    if copies is not None:
        more = F.slice(F.coalesce("copies", F.array().cast(f"array<{types[0]}>")), F.lit(1), F.lit(k) - F.col("rank"))
        found = found.join(copies, F.col("evidence_id").eqNullSafe(F.col("first")), "left").select("query_id", F.explode(F.concat(F.array("evidence_id"), more)).alias("evidence_id"), "score")
        own = Window.partitionBy("query_id").orderBy(F.desc("score"), "evidence_id")
        found = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    if same > 1:
        of = asked.select(F.col("query_id").alias("__first"), "all")
        found = found.join(of, F.col("query_id").eqNullSafe(F.col("__first"))).select(F.explode("all").alias("all"), "evidence_id", "score", "rank").select("all.query_id", "evidence_id", "score", "rank")
    return found


def _element(rows: DataFrame, column: str) -> str:
    return dict(rows.dtypes)[column].removeprefix("array<").removesuffix(">")


def _product(k: int, weight: Callable | None, cells: int, most: int, pairs: int, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with its pairs of blocks of texts and of queries; nested whole, as executors needn't have this package."""

    unit = 10.0**-digits

    def wide(x: pa.Array, n: int) -> np.ndarray:
        """Whole numbers that were packed in as few bytes as they need, all low bytes first."""
        b = x[0].as_buffer()
        width = b.size // n if n else 1
        return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, n).T).view(f"<u{width}").reshape(n).astype(np.int64)

    def listed(x: pa.Array) -> np.ndarray:
        return pc.list_flatten(x).to_numpy(zero_copy_only=False)

    def scores(term, weights, text, n, q) -> np.ndarray:
        """Scores of ``n`` texts (rows) for all queries, from the texts' postings (term, weights, text; text by text)."""
        common = q.dense[term]
        hit = common >= 0
        wide = q.left.shape[0]
        s = np.bincount(text[hit] * wide + common[hit], weights[hit], minlength=wide * n).reshape(n, wide) @ q.left if wide else np.zeros((n, q.n))
        flat = s.reshape(-1)
        term, text, weights = term[~hit], text[~hit], weights[~hit]
        times = q.many[term]
        ends = np.cumsum(times)
        shift, base = q.start[term] - (ends - times), text * q.n
        a = 0
        while a < len(term):  # few postings at once, so that their texts' scores stay near
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + pairs, side="right")))
            row = np.repeat(shift[a:b], times[a:b])
            row += np.arange(done, ends[b - 1])
            cell = np.repeat(base[a:b] - base[a], times[a:b])
            cell += q.by.take(row, mode="clip")
            lift = np.repeat(weights[a:b], times[a:b])
            lift *= q.own.take(row, mode="clip")
            lo, hi = base[a], base[b - 1] + q.n
            flat[lo:hi] += np.bincount(cell, lift, minlength=hi - lo)
            a = b
        return s

    class Queries:
        """A block of queries: their terms, those of many queries as a matrix."""

        def __init__(self, sizes, keys, owns):
            self.n = len(sizes)
            self.vocabulary, term, self.many = np.unique(keys, return_inverse=True, return_counts=True)
            of = np.repeat(np.arange(self.n), sizes)
            self.dense = np.full(len(self.vocabulary), -1)
            often = np.argsort(-self.many, kind="stable")[:most]
            often = often[self.many[often] > max(8, self.n // 20)]
            self.dense[often] = np.arange(len(often))
            self.left = np.zeros((len(often), self.n))
            hit = self.dense[term] >= 0
            self.left[self.dense[term[hit]], of[hit]] = owns[hit]
            of, term, owns = of[~hit], term[~hit], owns[~hit]  # all others are found by their term
            order = np.argsort(term, kind="stable")
            self.by, self.own, self.many = of[order], owns[order], np.bincount(term, minlength=len(self.vocabulary))
            self.start = np.cumsum(self.many) - self.many

    class Best:
        """The k best of each query of a block among the texts so far, ties by id, and the scores to reach from now on."""

        def __init__(self, qids):
            self.qids, self.ids, self.found, self.held = qids, None, ([], [], []), 0  # found: query, text, score
            self.floor = np.full(len(qids), 0.5 * unit)

        def cut(self) -> None:
            i, j, s = (np.concatenate(x) for x in self.found)
            used, j = np.unique(j, return_inverse=True)
            self.ids = self.ids.take(pa.array(used))
            place = np.empty(len(used), np.int64)
            place[pc.array_sort_indices(self.ids, order="ascending").to_numpy()] = np.arange(len(used))
            place[pc.is_null(self.ids).to_numpy(zero_copy_only=False)] = -1  # nulls first
            order = np.lexsort((place[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            self.floor[i[rank == k - 1]] = s[rank == k - 1]
            keep = rank < k
            self.found, self.held = ([i[keep]], [j[keep]], [s[keep]]), int(keep.sum())

        def add(self, ids: pa.Array, s_of: Iterator[tuple[int, np.ndarray]]) -> None:
            """Takes scores of the texts ``ids``: the place of the first and a row for each text, not rounded."""
            base = self.join(ids)
            for a, s in s_of:
                n = len(s)
                sel = s >= np.maximum(self.floor - 0.6 * unit, 0.4 * unit)
                if n > k and np.count_nonzero(sel) > 2 * len(self.floor) * k:
                    sel &= s >= np.partition(s, n - k, axis=0)[n - k] - 1.1 * unit
                j, i = np.nonzero(sel)
                s = np.round(s[j, i], digits)
                over = s >= self.floor[i]
                for have, new in zip(self.found, (i[over], base + a + j[over], s[over]), strict=True):
                    have.append(new)
                self.held += int(over.sum())
                if self.held > 4 * len(self.floor) * k:
                    self.cut()
                    base = self.join(ids)

        def join(self, ids: pa.Array) -> int:
            base = len(self.ids) if self.ids is not None else 0
            self.ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
            return base

    def pieces(q: Queries, row: pa.RecordBatch) -> tuple[pa.Array, Iterator[tuple[int, np.ndarray]]]:
        """The ids of the block's texts and their scores, some texts at a time, with the first text of each piece."""
        ids = pc.list_flatten(row["ids"])
        n = len(ids)
        parts = wide(row["parts"], n)
        of = np.repeat(np.arange(n), parts)  # the text of each length
        length, sizes = wide(row["lengths"], len(of)), wide(row["sizes"], len(of))
        local = np.cumsum(wide(row["terms"], int(sizes.sum())))
        local -= np.repeat(np.concatenate([[0], local])[np.cumsum(sizes) - sizes], sizes)  # steps of the text alone
        keys = listed(row["keys"])
        at = np.minimum(np.searchsorted(q.vocabulary, keys), len(q.vocabulary) - 1)
        known, text = (q.vocabulary[at] == keys)[local], np.repeat(of, sizes)
        if row["kept"][0].is_valid:
            kept = np.unpackbits(np.frombuffer(row["kept"][0].as_buffer(), np.uint8), count=n, bitorder="little").astype(bool)
            known &= kept[text]
            ids, text, n = ids.filter(pa.array(kept)), (np.cumsum(kept) - 1)[text], int(kept.sum())
        counts = np.frombuffer(row["counts"][0].as_buffer(), float)[known] if weight is None else wide(row["counts"], len(local))[known]
        weights = counts if weight is None else weight(counts, np.repeat(length, sizes)[known])
        term, text = at[local[known]], text[known]
        step = max(16, cells // q.n)
        ends = np.searchsorted(text, np.arange(0, n + step, step))
        return ids, ((a, scores(term[lo:hi], weights[lo:hi], text[lo:hi] - a, min(step, n - a), q)) for a, lo, hi in zip(range(0, n, step), ends, ends[1:], strict=False))

    def told(best: Best | None) -> Iterator[pa.RecordBatch]:
        if best is not None and best.ids is not None:
            best.cut()
            i, j, s = (x[0] for x in best.found)
            yield pa.RecordBatch.from_arrays([best.qids.take(pa.array(i)), best.ids.take(pa.array(j)), pa.array(s, pa.float64())], names=["query_id", "evidence_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, q = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                if row["qids"][0].is_valid:  # the next block of queries
                    yield from told(best)
                    best = q = None
                    q = Queries(listed(row["qsizes"]), listed(row["qkeys"]), listed(row["own"]))
                    best = Best(pa.concat_arrays([pc.list_flatten(row["qids"])]))
                if q.n and len(q.vocabulary) and len(row["ids"][0]):
                    best.add(*pieces(q, row))
        yield from told(best)

    return run


def vocabulary(terms: DataFrame) -> DataFrame:
    """term, term_id: dense ids in the order of terms.

    Ranges of terms are numbered apart and shifted by the sizes of the ranges before, so that no task gets all terms.
    """
    ranged = _saved(terms.select("term").distinct().repartitionByRange("term").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
    return ranged.withColumn("own", own).join(F.broadcast(before.select("part", "base")), "part").select("term", (F.col("own") + F.col("base")).alias("term_id"))


def sparse(docs: DataFrame) -> DataFrame:
    """evidence_id, indices, values: each document's weights as arrays in the order of term ids.

    Terms get their ids before they meet the postings, so that these are joined once and shuffled by document once.
    """
    own, terms, stats = _indexed(docs)
    numbered = _saved(terms.join(vocabulary(terms), "term"))
    w = scoring.bm25_weight(F.col("idf"), F.col("tf"), F.col("length"), F.col("avgdl"))
    x = _by_term(own, numbered).crossJoin(F.broadcast(stats)).select("evidence_id", F.struct("term_id", w.alias("weight")).alias("x"))
    x = x.groupBy("evidence_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return x.select("evidence_id", F.col("x.term_id").alias("indices"), F.col("x.weight").alias("values"))


def top(hits: DataFrame, score: str, k: int, rank: str = "rank") -> DataFrame:
    """The best k of each query; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "evidence_id")
    return hits.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _bounded(queries: DataFrame, most: int = 8 << 20) -> bool:
    """The optimizer's size of the queries is under ``most`` bytes, so what comes of them can be broadcast."""
    return int(str(queries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most
