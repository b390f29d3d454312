"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Words are lower-cased, stripped of punctuation and written as fixed-width codes, so that matches are of whole words and
not of syllables. Two dictionaries are trained with zstandard, one on the windows of toxic labelled texts, the other on
those of ordinary ones. Before that, windows are cut to the words that a class has in ``LEAST`` documents or more and
``ODDS`` times as often as the other, as what both share would fill either dictionary alike and tell nothing; of the odds
listed, those count whose dictionaries tell the calibration texts apart best. Each window of
a text, with a run of zeros behind it so that its block is always worth compressing, is then compressed by both; the
bytes that the toxic one saves are its gap. A text's score is a logistic function of how many windows reach the
calibrated gap, of their share, the largest and the mean gap. Dictionaries are made of three quarters of the training
texts; the gap and the curve are calibrated on the others, by a hash of the text, as texts that a dictionary was
trained on compress better by it than new ones. Where the others lack a class, all texts serve for both.

Labels are learned from rows whose crc32 of the id, as text, leaves a remainder mod 5; at most ``TOXIC`` and
``ORDINARY`` of them, by hash. Of rows with one id the least text is learned from, once, with the highest label. Labels,
language, source and id never enter a score. Null and empty texts have no window and get the score of none. Without toxic
or ordinary training rows every score is the base rate, or zero. Whole texts are scored, in any length; repeated rows
score alike, other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOXIC, ORDINARY = 3000, 5000
CODE, WINDOW, STEP = 8, 8, 8
SIZE, LEAST, ODDS = 1 << 13, 4, (8.0, 1.5)
#: Behind each window: its match pays for the block's tables, so that what else a dictionary saves shows byte by byte.
RUN = bytes(32)
_CACHED = 300_000
_APART = str.maketrans({c: " " for c in "0123456789!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\n\t\r\x0b\x0c"})


class Coder(dict):
    """Codes of words: eight bytes of a hash."""

    def __missing__(self, word: str) -> bytes:
        from xxhash import xxh64_digest

        if len(self) >= _CACHED:
            self.clear()
        code = self[word] = xxh64_digest(word.encode())
        return code

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").lower().translate(_APART).split()))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(3, min_match=5, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def _train(windows: list[bytes], size: int = SIZE) -> bytes:
    """A trained dictionary; where the samples are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, windows, k=2 * CODE, d=CODE).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-size:] or bytes(CODE)


def _words(codes: bytes) -> list[bytes]:
    return [codes[k : k + CODE] for k in range(0, len(codes), CODE)]


def _windows(codes: bytes) -> list[bytes]:
    return [codes[k : k + WINDOW * CODE] for k in range(0, len(codes), STEP * CODE)]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    gap: int
    weights: tuple[float, ...]

    def tools(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return _compressor(self.ordinary), _compressor(self.toxic)

    def gaps(self, coder: Coder, tools, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window of the text."""
        a, b = tools
        return np.array([len(a.compress(w + RUN)) - len(b.compress(w + RUN)) for w in _windows(coder.encode(text))], dtype=np.int64)

    def score(self, gaps: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(_features(gaps, self.gap) @ np.array(self.weights), -30, 30))))


def _features(gaps: np.ndarray, gap: int) -> np.ndarray:
    n, hits = max(1, len(gaps)), int((gaps >= gap).sum())
    return np.array([1.0, np.log1p(n) / 5, min(hits, 1), np.log1p(hits), 10 * hits / n, min(int(gaps.max(initial=0)), 4 * gap) / gap, float(gaps.sum()) / n / 4])


def _logistic(x: np.ndarray, y: np.ndarray, pull: float = 0.01) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * len(y) ** 0.5 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - pull * len(y) ** 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _residues(codes: list[bytes], y: np.ndarray, odds: float) -> tuple[list[bytes], list[bytes]]:
    """Distinct windows of the ordinary and of the toxic texts, cut to the words that tell their class."""
    found, n = (Counter(), Counter()), [max(1, int((y == kind).sum())) for kind in (0, 1)]
    for c, label in zip(codes, y, strict=True):
        found[int(label)].update(set(_words(c)))
    out: tuple[dict, dict] = ({}, {})
    for c, label in zip(codes, y, strict=True):
        own, other, kind = found[int(label)], found[1 - int(label)], int(label)
        for w in _windows(c):
            left = b"".join(x for x in _words(w) if own[x] >= LEAST and own[x] * (n[1 - kind] + 1) > odds * (other[x] + 0.5) * n[kind])
            if left:
                out[kind][left] = None
    return list(out[0]), list(out[1])


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """A model of labelled texts."""
    coder, y = Coder(), np.array(labels, dtype=np.int64)
    codes = [coder.encode(t) for t in texts]
    rate = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -30.0
    if not 0 < y.sum() < len(y):
        return Model(bytes(CODE), bytes(CODE), 1, (rate,) + (0.0,) * 6)
    apart = np.array([zlib.crc32((t or "").encode()) % 4 == 0 for t in texts])
    if not all(0 < y[k].sum() < k.sum() for k in (apart, ~apart)):
        made = judged = np.arange(len(y))
    else:
        made, judged = np.flatnonzero(~apart), np.flatnonzero(apart)
    found = []
    for odds in ODDS:
        model = Model(*map(_train, _residues([codes[k] for k in made], y[made], odds)), 1, ())
        tools, told = model.tools(), y[judged]
        gaps = [model.gaps(coder, tools, texts[k]) for k in judged]
        top = np.array([g.max(initial=0) for g in gaps])
        # the threshold that tells the texts apart best, by their largest gap
        gap = max(range(2, 4 * CODE), key=lambda k: (top >= k)[told == 1].mean() - (top >= k)[told == 0].mean())
        x = np.array([_features(g, gap) for g in gaps])
        w = _logistic(x, told.astype(float))
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        loss = -np.log(np.where(told == 1, p, 1 - p)).mean()
        found.append((loss, Model(model.ordinary, model.toxic, gap, tuple(w.tolist()))))
    return min(found, key=lambda f: f[0])[1]


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> tuple[list, list]:
    """Texts and labels to learn from: a bounded number of rows that aren't held out."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    own = own.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxic).union(own.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ordinary))
    rows = docs.select("doc_id", "text").join(own, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_windows, n_hits of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tools = Coder(), model.tools()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                gaps = [model.gaps(coder, tools, x.as_py()) for x in part.column(1)]
                s = [model.score(g) for g in gaps]
                cols = [part.column(0), pa.array(s), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array([len(g) for g in gaps], pa.int64()), pa.array([int((g >= model.gap).sum()) for g in gaps], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted", "n_windows", "n_hits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, n_windows long, n_hits long")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(*training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
