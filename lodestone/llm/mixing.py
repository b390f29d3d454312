"""Mixing documents to target weights of soft domains.

A classifier is fitted on the rows that the labelled table names: naive Bayes over a few binned measures of the text,
one of them hits of a lexicon learned from the same rows. It gives each document a posterior over the domains
``high``, ``low`` and ``toxic``. Projected gradient descent then fits a nonnegative rate for each document, so that
the expected tokens of each domain, summed over rates and posteriors, match the target weights in least squares (each
domain's error weighted by the inverse of its share at rate one), with a small pull to rate one. Documents with equal bins have equal posteriors, hence equal rates at every step; so a step
is one aggregation over the table of bins (144 rows at most) that the documents were counted into.

Everything is DataFrame operations. Null texts count as empty, with no tokens. Null ids get the draw of zero. Labelled rows
without a document, and null labels, are ignored; without any labels the posterior is uniform. Repeated rows are separate
documents with one rate. Extra columns stay as they are, whatever their names, and columns that the result adds have
underscores behind theirs where these are taken. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import WORD, packed, stage, unpacked

DOMAINS = ("high", "low", "toxic")
#: Share of the tokens that each domain is to have.
TARGETS = {"high": 0.92, "low": 0.06, "toxic": 0.02}
#: At most so many labelled rows are fitted on (by hash of the id), and so many words are kept in the lexicon.
SAMPLE, LEXICON = 200_000, 200
PULL, STEP, ROUNDS, EXACT = 0.002, 0.9, 30, 1e-4
_BINS = ["b_symbols", "b_upper", "b_unique", "b_hits"]
_ONLY = ["doc_id", "text"]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}]+"), F.lit(0))


def _bin(x: Column, edges: list[float]) -> Column:
    return sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0))


def features(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """``docs`` with its tokens (words) and bins."""
    text = F.coalesce("text", F.lit(""))
    n = F.regexp_count(text, F.lit(WORD)).cast("long")
    per_word = lambda x: x / F.greatest(n, F.lit(1))
    less = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    out = docs.withColumn("__w", _words(F.col("text"))).withColumn("__u", F.array_distinct("__w")).withColumn("tokens", n)
    out = out.withColumn("b_symbols", _bin(per_word(less("#*$%&|<>")), [0.1, 0.5])).withColumn("b_upper", _bin(per_word(less("ABCDEFGHIJKLMNOPQRSTUVWXYZ")), [0.5, 2.0]))
    out = out.withColumn("b_unique", _bin(F.size("__u") / F.greatest(F.size("__w"), F.lit(1)), [0.15, 0.3, 0.45]))
    hits = F.size(F.array_intersect(F.col("__u"), F.array(*map(F.lit, lexicon)))) if lexicon else F.lit(0)
    return out.withColumn("b_hits", _bin(hits, [0, 1, 3])).drop("__w", "__u")


def _labelled(labels: DataFrame, sample: int) -> DataFrame:
    """doc_id and domain of at most ``sample`` labelled rows, a few MB that are broadcast so that texts don't move; stored."""
    of = labels.where("toxic is not null and quality is not null").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("high").alias("domain"))
    return stage(of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> list[str]:
    """Words that toxic rows have and hardly any others, by smoothed log-odds; at most ``size``."""
    n = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # one row for each domain
    t, o = n.get("toxic", 0), sum(n.values()) - n.get("toxic", 0)
    if not t or not o:
        return []
    words = rows.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    odds = words.groupBy("word").agg(F.count_if(F.col("domain") == "toxic").alias("t"), F.count_if(F.col("domain") != "toxic").alias("o"))
    ratio = F.log((F.col("t") + 0.5) / (t + 1)) - F.log((F.col("o") + 0.5) / (o + 1))
    best = odds.where(f"t >= {max(3, t // 100)}").select("word", ratio.alias("ratio")).where("ratio > 2.5").orderBy(F.desc("ratio"), "word").limit(size)
    return sorted(r["word"] for r in best.collect())


@dataclass(frozen=True)
class Classifier:
    """Log-probabilities: of each domain, and of each bin value in each domain."""

    lexicon: tuple[str, ...]
    prior: dict
    tables: dict

    def posteriors(self) -> Column:
        """Array of probabilities, in the order of ``DOMAINS``."""
        logs = []
        for d in DOMAINS:
            x = F.lit(self.prior[d])
            for b in _BINS:
                v = F.lit(self.tables[b, d, None])
                for value in range(4):
                    v = F.when(F.col(b) == value, F.lit(self.tables[b, d, value])).otherwise(v)
                x = x + v
            logs.append(x)
        logs = F.array(*logs)
        most = F.array_max(logs)
        weights = F.transform(logs, lambda x: F.exp(x - most))
        total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
        return F.transform(weights, lambda x: x / total)


def fit(measured: DataFrame, labelled: DataFrame, lexicon: list[str]) -> Classifier:
    """Naive Bayes with add-one smoothing on the rows of ``measured`` (doc_id and bins) that are ``labelled`` (doc_id, domain)."""
    import math

    counted = measured.select("doc_id", *_BINS).join(F.broadcast(labelled), "doc_id").groupBy("domain", *_BINS).count().collect()  # domains times bins: under 500 rows
    n = dict.fromkeys(DOMAINS, 0)
    seen: dict = {}
    for r in counted:
        n[r["domain"]] += r["count"]
        for b in _BINS:
            k = (b, r["domain"], r[b])
            seen[k] = seen.get(k, 0) + r["count"]
    total = sum(n.values())
    prior = {d: math.log((n[d] + 1) / (total + len(DOMAINS))) for d in DOMAINS}
    tables = {(b, d, v): math.log((seen.get((b, d, v), 0) + 1) / (n[d] + 4)) for b in _BINS for d in DOMAINS for v in (0, 1, 2, 3, None)}
    return Classifier(tuple(lexicon), prior, tables)


def fit_rates(cells: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``cells`` (p: posteriors, tokens; a row for each kind of document) with the fitted rate of each; staged.

    A round sums the expected tokens of each domain and moves all rates against the gradient; it is written, so plans stay short.
    """
    cells = stage(cells.withColumn("rate", F.lit(1.0)))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells
    want = [targets[d] / sum(targets.values()) for d in DOMAINS]
    last = at_one = None
    for _ in range(ROUNDS):
        sums = cells.agg(*[F.sum(F.col("tokens") / float(total) * F.col("p")[k] * F.col("rate")).alias(d) for k, d in enumerate(DOMAINS)]).first()
        at_one = at_one or [max(x, 1e-6) for x in sums]
        error = [(sums[k] - want[k]) / at_one[k] for k in range(len(DOMAINS))]
        if last and max(abs(a - b) for a, b in zip(error, last, strict=True)) < EXACT:
            break
        last = error
        slope = sum((F.col("p")[k] * F.lit(e) for k, e in enumerate(error)), F.lit(0.0))
        cells = stage(cells.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") * (1 - STEP * PULL) + STEP * PULL - STEP * slope)))
    return cells


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE, thin: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with p (posteriors), tokens, rate and copies: how often the document is to be used.

    ``copies`` rounds the rate up or down by a hash of the id, right in expectation. ``thin`` divides the rates by the least
    rate of documents that are likeliest ``high`` and cuts them at one: shares stay near the targets, no document
    is used twice, and none of these goes. Measured rows are written once, without the columns to ``drop``.
    """
    columns = [c for c in docs.columns if c not in drop]
    labelled = _labelled(labels, sample)
    lexicon = learn_lexicon(stage(docs.select(*_ONLY).join(F.broadcast(labelled), "doc_id").select("domain", "text")))
    out = stage(features(packed(docs), lexicon).drop(*drop))
    out = out.withColumn("p", fit(out, labelled, lexicon).posteriors())
    cells = out.groupBy(*_BINS).agg(F.first("p").alias("p"), F.sum("tokens").alias("tokens")).coalesce(1)
    cells = fit_rates(cells, targets)
    rate = F.col("rate")
    if thin:
        ok = F.col("p")[0] == F.array_max("p")
        least = cells.where(ok).agg(F.min(rate)).first()[0]
        rate = F.least(F.lit(1.0), F.when(ok, F.lit(1.0)).otherwise(rate / F.lit(least or 1.0)))
    known = cells.select(*_BINS, rate.alias("rate"))  # a row for each combination of bins: 144 at most
    out = out.join(F.broadcast(known), _BINS)
    draw = F.coalesce(F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30), F.lit(0.0))
    return unpacked(out, columns, {"p": F.col("p"), "tokens": F.col("tokens"), "rate": F.col("rate"), "copies": F.floor(F.col("rate") + draw).cast("int")})


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Posteriors, rate and number of uses of each of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs.select(*_ONLY), spark.read.parquet(f"{sf_dir}/labels.parquet"), drop=("text",))
    return out.select("doc_id", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")
