"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers in whole texts: leftmost, without overlap
in a kind, checked by value. They are seed entities, and so are tokens that look like secrets (``SECRET``). Every other
token with a digit, of ``SHORTEST`` to ``LONGEST`` code points and apart from base spans, is an instance too. Lexical patterns are
induced from what stands around an instance in the whole text, and from its shape (letters, digits, marks): the two words before
it, the word before it with the shape, the shape with the word behind it, and the shape alone (not of secrets, as their look made
them seeds). On the bipartite graph of patterns and instance values confidence goes back and forth: a pattern has the mean
confidence of its distinct values, with one more unconfirmed; values that are no seeds count by half, and not at all for a
shape alone, as what they have comes from patterns like it; a value that is no seed the chance that not all of its
patterns with ``SUPPORT`` seeds are wrong. It ends when the patterns' mean moves by less than ``STILL`` and as many are
trusted as before, or after ``ROUNDS``. Patterns with enough seeds and confidence then give the values in their place as
identifiers, kind ``id``; base spans stay. A secret is given only where a trusted pattern has it.

Everything is DataFrame operations; one scan reads the texts, and what moves is instances. Work is linear in a text's
length. Null texts count as empty. Any number of rows may share an id, or have none; other columns are ignored. Positions are in
code points. Repeated rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm._common import attach, stage, touched

KINDS = ("email", "ip", "card", "phone")
#: Loops are possessive where nothing that follows can match in them, and a match starts where a run does (or the last match
#: ended), so that every run is read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the pattern to be worth a look.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "token": "[0-9]"}
#: A word with a digit.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Digests and keys by their look: hexadecimal of the usual lengths with letters and digits, and known prefixes.
SECRET = r"^(?:(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})|(?:sk-|ghp_|AKIA)[A-Za-z0-9_-]{16,})$"
ROUNDS, STILL, SUPPORT, SURE = 8, 1e-3, 3, 0.7
SHORTEST, LONGEST = 5, 256
_BLOCK = 1024
_FOUND = "array<struct<start:int,end:int,x:string,left:string,right:string>>"


def _last_words(s: Column) -> Column:
    """The end of ``s``: two words, with what parts them from the rest."""
    return F.reverse(F.regexp_extract(F.reverse(s), r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){0,2}+[\x20\x09-\x0D]?", 0))


def _matches(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``rows`` (with a column text) with, for each pattern, an array of start, end, x, left and right of its matches.

    Left are the last two words before, right is the next behind. Each step is a projection of its own, so that
    arrays are made once and not again for every element; positions add up in blocks, not along the whole array.
    """
    keep = rows.columns
    own = lambda k: F.col("text").rlike(HINTS[k])
    none = F.array().cast("array<string>")
    found = [F.when(own(k), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"f_{k}") for k, p in patterns.items()]
    gaps = [F.when(own(k), F.split("text", p, -1)).otherwise(none).alias(f"g_{k}") for k, p in patterns.items()]
    rows = rows.select(*keep, *found, *gaps)

    def told(k: str) -> Column:
        f, g = F.col(f"f_{k}"), F.col(f"g_{k}")
        at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

        def one(x: Column, i: Column) -> Column:
            left = F.concat(at(f, i - 2), _last_words(at(g, i - 1)), at(f, i - 1), _last_words(F.get(g, i)))
            right = F.regexp_extract(F.concat(F.get(g, i + 1), at(f, i + 1)), r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]*+)", 1)
            return F.struct(x.alias("x"), F.length(F.get(g, i)).alias("g"), F.length(x).alias("n"), _last_words(left).alias("left"), right.alias("right"))

        return F.transform(f, one).alias(f"t_{k}")

    rows = rows.select(*keep, *[told(k) for k in patterns])

    def blocks(k: str) -> Column:
        t = F.col(f"t_{k}")
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, v: F.struct((acc["at"] + v["g"] + v["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v["g"])).alias("out"))
        each = F.transform(F.sequence(F.lit(0), ((F.size(t) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(t, b * _BLOCK + 1, F.lit(_BLOCK)), first, step))
        return F.when(F.size(t) > 0, each).otherwise(F.array().cast("array<struct<at:int,out:array<int>>>")).alias(f"b_{k}")

    rows = rows.select(*keep, *[f"t_{k}" for k in patterns], *[blocks(k) for k in patterns])
    before = lambda k: F.aggregate(f"b_{k}", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"]))).alias(f"o_{k}")
    rows = rows.select(*keep, *[f"t_{k}" for k in patterns], *[f"b_{k}" for k in patterns], *[before(k) for k in patterns])

    def placed(k: str) -> Column:
        starts = F.flatten(F.zip_with(f"b_{k}", F.slice(f"o_{k}", F.lit(1), F.size(f"b_{k}")), lambda b, o: F.transform(b["out"], lambda s: s + o)))
        return F.zip_with(f"t_{k}", starts, lambda v, s: F.struct(s.alias("start"), (s + v["n"]).alias("end"), v["x"].alias("x"), v["left"].alias("left"), v["right"].alias("right"))).cast(_FOUND).alias(k)

    return rows.select(*keep, *[placed(k) for k in patterns])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))
    value = lambda k: F.substring(d, k, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, k: acc + F.when(k % 2 == 0, twice(value(k))).otherwise(value(k)))
    return F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        # longer parts are over 255 unless zeros lead
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(x, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.left(part(p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _told(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def _plain(words: Column) -> Column:
    """Words in lower case, with one space between and 0 for numbers."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(words, r"[\x20\x09-\x0D]+", " "))), "[0-9]+", "0"), r"^[^\p{L}\p{N}=:#]+(?=[\p{L}\p{N}])", "")


def shape(value: Column) -> Column:
    """Digits as 9, runs of letters as a, hexadecimal of 16 and more by its length; marks as they are."""
    hexed = value.rlike(r"^(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{16,}$")
    plain = F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{L}+", "a")
    return F.when(hexed, F.concat(F.lit("hex"), F.length(value).cast("string"))).otherwise(plain)


def instances(rows: DataFrame) -> DataFrame:
    """A row for each valid base span, and each token with a digit apart from these: rid, start, end, value, base, seed, patterns."""
    t = rows.select("rid", F.explode("token").alias("s"))
    lead = F.length(F.regexp_extract("s.x", r"^[^\p{L}\p{N}+]*+", 0))
    core = F.regexp_replace("s.x", r"^[^\p{L}\p{N}+]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    start = (F.col("s.start") + lead).cast("int")
    t = t.select("rid", start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"), "s.left", "s.right", F.lit(False).alias("base"))
    b = rows.select("rid", F.explode(F.concat(*KINDS)).alias("s")).select("rid", "s.start", "s.end", F.col("s.x").alias("value"), "s.left", "s.right", F.lit(True).alias("base"))
    x = t.where(F.length("value").between(SHORTEST, LONGEST)).unionByName(b)
    by = Window.partitionBy("rid").orderBy("start", F.desc("base"), "end")
    past = F.max(F.when(F.col("base"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("rid").orderBy(F.desc("start"), "base", F.desc("end"))  # frames that grow cost one pass
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("past", F.coalesce(past, F.lit(0))).withColumn("ahead", F.coalesce(ahead, F.col("end")))
    x = x.where("base or (past <= start and ahead >= end)").where(F.length("value").between(SHORTEST, LONGEST)).drop("past", "ahead")
    secret = ~F.col("base") & F.col("value").rlike(SECRET)
    two, behind = _plain(F.col("left")), _plain(F.col("right"))
    x = x.withColumn("two", two).withColumn("one", F.substring_index(two, " ", -1)).withColumn("behind", behind).withColumn("shape", shape(F.col("value"))).withColumn("secret", secret)
    told = lambda ok, *parts: F.when(ok, F.concat(*parts))
    bar, one = F.lit("|"), F.col("one") != ""
    patterns = F.array_compact(F.array(
        told(F.col("two").contains(" "), F.lit("l2:"), "two"),
        told(one, F.lit("l1:"), "one", bar, "shape"),
        told(F.col("behind") != "", F.lit("r1:"), "shape", bar, "behind"),
        told(~F.col("secret"), F.lit("s:"), "shape"),
    ))
    return x.select("rid", "start", "end", "value", "base", (F.col("base") | F.col("secret")).alias("seed"), patterns.alias("patterns"))


def score(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE) -> tuple[DataFrame, DataFrame]:
    """Patterns that are trusted (pattern, conf, m: distinct values) and the confidence of values (value, conf)."""
    edges = stage(found.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    # a value counts once for each pattern, and its seeds are those of any place
    values = stage(edges.groupBy("value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"), F.when(F.max("seed"), 1.0).otherwise(0.0).alias("conf")))
    total = edges.count()
    trust = (F.col("seeds") >= support) & (F.col("p") >= sure)
    part = F.when(F.col("seed"), 1.0).when(F.col("pattern").startswith("s:"), 0.0).otherwise(F.col("conf") / 2)
    patterns = last = None
    for _ in range(rounds):
        rated = attach(edges.select("pattern", "value"), values.select("value", "n", "conf", "seed"), "value", "n", total)
        patterns = stage(rated.groupBy("pattern").agg((F.sum(part) / (F.count("*") + 1)).alias("p"), F.count_if("seed").alias("seeds"), F.count("*").alias("m")))
        known = patterns.withColumn("p", F.when(F.col("seeds") >= support, F.col("p")).otherwise(0.0))
        back = attach(edges.select("pattern", "value", "seed"), known.select("pattern", "p", "m"), "pattern", "m", total)
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))
        values = stage(back.groupBy("value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"), F.when(F.max("seed"), 1.0).otherwise(1 - wrong).alias("conf")))
        now = patterns.agg(F.coalesce(F.avg("p"), F.lit(0.0)), F.count_if(trust)).first()
        if last and now[1] == last[1] and abs(now[0] - last[0]) < STILL:
            break
        last = now
    return patterns.where(trust).select("pattern", F.col("p").alias("conf"), "m"), values.select("value", "conf")


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """One row per row of ``docs``: doc_id, the valid spans of each kind, and ``id``: spans that patterns discovered."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = _matches(rows, {**PATTERNS, "token": TOKEN}).drop("text")
    for kind in KINDS:
        rows = rows.withColumn(kind, F.filter(kind, (lambda k: lambda s: _valid(k, s["x"]))(kind)))
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()))
    found = stage(instances(rows))
    trusted, values = score(found, rounds, support, sure)
    open_ = found.where("not base")
    counts = stage(open_.groupBy("value").agg(F.count("*").alias("c")).join(values.where(F.col("conf") >= sure).select("value"), "value"))
    new = attach(open_.select("rid", "start", "end", "value", F.explode("patterns").alias("pattern")), stage(trusted.select("pattern", "m")), "pattern", "m", open_.count())
    new = attach(new.select("rid", "start", "end", "value").distinct(), counts, "value", "c", open_.count())
    ids = stage(new.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("id")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = touched(rows.drop("token"), ids.select("rid"), "rid")
    near = out.where("__maybe").drop("__maybe").join(ids.hint("merge"), "rid", "left")
    out = near.unionByName(out.where("not __maybe").drop("__maybe").withColumn("id", none)).drop("rid")
    return out.withColumn("id", F.coalesce("id", none))


def op2_contextual_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_join(F.concat(*[_told(k, F.col(k)) for k in KINDS]), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    spans = F.array_join(F.concat(*[_told(k, F.col(k)) for k in (*KINDS, "id")]), ",")
    whole = sum((F.size(k) for k in (*KINDS, "id")), F.lit(0)).cast("long").alias("n_spans")
    return out.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.size("id").cast("long").alias("n_id"), whole)
