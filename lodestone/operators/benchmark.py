"""Building and judging a query benchmark: packets, pools, validation, deduplication, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text
from lodestone.operators.lexical import top
from lodestone.operators.partition import _saved

PACKET, ITEM, CONTEXT = 24_000, 6_000, 40_000


def packet(rows: DataFrame, by: str, order: list[Column], budget: int = PACKET, item: int = ITEM) -> DataFrame:
    """Items of each group under a budget of characters; the item that crosses it is cut."""
    rows = rows.where(F.col("text") != "").withColumn("__n", F.least(F.length("text"), F.lit(item)))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__c", before).where(F.col("__c") < budget)
    return rows.withColumn("text", F.left("text", F.least(F.lit(item), F.lit(budget) - F.col("__c")).cast("int"))).drop("__n", "__c")


def context(rows: DataFrame, by: str, order: list[Column], budget: int = CONTEXT) -> DataFrame:
    """Leading items of each group within a budget; the first always."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = rows.withColumn("__r", F.row_number().over(w)).withColumn("__c", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("__r") == 1) | (F.col("__c") <= budget)).drop("__r", "__c")


def pool(rankings: dict[str, DataFrame], limit: int = 100) -> DataFrame:
    """query_id, evidence_id, pool_rank: rankings one after the other, first occurrences; each source may pass the limit by one."""
    rows = None
    for k, r in enumerate(rankings.values()):
        x = r.select("query_id", "evidence_id", F.lit(k).alias("source"), "rank")
        rows = x if rows is None else rows.unionByName(x)
    first = rows.groupBy("query_id", "evidence_id").agg(F.min(F.struct("source", "rank")).alias("at"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "evidence_id"))
    k = F.row_number().over(Window.partitionBy("query_id", "at.source").orderBy("at", "evidence_id"))
    # a source adds ids while the pool is short, and one more when it finds it full
    out = first.withColumn("n", n).withColumn("k", k).where((F.col("n") <= limit) | (F.col("k") == 1))
    return out.select("query_id", "evidence_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "evidence_id")).alias("pool_rank"))


def metadata_neighbours(seeds: DataFrame, rows: DataFrame, k: int = 40) -> DataFrame:
    """Rows that share sessions (3 each), checkpoints (2) or files (1) with a query's seeds; by equi-joins on the shared value.

    Rows of the same sessions, checkpoints and files are one class with one score for a query, so only their ``k`` least ids can be
    among its best; queries whose seeds have the same values are one class too. Classes are joined, then opened to their ids.
    """
    columns = (("session_ids", 3), ("checkpoint_pks", 2), ("files", 1))
    values = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    key = F.struct(*[F.col(c) for c, _ in columns])
    of = lambda df: df.withColumn("class", F.sha2(F.to_json(key), 256))
    own = of(rows.select("evidence_id", *[values(F.col(c)).alias(c) for c, _ in columns]))
    asked = seeds.groupBy("query_id").agg(*[values(F.flatten(F.collect_list(c))).alias(c) for c, _ in columns])
    asked = _saved(of(asked))
    members = _least(own, k)
    kinds = lambda df: _saved(df.select("class", *[c for c, _ in columns]).dropDuplicates(["class"]))
    left, right, parts = kinds(asked), kinds(own), None
    for column, points in columns:
        a = left.select(F.col("class").alias("asker"), F.explode(column).alias("v"))
        b = right.select("class", F.explode(column).alias("v"))
        x = b.join(a, "v").select("asker", "class", F.lit(points).alias("points"))
        parts = x if parts is None else parts.unionByName(x)
    sums = parts.groupBy("asker", "class").agg(F.sum("points").alias("score"))
    # classes from the best on, until those before have k ids
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    before = Window.partitionBy("asker").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("asker", "score")
    able = sums.join(sizes, "class").withColumn("higher", F.sum("n").over(before) - F.sum("n").over(level)).where(F.col("higher") < k)
    best = top(able.join(members, "class").select(F.col("asker").alias("query_id"), "evidence_id", "score"), "score", k)
    return asked.select("query_id", F.col("class").alias("asker")).join(best.withColumnRenamed("query_id", "asker"), "asker").select("query_id", "evidence_id", "score", "rank")


def _least(own: DataFrame, k: int) -> DataFrame:
    """class, evidence_id: the ``k`` least ids of each class; parts of a class are cut apart first, so that a large one isn't one task's."""
    cut = lambda df, *by: df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("evidence_id"))).where(F.col("__r") <= k).drop("__r")
    dealt = own.select("class", "evidence_id").withColumn("part", F.pmod(F.xxhash64("evidence_id"), F.lit(64)))
    return _saved(cut(cut(dealt, "class", "part").drop("part"), "class"))


def chronological(rows: DataFrame, by: str, mode: str = "neutral") -> DataFrame:
    """Order by time: newest first, oldest first, or oldest and newest in turn, as ``time_rank``."""
    up = Window.partitionBy(by).orderBy(F.asc_nulls_first("timestamp"), "evidence_id")
    down = Window.partitionBy(by).orderBy(F.desc_nulls_last("timestamp"), F.desc("evidence_id"))
    a, z = F.row_number().over(up), F.row_number().over(down)
    if mode in ("current", "latest"):
        return rows.withColumn("time_rank", z)
    if mode != "neutral":
        return rows.withColumn("time_rank", a)
    rows = rows.withColumn("__a", a).withColumn("__z", z)
    order = Window.partitionBy(by).orderBy(F.least("__a", "__z"), F.when(F.col("__a") <= F.col("__z"), 0).otherwise(1))
    return rows.withColumn("time_rank", F.row_number().over(order)).drop("__a", "__z")


def generation_groups(evidence: DataFrame, of_topic: int = 12, of_session: int = 8) -> DataFrame:
    """group_id, evidence_id, place of the sources to ask about together: topics with their first parents, and sessions that no topic covers.

    evidence: evidence_id, evidence_type, parent_ids, session_ids. A group's own record has place 0.
    """
    topics = evidence.where("evidence_type = 'topic'").select("evidence_id", "parent_ids", "session_ids")
    covered = topics.select(F.explode("session_ids").alias("session")).distinct()
    sessions = evidence.where("evidence_type = 'session'").select("evidence_id", "parent_ids", "session_ids")
    # a session's record stays unless all of its sessions are covered
    open_ = sessions.select("evidence_id", F.explode("session_ids").alias("session")).join(covered, "session", "left_anti").select("evidence_id").distinct()
    heads = topics.select("evidence_id", "parent_ids", F.lit(of_topic).alias("most")).unionByName(sessions.join(open_, "evidence_id", "left_semi").select("evidence_id", "parent_ids", F.lit(of_session).alias("most")))
    members = heads.select(F.col("evidence_id").alias("group_id"), "most", F.posexplode("parent_ids").alias("k", "evidence_id")).join(evidence.select("evidence_id"), "evidence_id", "left_semi")
    members = members.withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy("k"))).where("place <= most")
    return heads.select(F.col("evidence_id").alias("group_id"), "evidence_id", F.lit(0).alias("place")).unionByName(members.select("group_id", "evidence_id", "place"))


def required_ids(queries: DataFrame) -> DataFrame:
    """evidence_id of all records that queries name as sources or positives; an index must hold them."""
    named = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("primary_positive_ids", "supporting_positive_ids", "generation_source_ids")])
    return queries.select(F.explode(named).alias("evidence_id")).distinct()


def prompt_items(rows: DataFrame) -> DataFrame:
    """What a prompt shows of a record: item, a struct of id, type, title, text, time, session ids, commits and up to thirty files."""
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.withColumn("item", F.struct("evidence_id", "evidence_type", "title", "text", at.alias("timestamp"), "session_ids", "commit_shas", F.slice("files", 1, 30).alias("files")))


def query_errors(queries: DataFrame) -> DataFrame:
    """query_id, errors: what forbids a query by its own text."""
    q, n = F.col("query"), text.word_count(F.col("query"))
    checks = [("length", (n < 4) | (n > 40)), ("meta_phrase", q.rlike(text.META_PHRASE)), ("identifier", q.rlike(text.UUID_LIKE) | q.rlike(text.SHA_LIKE)), ("sensitive", text.is_sensitive(q))]
    return queries.select("query_id", F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks])).alias("errors"))


_CLAIMS = "array<struct<claim_id:string,text:string,supporting_evidence_ids:array<string>,evidence_quotes:map<string,string>>>"


def all_query_errors(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, errors: by text, by answerability, and by the records that a query and its claims name.

    queries: query_id, query, answerability, partition, expected_claims, primary_positive_ids, supporting_positive_ids,
    generation_source_ids; evidence: evidence_id, partition, text.
    """
    none = F.array().cast("array<string>")
    q = queries.withColumn("expected_claims", F.coalesce(F.col("expected_claims").cast(_CLAIMS), F.array().cast(_CLAIMS)))
    for c in ("primary_positive_ids", "supporting_positive_ids", "generation_source_ids"):
        q = q.withColumn(c, F.coalesce(c, none))
    named = F.concat("generation_source_ids", "primary_positive_ids", "supporting_positive_ids", F.flatten(F.transform("expected_claims", lambda c: c["supporting_evidence_ids"])))
    known = evidence.select("evidence_id", F.col("partition").alias("of"), "text")
    at = q.select("query_id", "partition", F.explode(F.array_distinct(named)).alias("evidence_id")).join(known.drop("text"), "evidence_id", "left")
    by_id = at.groupBy("query_id").agg(F.count_if(F.col("of").isNull()).alias("missing"), F.count_if(F.col("of") != F.col("partition")).alias("foreign"))
    quotes = q.select("query_id", F.explode("expected_claims").alias("c")).select("query_id", F.explode("c.evidence_quotes").alias("evidence_id", "quote"))
    quotes = quotes.join(known, "evidence_id", "left").groupBy("query_id").agg(F.count_if(~F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False))).alias("unquoted"))
    x = q.join(query_errors(q), "query_id").join(by_id, "query_id", "left").join(quotes, "query_id", "left").fillna(0, ["missing", "foreign", "unquoted"])
    claims, positives = F.size("expected_claims") > 0, F.size("primary_positive_ids") + F.size("supporting_positive_ids") > 0
    unsupported = F.col("answerability") == "unsupported"
    checks = [("missing_evidence", F.col("missing") > 0), ("other_partition", F.col("foreign") > 0), ("unsupported_with_evidence", unsupported & (claims | positives)), ("supported_without_evidence", ~unsupported & ~(claims & positives)), ("quote_unresolved", F.col("unquoted") > 0)]
    more = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
    return x.select("query_id", F.concat("errors", more).alias("errors"))


def constraint_errors(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with errors of their values: records, queries, scores or judgments."""
    n = text.word_count(F.col("query")) if kind == "queries" else None
    checks = {
        "records": lambda: [("no_source", F.size("source_refs") < 1)],
        "queries": lambda: [("length", (n < 4) | (n > 40))],
        "scores": lambda: [(c, ~F.col(c).between(1, 5)) for c in ("groundedness", "answerability", "sufficiency", "naturalness")],
        "judgments": lambda: [("grade", ~F.col("grade").between(0, 3))],
    }[kind]()
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in checks])))


def summary(queries: DataFrame) -> DataFrame:
    """field, value, queries: how many have each answerability, partition, scope and temporal mode; and a digest of all (field hash)."""
    fields = ("answerability", "partition", "scope", "temporal_mode")
    rows = queries.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("queries"))
    own = queries.select(F.sha2(F.to_json(F.struct(*sorted(queries.columns))), 256).alias("d"))
    whole = own.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("value"), F.count("*").alias("queries"))  # a benchmark's queries
    return rows.unionByName(whole.select(F.lit("hash").alias("field"), "value", "queries"))


def rejections(assessments: DataFrame) -> DataFrame:
    """issue, n over assessments that weren't accepted: accepted, deterministic_errors, critic_failures, scores (with issues and accepted)."""
    x = assessments.where(~F.coalesce("accepted", F.lit(False)))
    own = F.array_compact(F.array(F.when(F.size("deterministic_errors") > 0, F.lit("deterministic")), F.when(F.size("critic_failures") > 0, F.lit("critic_failure"))))
    issues = ("ambiguity_issue", "leakage_issue", "temporal_issue")
    of = lambda s: F.array_compact(F.array(*[F.when(F.coalesce(s[i], F.lit("")) != "", F.lit(i)) for i in issues], F.when(~F.coalesce(s["accepted"], F.lit(False)), F.lit("critic_rejected"))))
    return x.select(F.explode(F.concat(own, F.flatten(F.transform("scores", of)))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def candidate_pool(dense: DataFrame, lexical: DataFrame, neighbours: DataFrame, dated: DataFrame, queries: DataFrame, limit: int = 100, per_source: int = 40) -> DataFrame:
    """The pool of four rankings of ``per_source``: dense, lexical, by shared metadata, and by time as the query's mode asks.

    dated: query_id, evidence_id, timestamp of records that may be asked for; queries: query_id, mode.
    """
    x = dated.join(queries.select("query_id", "mode"), "query_id")
    new, plain = F.col("mode").isin("current", "latest"), F.col("mode") == "neutral"
    timed = chronological(x.where(new), "query_id", "latest").unionByName(chronological(x.where(plain), "query_id")).unionByName(chronological(x.where(~new & ~plain), "query_id", "evolution"))
    timed = timed.where(F.col("time_rank") <= per_source).select("query_id", "evidence_id", F.col("time_rank").alias("rank"))
    cut = lambda df: df.where(F.col("rank") <= per_source)
    return pool({"dense": cut(dense), "lexical": cut(lexical), "metadata": cut(neighbours), "time": timed}, limit)


def shuffled(rows: DataFrame, by: str, seed: int, item: str = "evidence_id") -> DataFrame:
    """``rows`` with ``place``: a fixed shuffle of each group's items."""
    from lodestone.functions import ids

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(ids.seeded_rank(seed, F.col(by), F.col(item)), item)))


def accepted(scores: DataFrame, passes: int = 1) -> DataFrame:
    """query_id, accepted: every pass is there, and good enough in each score."""
    good = F.col("accepted") & (F.col("groundedness") == 5) & (F.col("answerability") >= 4) & (F.col("sufficiency") >= 4) & (F.col("naturalness") >= 3) & (F.coalesce(F.col("issue"), F.lit("")) == "")
    return scores.groupBy("query_id").agg(((F.count("*") >= passes) & F.bool_and(F.coalesce(good, F.lit(False)))).alias("accepted"))


#: What a critic says of a question in one pass.
SCORES = ("groundedness", "answerability", "evidence_sufficiency", "naturalness")
ISSUES = ("ambiguity_issue", "leakage_issue", "temporal_issue")
CRITIC = {
    "type": "object",
    "properties": {"accepted": {"type": "boolean"}, **{s: {"type": "integer", "minimum": 1, "maximum": 5} for s in SCORES}, **{i: {"type": ["string", "null"]} for i in ISSUES}},
}
_SCORE = "struct<accepted:boolean," + ",".join(f"{s}:int" for s in SCORES) + "," + ",".join(f"{i}:string" for i in ISSUES) + ">"


def critic_requests(queries: DataFrame, evidence: DataFrame, double_evaluation: bool = True, seed: int = 7) -> DataFrame:
    """query_id, pass, request: each question with its records in a shuffle of the pass's own, within the character budget.

    queries: query_id, query, answerability, partition and the lists of ids; evidence: records. Questions of the evaluation partition
    have two passes if ``double_evaluation`` says so, all others one; a question without records is asked about alone.
    """
    named = F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("generation_source_ids", "primary_positive_ids", "supporting_positive_ids")]))
    twice = (F.col("partition") == "evaluation") & F.lit(double_evaluation)
    told = F.struct("query_id", "query", "answerability", "partition", "temporal_mode", "expected_claims").alias("candidate")
    asked = queries.select("query_id", told, named.alias("ids"), F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("pass"))
    rows = asked.select("query_id", "pass", F.explode("ids").alias("evidence_id")).join(prompt_items(evidence).select("evidence_id", "text", "item"), "evidence_id")
    rows = shuffled(rows.withColumn("of", F.concat_ws(":", "query_id", F.col("pass").cast("string"))), "of", seed)
    shown = packet(rows, "of", [F.col("place")]).groupBy("query_id", "pass").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("items"))
    out = asked.drop("ids").join(shown, ["query_id", "pass"], "left")
    return out.select("query_id", "pass", F.to_json(F.struct("candidate", "items", "pass")).alias("request"))


def assessments(queries: DataFrame, answers: DataFrame, errors: DataFrame, double_evaluation: bool = True) -> DataFrame:
    """query_id, accepted, scores (in the order of passes), deterministic_errors, critic_failures of every question.

    answers: query_id, pass, response, error of the ``critic_requests``; errors: query_id, errors of ``all_query_errors``. Accepted are those
    whose passes are all there and good enough, and that no rule forbids.
    """
    got = answers.select("query_id", "pass", F.from_json("response", _SCORE).alias("score"), "error")
    by = got.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("pass", "score")))), lambda x: x["score"]).alias("scores"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("pass", "error")))), lambda x: x["error"]).alias("critic_failures"),
    )
    passes = F.when((F.col("partition") == "evaluation") & F.lit(double_evaluation), 2).otherwise(1)
    x = queries.select("query_id", passes.alias("passes")).join(by, "query_id", "left").join(errors.select("query_id", F.col("errors").alias("deterministic_errors")), "query_id", "left")
    clean = lambda s: F.forall(F.array(*[F.coalesce(s[i], F.lit("")) for i in ISSUES]), lambda i: i == "")
    good = lambda s: s["accepted"] & (s["groundedness"] == 5) & (s["answerability"] >= 4) & (s["evidence_sufficiency"] >= 4) & (s["naturalness"] >= 3) & clean(s)
    x = x.withColumn("scores", F.coalesce("scores", F.array().cast(f"array<{_SCORE}>")))
    for c in ("critic_failures", "deterministic_errors"):
        x = x.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    ok = (F.size("scores") == F.col("passes")) & F.forall("scores", lambda s: F.coalesce(good(s), F.lit(False))) & (F.size("deterministic_errors") == 0)
    return x.select("query_id", ok.alias("accepted"), "scores", "deterministic_errors", "critic_failures")


def exact_dedup(queries: DataFrame) -> DataFrame:
    """The first query (by id) of each text, white space and case aside."""
    w = Window.partitionBy(text.collapse(F.col("query"))).orderBy("query_id")
    return queries.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def tfidf(rows: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """id, term, w: normalized weights of words and pairs of words, with smoothed idf."""
    terms = rows.select(id_col, F.explode(text.ngrams(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    n = rows.agg(F.count("*").alias("n"))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    x = terms.join(df, "term").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1.0 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return x.select(id_col, "term", (F.col("w") / norm).alias("w"))


def similar_pairs(rows: DataFrame, threshold: float = 0.92, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """Pairs (a < b) with a TF-IDF cosine of the threshold or more.

    Prefix filtering: a pair that is similar enough shares one of the rarest terms of both, those before the rest's weight falls
    under the threshold; only these meet in the join, and then the full cosine decides.
    """
    w = tfidf(rows, id_col, text_col)
    order = Window.partitionBy(id_col).orderBy(F.desc("w"), "term")
    # the heaviest term has none before it, and all the weight is left; ``greatest`` would take the sum's null for none
    before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    prefix = w.withColumn("rest", F.sqrt(F.greatest(F.lit(0.0), 1 - before))).where(F.col("rest") >= threshold - 1e-9).select(F.col(id_col).alias("a"), "term")
    cand = prefix.join(w.select(F.col(id_col).alias("b"), "term"), "term").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = cand.join(w.select(F.col(id_col).alias("a"), "term", F.col("w").alias("wa")), "a").join(w.select(F.col(id_col).alias("b"), "term", F.col("w").alias("wb")), ["b", "term"])
    return x.groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 9).alias("cosine")).where(F.col("cosine") >= threshold)


def greedy_keep(ids: DataFrame, pairs: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Ids kept when each is taken in order unless similar to one taken: rounds settle those whose earlier partners are settled."""
    p = _saved(pairs.select("a", "b"))
    state = _saved(ids.select(F.col(id_col).alias("id"), F.lit(None).cast("boolean").alias("kept")))
    while True:
        s = state.select(F.col("id").alias("a"), F.col("kept").alias("ka"))
        by = p.join(s, "a").groupBy("b").agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("hit"), F.bool_or(F.col("ka").isNull()).alias("open"))
        x = state.join(by, F.col("id") == F.col("b"), "left")
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = _saved(x.select("id", now.alias("kept")))
        if not state.where("kept is null").limit(1).count():
            return state.where("kept").select(F.col("id").alias(id_col))


def judgments(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """query_id, evidence_id, grade: the highest of each pair, first come on ties; anchors count where they are higher."""
    x = rows.select("query_id", "evidence_id", "grade", F.lit(0).alias("priority"), "ordinal").unionByName(anchors.select("query_id", "evidence_id", "grade", F.lit(1).alias("priority"), F.lit(0).cast("long").alias("ordinal")))
    w = Window.partitionBy("query_id", "evidence_id").orderBy(F.desc("grade"), "priority", "ordinal")
    return x.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", "evidence_id", "grade", F.when(F.col("priority") == 1, "anchor").otherwise("judge").alias("origin"))


def normalized_judgments(rows: DataFrame, evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """Grades that stand: the query is supported, a claim is named, and a quote is in the text; else zero."""
    x = rows.join(evidence.select("evidence_id", "text"), "evidence_id").join(queries.select("query_id", "answerability"), "query_id")
    quoted = F.exists("quotes", lambda q: F.col("text").contains(q) & (q != ""))
    ok = (F.col("answerability") != "unsupported") & (F.size("claims") > 0) & quoted
    return x.withColumn("grade", F.when(F.coalesce(ok, F.lit(False)), F.col("grade")).otherwise(0)).drop("text", "answerability")
