"""The engine's runs over a folder of logs: validate, prepare, index, query, answer, evaluate, calibrate, audit,
generate, judge, answer-benchmark and train.

Each step reads the tables of the one before from ``out`` and writes its own there, so a step can be run again alone.
Texts and vectors stay in tables; only counts and metrics come to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.ids import stable_id
from lodestone.operators import answering, batches, benchmark, calibration, dense, evidence, lexical, metrics, partition, search
from lodestone.sources import artifacts, tables, versions

QUERY_PREFIX = "Find evidence for the question: "
def _empty() -> Column:
    return F.array().cast("array<string>")


def _state(spark: SparkSession, data: str) -> Row:
    """One row that changes when a source file does."""
    return answering.file_state(spark, data).agg(F.count("*"), F.sum("size"), F.sum(F.xxhash64("path", "size", "modificationTime").cast("decimal(38,0)"))).first()


def _manifest(spark: SparkSession, out: str, stage: str, config: dict, counts: dict) -> None:
    """Writes the manifest of a step over the evidence; its inputs are told by paths, sizes and times, as evidence may be large."""
    inputs = artifacts.canonical_hash(list(map(str, _state(spark, f"{out}/evidence"))))
    artifacts.write_document(spark, f"{out}/manifests/{stage}.json", artifacts.run_manifest(spark, stage, out, config, counts, inputs=inputs))


def build_evidence(spark: SparkSession, data: str, transcripts: bool = True, chosen: DataFrame | None = None, **flags) -> DataFrame:
    """Records of turns, transcripts, checkpoints, commits and sessions; of the ``chosen`` sessions, where given."""
    get = lambda name: tables.read_table(spark, data, name)
    turns, points, commits, sessions = get("conversations"), get("checkpoints"), get("commits"), get("sessions")
    logs = get("session_logs")
    conv = evidence.shaped(evidence.conversation_evidence(evidence.of_sessions(turns, chosen), **flags))
    point = evidence.shaped(evidence.checkpoint_evidence(tables.last_wins(points, "checkpoint_pk"), chosen))
    comm = evidence.shaped(evidence.commit_evidence(commits, tables.last_wins(points, "checkpoint_pk"), chosen))
    told = None
    by = tables.last_wins(logs, "session_id").where("transcript_path is not null")
    if transcripts and by.limit(1).count():
        for r in by.where(F.col("transcript_path").rlike(r"^/|(^|/)\.\.(/|$)")).limit(1).collect():
            tables.check_relative(r["transcript_path"])
        events = tables.read_transcripts(spark, f"{data}/transcripts").withColumn("path", F.regexp_extract("path", r"transcripts/.*$", 0))
        paths = evidence.of_sessions(by, chosen).select(F.regexp_replace("transcript_path", r"^(?!transcripts/)", "transcripts/").alias("path"), "session_id")
        told = evidence.shaped(evidence.transcript_evidence(events.join(paths, "path"), **flags))
    related = tables.relations(sessions, logs, turns, points, commits).drop("commit_shas", "created_at")
    cards = tables.last_wins(sessions, "session_id").drop("checkpoint_ids").join(related, "session_id").join(by.select("session_id", F.col("source_row").alias("log_row")), "session_id", "left")
    cards = evidence.shaped(evidence.session_evidence(evidence.of_sessions(cards, chosen), conv, told, point, comm))
    whole = conv.unionByName(point).unionByName(comm).unionByName(cards)
    return whole.unionByName(told) if told is not None else whole


def validate(spark: SparkSession, data: str) -> dict:
    """Rows of each table and files of transcripts; raises where a table or column is missing."""
    return {**tables.validate(spark, data), "transcripts": artifacts.transcript_count(spark, f"{data}/transcripts")}


def prepare(spark: SparkSession, data: str, out: str, validation_from: str, evaluation_from: str, pilot: int = 0, seed: int = 7, **flags) -> dict:
    """Writes evidence, with views of topics for each partition, and the run's manifest; returns counts.

    A ``pilot`` of so many sessions is drawn, unless it is zero. Raises if a session, checkpoint or topic is in two partitions.
    """
    before = _state(spark, data)
    sessions = tables.read_table(spark, data, "sessions")
    chosen = None
    if pilot:
        asked = evidence.optional(tables.last_wins(sessions, "session_id"), "agent", "user_id", "files_touched_count")
        tables.write_table(partition.pilot(asked, pilot, seed), f"{out}/pilot")
        chosen = spark.read.parquet(f"{out}/pilot")
    dated = tables.last_wins(sessions, "session_id").select("session_id", "created_at")
    tables.write_table(partition.partition_records(build_evidence(spark, data, chosen=chosen, **flags), dated, validation_from, evaluation_from), f"{out}/records")
    records = spark.read.parquet(f"{out}/records")
    topics = evidence.shaped(evidence.topic_evidence(records.where(F.col("evidence_type").isin("session", "commit"))))
    views = partition.topic_views(topics, records)
    whole = records.unionByName(evidence.shaped(views).join(views.select("evidence_id", "partition"), "evidence_id"))
    tables.write_table(whole, f"{out}/evidence", ["partition"])
    found = spark.read.parquet(f"{out}/evidence")
    partition.assert_isolated(found)
    if _state(spark, data) != before:
        raise RuntimeError("the source tables changed during the run")
    counts = {f"{r['partition']}/{r['evidence_type']}": r["records"] for r in partition.report_types(found).collect()}
    by_type = {r["evidence_type"]: {"records": r["records"], "unresolved": r["unresolved"]} for r in evidence.quality_by_type(found).collect()}
    config = {"validation_from": validation_from, "evaluation_from": evaluation_from, "pilot": pilot, "seed": seed, **flags}
    artifacts.write_document(spark, f"{out}/manifests/prepare.json", artifacts.run_manifest(spark, "prepare", data, config, counts))
    return {"quality": evidence.quality(found).first().asDict(), "by_type": by_type, "counts": dict(sorted(counts.items()))}


def index(spark: SparkSession, out: str, encoder: Callable | None = None, queries: DataFrame | None = None) -> dict:
    """Writes vectors (those of unchanged records are used again) and weighed postings, of the records that ``queries`` name too."""
    rows = evidence.select_index(spark.read.parquet(f"{out}/evidence"), None if queries is None else benchmark.required_ids(queries))
    known = vectors(spark, out)
    fresh = dense.encode(rows.join(known, "evidence_id", "left_anti"), encoder or dense.hashing_encoder())
    gone = known.join(rows, "evidence_id", "left_anti")
    if rows.join(known, "evidence_id", "left_anti").limit(1).count() or gone.limit(1).count():
        versions.write(fresh, f"{out}/vectors", "evidence_id", gone)
    if versions.latest(spark, f"{out}/vectors") % COMPACT == COMPACT - 1:
        versions.compact(spark, f"{out}/vectors", "evidence_id")
    weighed, terms, _ = lexical.index(rows)
    tables.write_table(terms, f"{out}/terms")
    tables.write_table(weighed, f"{out}/weights")
    counts = {"vectors": vectors(spark, out).count(), **{name: spark.read.parquet(f"{out}/{name}").count() for name in ("terms", "weights")}}
    _manifest(spark, out, "index", {"queries": queries is not None}, counts)
    return counts


#: Versions of the vectors after which they are compacted.
COMPACT = 8


def vectors(spark: SparkSession, out: str) -> DataFrame:
    """evidence_id, vec of the index."""
    return versions.read(spark, f"{out}/vectors", "evidence_id", schema="evidence_id string, vec array<double>")


def rankings(spark: SparkSession, out: str, queries: DataFrame, rows: DataFrame, k: int = 50, encoder: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical rankings of queries (query_id, query) over the indexed ``rows``."""
    allowed = rows.select("evidence_id")
    own = vectors(spark, out).join(allowed, "evidence_id", "left_semi")
    asked = dense.encode(queries.select("query_id", F.col("query").alias("text")), encoder or dense.hashing_encoder(), QUERY_PREFIX, "query_id")
    words = lexical.query_terms(queries).join(spark.read.parquet(f"{out}/terms"), "term")
    weighed = spark.read.parquet(f"{out}/weights").join(allowed, "evidence_id", "left_semi")
    return dense.knn(own, asked, k), lexical.score(weighed, words, k)


def _moded(queries: DataFrame) -> DataFrame:
    return queries if "mode" in queries.columns else queries.withColumn("mode", text.temporal_mode(F.col("query")))


def query(spark: SparkSession, out: str, queries: DataFrame, *, as_of: str | None = None, filters: dict | None = None, limit: int = 10, partitions: list[str] | None = None, artifact: dict | None = None, **options) -> DataFrame:
    """Ranked hits of queries (query_id, query, and mode where known), with title, text, time and citations.

    ``partitions`` are those whose records may be found; an ``artifact`` of ``calibrate`` annotates the hits.
    """
    whole = spark.read.parquet(f"{out}/evidence")
    rows = search.allowed(whole, partitions)
    moment = F.lit(as_of).cast("timestamp")
    if filters:
        rows = search.metadata_filter(rows, filters)
    if as_of:
        rows = search.as_of(rows, moment)
    queries = _moded(queries)
    payload = rows.select("evidence_id", "timestamp", "source_refs", F.coalesce("topic_key", F.get("session_ids", F.lit(0)), "evidence_id").alias("group_id"))
    d, x = rankings(spark, out, queries, rows)
    indexed = whole.join(vectors(spark, out).select("evidence_id"), "evidence_id", "left_semi")
    hits = search.hybrid_search(d, x, payload, queries.select("query_id", "mode", moment.alias("as_of")), limit=limit, at=search.latest(indexed), **options)
    if artifact:
        hits = calibration.runtime(hits, _features(d, x, artifact["relevance"]), artifact)
    return hits.join(rows.select("evidence_id", "evidence_type", "title", "text"), "evidence_id")


def _features(d: DataFrame, x: DataFrame, relevance: dict) -> DataFrame:
    return calibration.query_features(d, x, relevance["x_thresholds"], relevance["y_thresholds"], relevance["probability_threshold"])


def _shown(spark: SparkSession, out: str, queries: DataFrame, **options) -> DataFrame:
    """Questions with the ids of their hits that fit the context, in rank order."""
    hits = benchmark.context(query(spark, out, queries, **options), "query_id", [F.col("final_rank")])
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "evidence_id"))), lambda h: h["evidence_id"]).alias("evidence_ids"))
    return _moded(queries).select("query_id", "query", "mode").join(found, "query_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", _empty()))


def answer(spark: SparkSession, out: str, queries: DataFrame, provider: Callable = answering.offline, **options) -> DataFrame:
    """Answers from the hits, checked and made again where they fail; a query without any hit is unsupported. With citations."""
    rows = spark.read.parquet(f"{out}/evidence")
    told = answering.answer_queries(_shown(spark, out, queries, **options), rows, provider, cache=f"{out}/cache")
    refs = answering.citations(told, rows).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("evidence_id", "source"))).alias("citations"))
    return told.join(refs, "query_id", "left")


def answer_benchmark(spark: SparkSession, out: str, queries: DataFrame, provider: Callable = answering.offline, **options) -> dict:
    """Answers the queries that have no valid answer yet, one folder of JSON each; counts."""
    schema = "query_id string, valid boolean"
    try:
        known = artifacts.read_answers(spark, f"{out}/answers", schema)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], schema)
    open_ = queries.join(answering.missing_answers(queries, known), "query_id", "left_semi")
    tables.write_table(answer(spark, out, open_, provider, **options), f"{out}/answers.new")
    new = spark.read.parquet(f"{out}/answers.new")
    new.withColumn("__of", F.col("query_id")).write.mode("append").partitionBy("__of").json(f"{out}/answers")
    return {"answered": new.count(), "valid": new.where("valid").count()}


def offline_questions(request: dict) -> dict:
    """A generator for use without a model: one question of the first source's title, with a quote of its text."""
    first = request["items"][0]
    quote = first["text"][:40]
    claim = {"claim_id": "c1", "text": quote, "supporting_evidence_ids": [first["evidence_id"]], "evidence_quotes": {first["evidence_id"]: quote}}
    return {"queries": [{"query": " ".join(f"What was done about {first['title']}".split()[:30]), "answerability": "supported", "scope": request.get("scope", "single"), "expected_claims": [claim], "positive_ids": [first["evidence_id"]]}]}


#: What a generator and a judge must answer.
QUESTIONS = {"type": "object", "properties": {"queries": {"type": "array", "items": {"type": "object", "properties": {"query": {"type": "string"}, "answerability": {"enum": ["supported", "partial", "unsupported"]}, "scope": {"type": "string"}, "expected_claims": {"type": "array", "items": {"type": "object"}}, "positive_ids": {"type": "array", "items": {"type": "string"}}}}}}}
GRADE = {"type": "object", "properties": {"grade": {"type": "integer", "minimum": 0, "maximum": 3}, "claims": {"type": "array", "items": {"type": "string"}}, "quotes": {"type": "array", "items": {"type": "string"}}}}
_MADE = "struct<queries:array<struct<query:string,answerability:string,scope:string,expected_claims:array<struct<claim_id:string,text:string,supporting_evidence_ids:array<string>,evidence_quotes:map<string,string>>>,positive_ids:array<string>>>>"


def offline_critic(request: dict) -> dict:
    """A critic for use without a model: content with questions of which every quote is in the records shown, and that have some."""
    shown = {i["evidence_id"]: i["text"] for i in request.get("items") or []}
    quotes = [(e, q) for c in request["candidate"].get("expected_claims") or [] for e, q in (c.get("evidence_quotes") or {}).items()]
    good = bool(quotes) and all(q in shown.get(e, "") for e, q in quotes)
    return {"accepted": good, "groundedness": 5 if good else 2, "answerability": 5 if good else 2, "evidence_sufficiency": 5, "naturalness": 4, **dict.fromkeys(benchmark.ISSUES)}


def criticize(spark: SparkSession, out: str, critic: Callable = offline_critic, double_evaluation: bool = True, seed: int = 7) -> dict:
    """Writes the assessments of all candidates, and those accepted that don't say the same as the benchmark; counts, and rejections by issue."""
    rows, q = spark.read.parquet(f"{out}/evidence"), spark.read.parquet(f"{out}/candidates")
    asked = benchmark.critic_requests(q, rows, double_evaluation, seed)
    got = answering.cached_complete(asked.withColumn("key", F.struct("query_id", "pass")), f"{out}/cache", critic, key="key", stage="critic", schema=benchmark.CRITIC, required=("accepted", *benchmark.SCORES))
    told = benchmark.assessments(q, got.select("key.*", "response", "error"), benchmark.all_query_errors(q, rows), double_evaluation)
    tables.write_table(told, f"{out}/assessments")
    told = spark.read.parquet(f"{out}/assessments")
    good = benchmark.exact_dedup(q.join(told.where("accepted"), "query_id", "left_semi"))
    kept = benchmark.greedy_keep(good.select("query_id"), benchmark.similar_pairs(good.select("query_id", "query")))
    tables.write_table(good.join(kept, "query_id", "left_semi"), f"{out}/queries")
    whole = spark.read.parquet(f"{out}/queries")
    summary: dict = {}
    for r in benchmark.summary(whole).collect():  # a few values of four fields
        summary.setdefault(r["field"], {})[r["value"]] = r["queries"]
    return {"accepted": told.where("accepted").count(), "kept": whole.count(), "rejections": {r["issue"]: r["n"] for r in benchmark.rejections(told).collect()}, "summary": summary}


def generate(spark: SparkSession, out: str, provider: Callable = offline_questions, critic: Callable = offline_critic) -> dict:
    """Writes candidates of questions about groups of sources, then the benchmark of those that pass rules and criticism; counts."""
    rows = benchmark.prompt_items(spark.read.parquet(f"{out}/evidence"))
    groups = benchmark.generation_groups(rows).join(rows, "evidence_id")
    packets = benchmark.packet(groups, "group_id", [F.col("place"), F.col("evidence_id")])
    items = packets.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id", "item"))), lambda x: x["item"]).alias("items"), F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))), lambda x: x["evidence_id"]).alias("generation_source_ids"), F.max_by("partition", -F.col("place")).alias("partition"))
    got = answering.cached_complete(items.select("group_id", F.to_json(F.struct("items")).alias("request")), f"{out}/cache", provider, key="group_id", stage="generate", schema=QUESTIONS, required=("queries",)).join(items.drop("items"), "group_id")
    q = got.select("group_id", "generation_source_ids", "partition", F.posexplode(F.from_json("response", _MADE)["queries"]).alias("k", "q")).select("*", "q.*").drop("q")
    q = q.withColumn("query_id", stable_id("query", F.col("group_id"), F.col("k"), F.col("query"))).withColumn("primary_positive_ids", F.col("positive_ids")).withColumn("supporting_positive_ids", _empty())
    q = q.withColumn("temporal_mode", text.temporal_mode(F.col("query"))).drop("k", "positive_ids")
    tables.write_table(q, f"{out}/candidates")
    return {"made": spark.read.parquet(f"{out}/candidates").count(), **criticize(spark, out, critic)}


def offline_judge(request: dict) -> dict:
    """A judge for use without a model: the highest grade for the sources asked about, one for words in common, else zero."""
    if request["evidence_id"] in request["positive_ids"]:
        return {"grade": 3, "claims": ["c1"], "quotes": [request["text"][:40]]}
    common = {w.lower() for w in request["query"].split() if len(w) > 4} & {w.lower() for w in request["text"].split()}
    return {"grade": int(len(common) > 1), "claims": ["c1"] if len(common) > 1 else [], "quotes": [request["text"][:40]] if len(common) > 1 else []}


def judge(spark: SparkSession, out: str, provider: Callable = offline_judge) -> dict:
    """Writes grades of the pooled candidates of all questions, with positives as anchors; counts by grade."""
    rows, queries = spark.read.parquet(f"{out}/evidence"), spark.read.parquet(f"{out}/queries").withColumn("mode", F.col("temporal_mode"))
    d, x = rankings(spark, out, queries, rows)
    seeds = queries.select("query_id", F.explode("generation_source_ids").alias("evidence_id")).join(rows.select("evidence_id", "session_ids", "checkpoint_pks", "files"), "evidence_id")
    near = benchmark.metadata_neighbours(seeds, rows)
    dated = near.select("query_id", "evidence_id").join(rows.select("evidence_id", "timestamp"), "evidence_id")
    pooled = benchmark.candidate_pool(d, x, near, dated, queries)
    own = pooled.join(queries.select("query_id", "query", F.col("primary_positive_ids").alias("positive_ids"), "answerability", "partition"), "query_id").join(rows.select("evidence_id", "text", F.col("partition").alias("of")), "evidence_id").where("of = partition")
    asked = own.select(F.struct("query_id", "evidence_id").alias("pair"), F.to_json(F.struct("query", "evidence_id", "positive_ids", F.left("text", F.lit(benchmark.ITEM)).alias("text"))).alias("request"))
    got = answering.cached_complete(asked.withColumn("key", F.to_json("pair")).select("key", "request"), f"{out}/cache", provider, key="key", stage="judge", schema=GRADE, required=("grade",))
    shape = "struct<grade:long,claims:array<string>,quotes:array<string>>"
    got = got.where("response is not null").select(F.from_json("key", "struct<query_id:string,evidence_id:string>").alias("p"), F.from_json("response", shape).alias("r")).select("p.*", "r.*")
    stands = benchmark.normalized_judgments(got.withColumn("ordinal", F.lit(0).cast("long")), rows, queries)
    anchors = queries.select("query_id", F.explode("primary_positive_ids").alias("evidence_id"), F.lit(3).cast("long").alias("grade"))
    claims = stands.select("query_id", "evidence_id", "claims")
    final = benchmark.judgments(stands, anchors).join(claims, ["query_id", "evidence_id"], "left").withColumn("claims", F.coalesce("claims", _empty()))
    tables.write_table(final.join(queries.select("query_id", "partition"), "query_id"), f"{out}/judgments")
    by = spark.read.parquet(f"{out}/judgments").groupBy("grade").count().collect()  # four grades
    return {str(r["grade"]): r["count"] for r in sorted(by, key=lambda r: r["grade"])}


def train(spark: SparkSession, out: str, size: int = 16) -> dict:
    """Writes the training examples of an encoder, isolated from validation and evaluation, and batches without false negatives.

    The encoder itself is trained elsewhere.
    """
    rows, queries = spark.read.parquet(f"{out}/evidence"), spark.read.parquet(f"{out}/queries")
    own = queries.where("partition = 'train'").withColumn("positive_ids", F.concat("primary_positive_ids", "supporting_positive_ids"))
    x = answering.training_triples(own, spark.read.parquet(f"{out}/judgments"))
    if answering.isolation_breaches(x, queries, rows).limit(1).count():
        raise ValueError("a training example isn't of the training partition")
    tables.write_table(x.withColumn("example_id", stable_id("example", F.col("query_id"), F.col("positive_id"))), f"{out}/training")
    x = spark.read.parquet(f"{out}/training")
    tables.write_table(batches.conflict_free_batches(x, size), f"{out}/batches")
    dealt = spark.read.parquet(f"{out}/batches")
    return {"examples": x.count(), "batches": dealt.select("batch").distinct().count(), "conflicts": batches.conflicts(dealt, x).count()}


def usage(spark: SparkSession, out: str) -> dict:
    """Requests, tokens and cost of all calls that are kept, by stage; ``all`` is their sum."""
    found = answering.usage(answering.read_cache(spark, f"{out}/cache")).collect()  # a row for each stage
    return {r["stage"] or "all": {k: r[k] or 0 for k in ("requests", "tokens", "cost")} for r in found}


def evaluate(spark: SparkSession, out: str, queries: DataFrame, qrels: DataFrame, partitions: list[str] | None = None, **options) -> DataFrame:
    """variant and means of the retrieval metrics: dense, lexical, and hybrid; over records of ``partitions``."""
    rows = search.allowed(spark.read.parquet(f"{out}/evidence"), partitions)
    d, x = rankings(spark, out, queries, rows)
    h = query(spark, out, queries, limit=50, partitions=partitions, **options).withColumnRenamed("final_rank", "rank")
    whole = None
    for name, ranking in (("dense", d), ("lexical", x), ("hybrid", h)):
        m = metrics.retrieval_metrics(ranking.select("query_id", "evidence_id", "rank"), qrels, queries)
        m = metrics.means(m).select(F.lit(name).alias("variant"), "*")
        whole = m if whole is None else whole.unionByName(m)
    return whole


def experiment(spark: SparkSession, out: str, queries: DataFrame, qrels: DataFrame, floors: tuple = (0.0, 0.1, 0.2), weights: tuple = (0.0, 0.1, 0.2, 0.3), partitions: list[str] | None = None) -> DataFrame:
    """The variant to use, of lexical, dense and hybrids over a grid of floors and temporal weights: by nDCG, then MRR.

    Hybrids are tuned on ``queries`` first, by nDCG, MRR and least weight; the best one's floor and weight come along. Only records of
    ``partitions`` are found, so that later evidence doesn't compete in tuning. All trials are written.
    """
    rows = search.allowed(spark.read.parquet(f"{out}/evidence"), partitions)
    d, x = rankings(spark, out, queries, rows)
    tables.write_table(search.fuse(d, x).join(rows.select("evidence_id", "timestamp"), "evidence_id"), f"{out}/traces")
    grid = [(k, float(f), float(w)) for k, (f, w) in enumerate((f, w) for f in floors for w in weights)]
    grid = spark.createDataFrame(grid, "trial int, floor double, weight double")
    at = rows.agg(F.max("timestamp").alias("latest"))
    asked = queries.select("query_id", text.temporal_mode(F.col("query")).alias("mode"))
    traces = spark.read.parquet(f"{out}/traces")
    of = lambda kind: traces.where(f"{kind}_rank is not null").select("query_id", "evidence_id", F.col(f"{kind}_rank").alias("rank"))
    hits = traces.join(asked, "query_id").crossJoin(F.broadcast(at))  # one row
    tables.write_table(calibration.trials(hits, {"lexical": of("lexical"), "dense": of("dense")}, grid, qrels, queries), f"{out}/trials")
    tried = spark.read.parquet(f"{out}/trials")
    _manifest(spark, out, "experiment", {"floors": floors, "weights": weights, "partitions": partitions}, {"trials": tried.count()})
    return calibration.choose(tried)


def freeze(spark: SparkSession, out: str, trial: dict) -> None:
    """Writes the chosen trial, once: what is evaluated at the end is what was chosen before."""
    artifacts.mark_once(spark, f"{out}/frozen.json", trial)


def evaluate_once(spark: SparkSession, out: str, queries: DataFrame, qrels: DataFrame) -> dict:
    """The frozen variant on the evaluation partition; a second run raises, and so do questions without a valid answer."""
    trial = artifacts.read_document(spark, f"{out}/frozen.json")
    answers = artifacts.read_answers(spark, f"{out}/answers", "query_id string, valid boolean")
    if answering.missing_answers(queries, answers).limit(1).count():
        raise RuntimeError("some questions have no valid answer")
    artifacts.mark_once(spark, f"{out}/evaluated.json", {"trial": trial})
    found = evaluate(spark, out, queries, qrels, ["evaluation"], floor=trial["floor"], weight=trial["weight"])
    name = "hybrid" if trial["variant"].startswith("hybrid") else trial["variant"]
    return {r["variant"]: r.asDict() for r in found.where(F.col("variant") == name).collect()}


def calibrate(spark: SparkSession, out: str, qrels: DataFrame, queries: DataFrame | None = None) -> dict:
    """Isotonic relevance of dense scores in the experiment's traces, answerability of queries where their truth is known,
    out-of-fold metrics, gates, and what a hard threshold would do to retrieval; also written."""
    good = qrels.where("grade > 0").select("query_id", "evidence_id", F.lit(1).alias("label"))
    traces = spark.read.parquet(f"{out}/traces").where("dense_score is not null")
    pairs = traces.join(good, ["query_id", "evidence_id"], "left").select("query_id", F.col("dense_score").alias("score"), F.coalesce("label", F.lit(0)).alias("label"))
    d = traces.select("query_id", "evidence_id", F.col("dense_rank").alias("rank"), F.col("dense_score").alias("score"))
    x = spark.read.parquet(f"{out}/traces").where("lexical_rank is not null").select("query_id", "evidence_id", F.col("lexical_rank").alias("rank"), F.col("lexical_score").alias("score"))
    known = queries if queries is not None and "answerability" in queries.columns else None
    asked = d.select("query_id").distinct()
    truth = known.select("query_id", (F.col("answerability") != "unsupported").cast("int").alias("label")) if known is not None else asked.withColumn("label", F.lit(1))
    fit = calibration.fit(pairs, lambda xs, ys, likely: calibration.query_features(d, x, xs, ys, likely).join(truth, "query_id"))
    change = {r["stage"]: r.asDict() for r in calibration.impact(d, qrels, asked, fit["relevance"]["raw_score_threshold"]).collect()}
    b, a = change["before"], change["after"]
    fit["retrieval_impact"] = change
    fit["relevance"]["enabled_for_filtering"] = calibration.filter_gate((b["ndcg_10"], a["ndcg_10"]), (b["recall_20"], a["recall_20"]))
    artifacts.write_document(spark, f"{out}/calibration.json", fit)
    _manifest(spark, out, "calibrate", {"version": fit["version"]}, {"knots": len(fit["relevance"]["x_thresholds"])})
    r = fit["relevance"]
    return {"knots": [r["x_thresholds"], r["y_thresholds"]], "threshold": r["raw_score_threshold"], **r["metrics"], **{k: fit[k] for k in ("retrieval_impact", "answerability") if k in fit}}


def audit(spark: SparkSession, out: str) -> dict:
    """Counts of records by source, of citations from elsewhere, of ids that repeat, the runs, and steps made of other evidence than there is."""
    rows = spark.read.parquet(f"{out}/evidence")
    refs = rows.select("evidence_id", F.explode("source_refs").alias("r")).select("evidence_id", "r.*")
    kind = F.when(F.col("source_file").startswith("transcripts/"), "transcripts/").otherwise(F.col("source_file"))
    by = {r["source_file"]: r["count"] for r in refs.groupBy(kind.alias("source_file")).count().collect()}  # a row for each source table
    outside = answering.boundary_breaches(refs, [f"{n}.parquet" for n in tables.REQUIRED]).count()
    try:
        told = artifacts.read_manifests(spark, f"{out}/manifests").collect()  # a row for each step
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        told = []
    now = artifacts.canonical_hash(list(map(str, _state(spark, f"{out}/evidence"))))
    stale = [r["run_id"] for r in told if r["stage"] != "prepare" and r["inputs"] != now]
    return {"sources": dict(sorted(by.items())), "outside": outside, "duplicate_ids": evidence.quality(rows).first()["duplicate_ids"], "runs": [r["run_id"] for r in told], "stale": stale}


def told(result: DataFrame | dict) -> str:
    """A result as JSON lines: of tables, one for each row (a query's hits, a few metrics)."""
    if isinstance(result, dict):
        return json.dumps(result, default=str, sort_keys=True)
    return "\n".join(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in result.toLocalIterator())
