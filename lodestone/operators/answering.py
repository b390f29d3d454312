"""Answers and their checks, model providers, training examples and run manifests."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.partition import _saved


def answer_errors(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, errors of answers (query_id, answerability, claims: array of text and citation_ids)."""
    c = answers.select("query_id", F.explode("claims").alias("c")).select("query_id", F.explode("c.citation_ids").alias("evidence_id"))
    lost = c.join(evidence.select("evidence_id"), "evidence_id", "left_anti").groupBy("query_id").agg(F.count_distinct("evidence_id").alias("lost"))
    x = answers.join(lost, "query_id", "left")
    return x.select("query_id", _answer_checks(F.col("answerability"), F.col("claims"), F.coalesce("lost", F.lit(0)) > 0).alias("errors"))


def citations(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """query_id, evidence_id, source of each citation: the first source reference."""
    c = answers.select("query_id", F.explode("claims").alias("c")).select("query_id", F.explode("c.citation_ids").alias("evidence_id")).distinct()
    return c.join(refs.select("evidence_id", F.get("source_refs", F.lit(0)).alias("source")), "evidence_id")


def answer_metrics(answers: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id and seven metrics of each answer to a known query.

    answers: query_id, answerability, temporal_mode, claims (text, citation_ids), valid, validation_errors;
    queries: query_id, answerability, temporal_mode, claim_texts.
    """
    from lodestone.operators.metrics import semantic_coverage

    c = answers.select("query_id", F.explode("claims").alias("c")).select("query_id", F.explode("c.citation_ids").alias("evidence_id")).distinct()
    good = qrels.where("grade > 0").select("query_id", "evidence_id", F.lit(1).alias("ok"))
    by = c.join(good, ["query_id", "evidence_id"], "left").groupBy("query_id").agg(F.count("*").alias("cited"), F.count("ok").alias("right"))
    need = good.groupBy("query_id").agg(F.count("*").alias("relevant"))
    truth = queries.select("query_id", F.col("answerability").alias("truth"), F.col("temporal_mode").alias("mode"), F.size("claim_texts").alias("wanted"))
    wanted = queries.join(answers.select("query_id"), "query_id", "left_semi").select("query_id", F.explode("claim_texts").alias("text"))
    told = semantic_coverage(wanted, answers.select("query_id", F.explode("claims").alias("c")).select("query_id", F.col("c.text").alias("text")))
    x = answers.join(truth, "query_id").join(by, "query_id", "left").join(need, "query_id", "left").join(told, "query_id", "left").fillna(0, ["cited", "right", "relevant"])
    share = lambda a, b, none: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(none)
    late = F.exists("validation_errors", lambda e: F.lower(e).contains("temporal"))
    return x.select(
        "query_id",
        F.when(F.col("wanted") > 0, F.coalesce("claim_coverage", F.lit(0.0))).otherwise(1.0).alias("claim_coverage"),
        share("right", "cited", F.when(F.col("relevant") > 0, 0.0).otherwise(1.0)).alias("citation_precision"),
        share("right", "relevant", F.lit(1.0)).alias("citation_recall"),
        F.col("valid").cast("double").alias("groundedness"),
        (F.col("answerability") == F.col("truth")).cast("double").alias("answerability_correct"),
        ((F.col("truth") == "unsupported") & (F.size("claims") > 0)).cast("double").alias("unsupported_false_answer"),
        ((F.col("temporal_mode") == F.col("mode")) & ~F.coalesce(late, F.lit(False))).cast("double").alias("temporal_correctness"),
    )


Provider = Callable[[dict], dict]


def offline(request: dict) -> dict:
    """A provider for use without a model: supported if there is context, citing all of it."""
    ids = request.get("evidence_ids") or []
    if not ids:
        return {"answerability": "unsupported", "claims": []}
    return {"answerability": "supported", "claims": [{"text": str(request.get("query", "")), "citation_ids": list(ids)}]}


#: What a message or status of a failed call must hold for another try to help.
PASSING = ("408", "409", "429", "500", "502", "503", "504", "timeout", "timed out")


def strict_schema(schema: dict) -> dict:
    """The JSON schema as strict providers want it: references written out, all properties required, no others."""
    known = schema.get("$defs", {})

    def strict(node: object) -> object:
        if isinstance(node, list):
            return [strict(x) for x in node]
        if not isinstance(node, dict):
            return node
        if str(node.get("$ref", "")).startswith("#/$defs/"):
            name = node["$ref"].rsplit("/", 1)[1]
            if name not in known:
                raise ValueError(f"the schema lacks {name}")
            return strict(known[name])
        out = {k: v for k, v in node.items() if k not in ("default", "$defs")}
        if isinstance(node.get("properties"), dict) or node.get("type") == "object":
            # maps of any keys have none
            out["properties"] = node.get("properties") if isinstance(node.get("properties"), dict) else {}
            out |= {"required": list(out["properties"]), "additionalProperties": False}
        return {k: ({n: strict(x) for n, x in v.items()} if k == "properties" else v if k == "required" else strict(v)) for k, v in out.items()}

    return strict(schema)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


def misfit(value: object, schema: dict, at: str = "response") -> str | None:
    """Where a value isn't as the JSON schema says (types, enum, bounds, required and further properties, items); None if it is.

    An object without properties is a map of any keys.
    """
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return f"{at} isn't of type {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at} is none of {schema['enum']}"
    if isinstance(value, int | float) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{at} is out of bounds"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if lacking := [k for k in schema.get("required", []) if k not in value]:
            return f"{at} lacks {', '.join(lacking)}"
        if known and schema.get("additionalProperties") is False and (more := sorted(set(value) - set(known) - {"_usage"})):
            return f"{at} has {', '.join(more)}"
        parts = [(value[k], known[k], f"{at}.{k}") for k in known if k in value]
    else:
        parts = [(x, schema["items"], f"{at}[{k}]") for k, x in enumerate(value)] if isinstance(value, list) and "items" in schema else []
    return next((m for m in (misfit(*x) for x in parts) if m), None)


def _called(provider: Provider, request: str, retries: int, wait: float, required: tuple[str, ...], schema: dict | None = None) -> tuple[str | None, str | None, int]:
    """response, error, calls; errors that pass are tried again after waits that double, up to half a minute."""
    calls = 0
    while True:
        calls += 1
        try:
            response = provider(json.loads(request))
            if lacking := [k for k in required if k not in response]:
                raise ValueError(f"the response lacks {', '.join(lacking)}")
            if schema and (wrong := misfit(response, schema)):
                raise ValueError(wrong)
            return json.dumps(response, sort_keys=True), None, calls
        except Exception as e:  # a value for the caller, as one bad request must not end the batch
            passing = not isinstance(e, ValueError | KeyError | TypeError) or any(x in str(e).lower() for x in PASSING)
            if calls > retries or not passing:
                return None, str(e), calls
            time.sleep(min(wait * 2 ** (calls - 1), 30.0))


def complete(requests: DataFrame, provider: Provider = offline, retries: int = 3, key: str = "query_id", wait: float = 0.0, at_once: int = 4, required: tuple[str, ...] = (), schema: dict | None = None) -> DataFrame:
    """key, response, error, calls of requests (key, request as JSON), ``at_once`` of a task's at a time; checked by ``schema``.

    A call that fails is made again, ``retries`` times at most, unless its error is of the request or the response itself.
    """

    strict = strict_schema(schema) if schema else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as threads:
            for f in frames:
                for k in range(0, len(f), 16 * at_once):
                    part = f.iloc[k : k + 16 * at_once]
                    found = list(threads.map(lambda r: _called(provider, r, retries, wait, required, strict), part["request"]))
                    yield pd.DataFrame({key: part[key].to_numpy(), "response": [x[0] for x in found], "error": [x[1] for x in found], "calls": [x[2] for x in found]})

    return requests.select(key, "request").mapInPandas(run, f"{key} {dict(requests.dtypes)[key]}, response string, error string, calls int")


ANSWER = "struct<answerability:string,temporal_mode:string,answer:string,limitations:array<string>,claims:array<struct<text:string,citation_ids:array<string>>>>"


def answer_queries(asked: DataFrame, evidence: DataFrame, provider: Provider = offline, validator: Provider | None = None, regenerations: int = 3, cache: str | None = None) -> DataFrame:
    """Answers of questions (query_id, query, mode, evidence_ids), made again while their checks fail, ``regenerations`` times at most.

    Questions without evidence are unsupported, and valid, without a call. A round asks the provider for all open questions, with the
    errors of the round before, and checks citations against what was shown; the last answer stands, valid or not. Calls go through the
    table ``cache``, where one is named.
    """
    call = lambda rows, p, stage: cached_complete(rows, cache, p, stage=stage) if cache else complete(rows, p)
    empty = F.from_json(F.lit('{"answerability":"unsupported","claims":[],"limitations":["no evidence"]}'), ANSWER)
    shape = lambda df, answer, valid, errors: df.select("query_id", answer.alias("a"), valid.alias("valid"), errors.alias("validation_errors"), "mode")
    no_errors = F.array().cast("array<string>")
    out = shape(asked.where(F.size("evidence_ids") == 0), empty, F.lit(True), no_errors)
    open_ = _saved(asked.where(F.size("evidence_ids") > 0).select("query_id", "query", "mode", "evidence_ids", no_errors.alias("errors")))
    done = []
    for attempt in range(regenerations + 1):
        request = F.to_json(F.struct("query", F.col("mode").alias("temporal_mode"), "evidence_ids", F.col("errors").alias("previous_errors"), F.lit(attempt).alias("attempt")))
        got = call(open_.select("query_id", request.alias("request")), provider, "answer").join(open_, "query_id")
        got = got.withColumn("a", F.coalesce(F.from_json("response", ANSWER), empty))
        shown = got.select("query_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id"), "evidence_id", "left_semi").groupBy("query_id").agg(F.collect_set("evidence_id").alias("shown"))
        got = got.join(shown, "query_id", "left").withColumn("claims", F.coalesce(F.col("a.claims"), F.array().cast("array<struct<text:string,citation_ids:array<string>>>")))
        bad = _answer_checks(F.col("a.answerability"), F.col("claims"), F.exists("claims", lambda c: F.size(F.array_except(c["citation_ids"], F.coalesce("shown", no_errors))) > 0))
        failed = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("provider: "), "error"))).otherwise(bad)
        got = _saved(got.withColumn("errors", failed).select("query_id", "query", "mode", "evidence_ids", "a", "errors"))
        if validator:
            told = call(got.where(F.size("errors") == 0).select("query_id", F.to_json(F.struct("query", "a", "evidence_ids")).alias("request")), validator, "validate")
            told = told.select("query_id", F.coalesce(F.from_json(F.get_json_object("response", "$.errors"), "array<string>"), no_errors).alias("more"))
            got = _saved(got.join(told, "query_id", "left").withColumn("errors", F.concat("errors", F.coalesce("more", no_errors))).drop("more"))
        last = attempt == regenerations
        good = got if last else got.where(F.size("errors") == 0)
        done.append(shape(good, F.col("a"), F.size("errors") == 0, F.col("errors")))
        if last:
            break
        open_ = got.where(F.size("errors") > 0).select("query_id", "query", "mode", "evidence_ids", "errors")
        if not open_.limit(1).count():
            break
    for x in done:
        out = out.unionByName(x)
    claims = F.coalesce(F.col("a.claims"), F.array().cast("array<struct<text:string,citation_ids:array<string>>>"))
    return out.select("query_id", F.col("a.answerability").alias("answerability"), F.coalesce(F.col("a.temporal_mode"), "mode").alias("temporal_mode"), claims.alias("claims"), F.col("a.answer").alias("answer"), F.coalesce(F.col("a.limitations"), no_errors).alias("limitations"), "valid", "validation_errors")


def _answer_checks(answerability, claims, lost):
    n = F.size(claims)
    checks = [
        ("missing_citation", F.coalesce(lost, F.lit(False))),
        ("unsupported_with_claims", (answerability == "unsupported") & (n > 0)),
        ("supported_without_claims", (answerability != "unsupported") & (n == 0)),
        ("uncited_claim", F.exists(claims, lambda q: F.size(q["citation_ids"]) == 0)),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))


CACHE = "request_hash string, stage string, response string, tokens long, cost double, part string"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """What calls have brought: request_hash, stage, response, tokens, cost, and part, the start of the hash."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def cached_complete(requests: DataFrame, cache: str, provider: Provider = offline, key: str = "query_id", stage: str = "", schema: dict | None = None, **options) -> DataFrame:
    """key, response, error, calls of requests: responses that the table ``cache`` has need no call, new ones are added to it.

    A request's hash covers its text, the stage and the schema, so a change of any of them asks anew. The table lies by the start of
    the hash, and the join reads the starts that are asked for. Equal requests are one call; a failed call isn't kept. What a
    response has under ``_usage`` (total_tokens, cost) is kept beside it.
    """
    spark = requests.sparkSession
    told = json.dumps({"stage": stage, "schema": strict_schema(schema) if schema else None}, sort_keys=True)
    asked = requests.select(key, "request", F.sha2(F.concat_ws("\n", F.lit(told), "request"), 256).alias("request_hash"))
    asked = _saved(asked.withColumn("part", F.left("request_hash", F.lit(2))))
    known = read_cache(spark, cache).join(asked.select("part", "request_hash").distinct(), ["part", "request_hash"], "left_semi").dropDuplicates(["request_hash"])
    known = _saved(known.select("request_hash", "response"))
    new = asked.join(known, "request_hash", "left_anti").select("request_hash", "request").distinct()
    fresh = complete(new, provider, key="request_hash", schema=schema, **options)
    used = lambda path, kind: F.coalesce(F.get_json_object("response", path).cast(kind), F.lit(0).cast(kind))
    fresh = _saved(fresh.select("*", used("$._usage.total_tokens", "long").alias("tokens"), used("$._usage.cost", "double").alias("cost")))
    good = fresh.where("response is not null").select("request_hash", F.lit(stage).alias("stage"), "response", "tokens", "cost", F.left("request_hash", F.lit(2)).alias("part"))
    if good.limit(1).count():
        good.write.partitionBy("part").mode("append").parquet(cache)
    had = known.select("request_hash", "response", F.lit(None).cast("string").alias("error"), F.lit(0).alias("calls"))
    return asked.select(key, "request_hash").join(had.unionByName(fresh.select("request_hash", "response", "error", "calls")), "request_hash").drop("request_hash")


def missing_answers(queries: DataFrame, answers: DataFrame) -> DataFrame:
    return queries.select("query_id").join(answers.where("valid").select("query_id"), "query_id", "left_anti")


def training_triples(queries: DataFrame, qrels: DataFrame, negatives: int = 3) -> DataFrame:
    """query_id, positive_id, negative_ids, excluded_positive_ids: each positive with up to three judged zero, in order of id.

    Where queries have ``positive_ids``, these are the positives that no judgment calls zero; else grades of two and more. What is
    related is never a negative, and the others that are related are named, for batches to keep apart.
    """
    pos, related = _positives(queries, qrels)
    w = Window.partitionBy("query_id").orderBy("evidence_id")
    neg = qrels.where("grade = 0").join(related, ["query_id", "evidence_id"], "left_anti").withColumn("r", F.row_number().over(w)).where(F.col("r") <= negatives)
    neg = neg.groupBy("query_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("negative_ids"))
    others = related.groupBy("query_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("related"))
    return pos.join(neg, "query_id").join(others, "query_id").select("query_id", "positive_id", "negative_ids", F.array_except("related", F.array("positive_id")).alias("excluded_positive_ids"))


def training_families(queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same examples (query_id, positive_id), and what is related (query_id, item), each named once and not with each example."""
    pos, related = _positives(queries, qrels)
    judged = qrels.where("grade = 0").join(related, ["query_id", "evidence_id"], "left_anti").select("query_id").distinct()
    return pos.join(judged, "query_id", "left_semi"), related.withColumnRenamed("evidence_id", "item")


def _positives(queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, positive_id of examples, and query_id, evidence_id of all that is related."""
    if "positive_ids" in queries.columns:
        named = queries.select("query_id", F.explode(F.array_distinct("positive_ids")).alias("evidence_id")).join(qrels.select("query_id", "evidence_id", "grade"), ["query_id", "evidence_id"], "left")
        pos = named.where("coalesce(grade, 3) > 0").select("query_id", F.col("evidence_id").alias("positive_id"))
    else:
        pos = qrels.where("grade >= 2").join(queries.select("query_id"), "query_id", "left_semi").select("query_id", F.col("evidence_id").alias("positive_id"))
    related = qrels.where("grade > 0").select("query_id", "evidence_id").union(pos).distinct()
    return pos, related


def isolation_breaches(examples: DataFrame, queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Examples whose query or evidence isn't of the training partition."""
    x = examples.join(queries.select("query_id", F.col("partition").alias("qp")), "query_id").join(evidence.select(F.col("evidence_id").alias("positive_id"), F.col("partition").alias("ep")), "positive_id")
    return x.where("qp != 'train' or ep != 'train'").select("query_id", "positive_id")


def usage(calls: DataFrame) -> DataFrame:
    """stage (null: all), requests, tokens, cost."""
    return calls.rollup("stage").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def file_state(spark, folder: str) -> DataFrame:
    """path, size and time of files, to tell that a run left its inputs alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), "modificationTime")


def boundary_breaches(refs: DataFrame, allowed: list[str]) -> DataFrame:
    """References to files outside the data: neither an allowed table nor a transcript."""
    return refs.where(~F.col("source_file").isin(*allowed) & ~F.col("source_file").startswith("transcripts/"))
