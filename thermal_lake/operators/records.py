"""Typed records, their links, canonical JSON and content hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from thermal_lake.functions import checks

VERSION = 1


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, L, D, A = StringType(), LongType(), DoubleType(), ArrayType(StringType())
PLACE = _struct(latitude=D, longitude=D)
MEASUREMENT = _struct(name=S, value=D, unit=S, missing_reason=S)
CONFIGURATION = _struct(configuration_id=S, sha256=S)
HEAD = {"schema_version": L, "record_type": S}

#: The eight kinds of records by record_type.
SCHEMAS = {
    "manifest_case": _struct(**HEAD, case_id=S, anchor=PLACE, anchor_time_utc=S, allowed_observation_ids=A),
    "observation_request": _struct(**HEAD, observation_id=S, case_id=S, requested_time_utc=S, channel=S),
    "source_object": _struct(**HEAD, source_id=S, observation_id=S, bucket=S, object_key=S, size_bytes=L, sha256=S, scan_start_utc=S, scan_end_utc=S),
    "vision_evidence": _struct(**HEAD, evidence_id=S, case_id=S, observation_id=S, source_id=S, configuration=CONFIGURATION, measurements=ArrayType(MEASUREMENT), reason_codes=A, confidence=D),
    "action": _struct(**HEAD, action_id=S, case_id=S, action_type=S, observation_id=S, evidence_ids=A, reason=S),
    "budget": _struct(**HEAD, **{f"{u}_{r}": (D if r == "elapsed_seconds" else L) for r in ("observations", "bytes", "elapsed_seconds", "retries") for u in ("max", "used")}),
    "outcome": _struct(**HEAD, outcome_id=S, trace_id=S, case_id=S, state=S, confidence=D, reason_codes=A, evidence_ids=A, configuration=CONFIGURATION),
    "trace": _struct(**HEAD, trace_id=S, case_id=S, configuration=CONFIGURATION, observation_ids=A, source_ids=A, evidence_ids=A, action_ids=A, outcome_id=S),
}


def parse(df: DataFrame, kind: str, text: str = "value") -> DataFrame:
    """Documents of one kind as columns, with error: not an object, unknown or missing keys, wrong version or kind, or a value outside its domain."""
    schema = SCHEMAS[kind]
    names = F.array(*[F.lit(f.name) for f in schema])
    keys = F.json_object_keys(text)
    r = df.withColumn("_r", F.from_json(text, schema)).withColumn("_k", keys)
    shape = (
        F.when(F.col("_k").isNull(), "not an object").when(F.size(F.array_except("_k", names)) > 0, "unknown key").when(F.size(F.array_except(names, F.col("_k"))) > 0, "missing key")
        .when(F.col("schema_version") != VERSION, "version").when(F.col("record_type") != kind, "kind")
    )
    r = r.select("*", "_r.*").drop("_r")
    return r.withColumn("error", F.coalesce(shape, F.when(~domain(kind), "domain"))).drop("_k")


def domain(kind: str) -> Column:
    """Whether a record's values are in their domains."""
    c = F.col
    ident = lambda *names: [checks.is_identifier(c(n)) for n in names]
    moment = lambda n: checks.present(F.try_to_timestamp(c(n)).isNotNull() & c(n).endswith("Z"))
    rules = {
        "manifest_case": [*ident("case_id"), checks.is_between(c("anchor.latitude"), -90, 90), checks.is_between(c("anchor.longitude"), -180, 180), moment("anchor_time_utc"), checks.all_distinct(c("allowed_observation_ids"))],
        "observation_request": [*ident("observation_id", "case_id"), moment("requested_time_utc"), checks.is_one_of(c("channel"), checks.CHANNELS)],
        "source_object": [*ident("source_id", "observation_id"), checks.is_text(c("bucket")), checks.is_text(c("object_key")), checks.is_count(c("size_bytes"), 1), checks.is_sha256(c("sha256")), moment("scan_start_utc"), moment("scan_end_utc")],
        "vision_evidence": [*ident("evidence_id", "case_id", "observation_id", "source_id"), checks.are_reasons(c("reason_codes")), checks.is_between(c("confidence"), 0, 1), checks.present(F.forall("measurements", lambda m: checks.measurement_ok(m["value"], m["missing_reason"]) & checks.is_one_of(m["unit"], checks.UNITS)))],
        "action": [*ident("action_id", "case_id"), checks.is_one_of(c("action_type"), checks.ACTIONS), c("observation_id").isNotNull() == c("action_type").isin(*checks.OBSERVATION_ACTIONS), checks.all_distinct(c("evidence_ids"))],
        "budget": [checks.within_budget()],
        "outcome": [*ident("outcome_id", "trace_id", "case_id"), checks.is_one_of(c("state"), checks.OUTCOMES), checks.is_between(c("confidence"), 0, 1), checks.are_reasons(c("reason_codes")), checks.all_distinct(c("evidence_ids"))],
        "trace": [*ident("trace_id", "case_id", "outcome_id"), *[checks.all_distinct(c(f"{x}_ids")) for x in ("observation", "source", "evidence", "action")], checks.present((F.size("observation_ids") > 0) & (F.size("evidence_ids") > 0))],
    }[kind]
    out = F.lit(True)
    for r in rules:
        out = out & checks.present(r)
    return out


def broken_links(children: DataFrame, child: str, parents: DataFrame, link: str, same: str | None = None) -> DataFrame:
    """Children whose parent is missing (link: the column's name without _id), or disagrees in the column `same`."""
    p = parents.select(F.col(link).alias("_p"), *([F.col(same).alias("_same")] if same else []))
    joined = children.join(p, F.col(link) == F.col("_p"), "left")
    name = link.removesuffix("_id")
    missing = joined.where("_p IS NULL").select(child, F.lit(name).alias("link"))
    if not same:
        return missing
    return missing.unionByName(joined.where(F.col("_p").isNotNull() & (F.col("_same") != F.col(same))).select(child, F.lit(same.removesuffix("_id")).alias("link")))


def not_subset(df: DataFrame, part: str, whole: str) -> DataFrame:
    """Rows whose array `part` holds something that `whole` doesn't, with what."""
    return df.withColumn("outside", F.array_except(part, whole)).where(F.size("outside") > 0)


def trace_problems(traces: DataFrame, cases: DataFrame, requests: DataFrame, sources: DataFrame, evidence: DataFrame, actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(trace_id, problem) for every broken link of traces; empty if all hold. Joins only, so it takes any number of traces."""
    t = traces.select("trace_id", "case_id", "configuration")
    item = lambda ids, name: traces.select("trace_id", F.col("case_id").alias("trace_case"), F.col("configuration").alias("trace_configuration"), F.explode(ids).alias(name))
    say = lambda df, text: df.select("trace_id", F.lit(text).alias("problem"))
    req = item("observation_ids", "observation_id").join(requests.select("observation_id", F.col("case_id").alias("c")), "observation_id", "left")
    allowed = cases.select(F.col("case_id").alias("trace_case"), "allowed_observation_ids")
    src = item("source_ids", "source_id").join(sources.select("source_id", "observation_id"), "source_id", "left").join(traces.select("trace_id", "observation_ids"), "trace_id")
    ev = item("evidence_ids", "evidence_id").join(evidence.select("evidence_id", F.col("case_id").alias("c"), "observation_id", "source_id", "configuration"), "evidence_id", "left").join(traces.select("trace_id", "observation_ids", "source_ids"), "trace_id")
    act = item("action_ids", "action_id").join(actions.select("action_id", F.col("case_id").alias("c"), F.col("evidence_ids").alias("seen")), "action_id", "left").join(traces.select("trace_id", "evidence_ids"), "trace_id")
    out = traces.join(outcomes.select("outcome_id", F.col("trace_id").alias("t"), F.col("case_id").alias("c"), F.col("evidence_ids").alias("seen"), F.col("configuration").alias("conf")), "outcome_id", "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    parts = [
        say(req.where(differs("c", "trace_case")), "request of another case"),
        say(req.join(allowed, "trace_case", "left").where(~checks.present(F.expr("array_contains(allowed_observation_ids, observation_id)"))), "request not allowed"),
        say(src.where(~checks.present(F.expr("array_contains(observation_ids, observation_id)"))), "source without a request"),
        say(ev.where(differs("c", "trace_case")), "evidence of another case"), say(ev.where(~checks.present(F.expr("array_contains(observation_ids, observation_id)"))), "evidence without a request"),
        say(ev.where(~checks.present(F.expr("array_contains(source_ids, source_id)"))), "evidence without a source"), say(ev.where(differs("configuration", "trace_configuration")), "evidence of another configuration"),
        say(act.where(differs("c", "trace_case")), "action of another case"), say(act.where(F.size(F.array_except("seen", "evidence_ids")) > 0), "action on unknown evidence"),
        say(out.where(differs("t", "trace_id")), "outcome of another trace"), say(out.where(differs("c", "case_id")), "outcome of another case"), say(out.where(F.size(F.array_except("seen", "evidence_ids")) > 0), "outcome on unknown evidence"), say(out.where(differs("conf", "configuration")), "outcome of another configuration"),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(t.select("trace_id"), "trace_id", "left_semi").distinct()


def canonical(value: object, ascii_only: bool = True, newline: bool = False) -> str:
    """JSON with sorted keys and no spaces; NaN and infinities raise."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False) + "\n" * newline


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON text in its canonical form (null if it isn't JSON)."""

    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return texts.map(one)


def content_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def sealed(payload: dict) -> dict:
    """A payload with the hash of its canonical form."""
    return payload | {"content_sha256": hashlib.sha256(canonical(payload).encode()).hexdigest()}


def seal_holds(payload: dict) -> bool:
    body = {k: v for k, v in payload.items() if k != "content_sha256"}
    return payload.get("content_sha256") == sealed(body)["content_sha256"]


def content_directory(root: str, case_id: str, digest: str) -> str:
    if len(digest) != 64 or any(x in case_id for x in "/\\.") or not case_id:
        raise ValueError("neither a case nor a digest")
    return f"{root.rstrip('/')}/{case_id}/{digest}"
