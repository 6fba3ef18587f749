"""JSON documents with closed shapes: labels, inventories, benchmarks, reports, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OBSERVATION = "struct<role: string, channel: string, observation_time_utc: string, source_id: string>"
ANCHOR = "struct<acquisition_time_utc: string, latitude: double, longitude: double>"

#: The documents that are read, as DDL of their known columns.
SHAPES = {
    "inventory": f"schema_version int, sources array<struct<source_id: string, bucket: string, object_key: string, size_bytes: bigint, sha256: string>>, windows array<struct<window_id: string, anchor: {ANCHOR}, view_zenith_degrees: double, usable_fraction: double, observations: array<{OBSERVATION}>>>",
    "events": "schema_version int, events array<struct<event_id: string, start_time_utc: string, end_time_utc: string, centroid: struct<latitude: double, longitude: double>, detections: array<struct<acquisition_time_utc: string, latitude: double, longitude: double, confidence: string, brightness_kelvin: double, instrument: string>>>>",
    "report": "schema_version int, results array<struct<split: string, case_id: string, label: string, mode: string, outcome_state: string, reason_codes: array<string>, confidence: double, prediction: string, observation_count: int, selected_source_bytes: bigint, downloaded_bytes: bigint, latency_milliseconds: double>>",
    "tool_manifest": "schema_version int, case_id string, observations array<struct<action_type: string, observation_id: string, sources: array<struct<source_id: string, path: string, size_bytes: bigint, sha256: string>>>>",
    "case_manifest": "schema_version int, cases array<struct<case_id: string, sources: array<struct<source_id: string, object_key: string, size_bytes: bigint, sha256: string>>>>",
}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Documents of one kind; malformed JSON, another version or an unknown key raises when the rows are used."""
    shape = StructType.fromDDL(SHAPES[kind])
    text = spark.read.option("wholetext", True).text(path)
    known = F.array(*[F.lit(n) for n in shape.names])
    unknown = F.size(F.array_except(F.json_object_keys("value"), known)) > 0
    doc = F.from_json("value", shape, {"mode": "FAILFAST"})
    problem = F.when(F.try_parse_json("value").isNull(), "not JSON").when(unknown, "unknown key").when(doc["schema_version"] != 1, "version")
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit(f"{kind}: "), problem)).cast(shape)).otherwise(doc)
    return text.select(checked.alias("d")).select("d.*")


def windows(inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An inventory's windows (one row each) and their observations (one row each)."""
    w = inventory.select(F.explode("windows").alias("w")).select("w.*")
    moment = lambda c: F.to_timestamp(c)
    rows = w.select("window_id", moment(F.col("anchor.acquisition_time_utc")).alias("anchor_at"), F.col("anchor.latitude").alias("latitude"), F.col("anchor.longitude").alias("longitude"), "view_zenith_degrees", "usable_fraction")
    seen = w.select("window_id", F.explode("observations").alias("o")).select("window_id", "o.role", "o.channel", moment(F.col("o.observation_time_utc")).alias("observed_at"), "o.source_id")
    return rows, seen


def window_problems(rows: DataFrame, observations: DataFrame) -> DataFrame:
    """Windows whose four roles aren't there once each, on the right channel, and in time: initial at the anchor, baseline 30 minutes to 7 days before, later 10 to 90 minutes after, alternate within 20 minutes."""
    at = lambda role: F.max(F.when(F.col("role") == role, F.col("observed_at"))).alias(role)
    by = observations.groupBy("window_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"), F.count_if(F.col("channel") != F.when(F.col("role") == "alternate", "C14").otherwise("C07")).alias("off"), *[at(r) for r in ("baseline", "initial", "later", "alternate")])
    j = rows.join(by, "window_id", "left")
    minutes = lambda c: (F.unix_micros(c) - F.unix_micros("anchor_at")) / 60_000_000
    problem = (
        F.when(F.col("n").isNull() | (F.col("n") != 4) | (F.col("roles") != 4), "roles").when(F.col("off") > 0, "channel").when(minutes("initial") != 0, "initial").when(~(-minutes("baseline")).between(30, 7 * 24 * 60), "baseline")
        .when(~minutes("later").between(10, 90), "later").when(F.abs(minutes("alternate")) > 20, "alternate")
    )
    return j.select("window_id", problem.alias("problem")).where("problem IS NOT NULL")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
