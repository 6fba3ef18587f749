"""Queries: tracking, decisions, evaluation, splits, journals and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermal_lake import bindings as b
from thermal_lake.functions import checks
from thermal_lake.functions.rounding import python_round_sql
from thermal_lake.operators import decide, evaluate, graph, track
from thermal_lake.operators import raster as r
from thermal_lake.plans.raster_queries import COMPONENTS, MASKS, QUALITY, SMALL
from thermal_lake.sources import journal

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Tracking. A case is eight frames in a row.


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = r.anomaly_components(r.anomaly_tiles(b.pixels(spark, sf_dir)), SMALL)
    mean = lambda f: F.aggregate(F.transform("cells", f), F.lit(0.0), lambda a, x: a + x) / F.size("cells")
    return c.select(
        F.expr("frame_id div 8").alias("case_id"), (F.col("frame_id") % 8).cast("int").alias("step"), "label", "area", "cells", (30 + mean(lambda x: F.floor(x / 8).cast("double")) * 0.01).alias("lat"),
        (-120 + mean(lambda x: (x % 8).cast("double")) * 0.01).alias("lon"), F.col("mean_contrast").alias("temperature"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "embeddings").selectExpr("vec_id div 8 AS case_id", "cast(vec_id % 8 AS int) AS step", "vec_id % 29 = 5 AS missing")


@query("frame_overlap_iou", f"""
    WITH RECURSIVE {b.PIXELS}, {MASKS}, {COMPONENTS}, c AS (SELECT frame_id // 8 AS case_id, frame_id % 8 AS step, root, row * 8 + col AS cell FROM cp), n AS (SELECT case_id, step, root, count(*) AS n FROM c GROUP BY ALL)
    SELECT a.case_id, CAST(a.step AS INTEGER) AS step, count(*) AS shared, round(count(*)::DOUBLE / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS iou FROM c a JOIN c b ON b.case_id = a.case_id AND b.step = a.step + 1 AND b.cell = a.cell
        JOIN n na ON na.case_id = a.case_id AND na.step = a.step AND na.root = a.root JOIN n nb ON nb.case_id = b.case_id AND nb.step = b.step AND nb.root = b.root GROUP BY a.case_id, a.step, a.root, b.root
""")  # fmt: skip
def frame_overlap_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = regions(spark, sf_dir).select("case_id", "step", "label", F.explode("cells").alias("cell"))
    return track.overlaps(cells).select("case_id", "step", "shared", F.round("iou", 6).alias("iou"))


@query("region_tracks")
def region_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.tracks(frames(spark, sf_dir), regions(spark, sf_dir))


@query("persistence_summary")
def persistence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return track.persistence(f, track.tracks(f, regions(spark, sf_dir)))


#: Each frame on a grid that is shifted by a third of a pixel.
REGRID = f"""
    WITH {b.PIXELS}, s AS (SELECT frame_id, CAST(row * 8 + col AS BIGINT) AS source, 30 + row * 0.01::DOUBLE AS lat, -120 + col * 0.01::DOUBLE AS lon, v7::DOUBLE AS value, NOT invalid AS valid FROM px),
    t AS (SELECT frame_id, source AS target, lat + 0.0033::DOUBLE AS lat, lon + 0.0137::DOUBLE AS lon FROM s),
    d AS (SELECT t.frame_id, t.target, s.source, s.value, s.valid, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(s.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - t.lon) / 2), 2))) AS km FROM t JOIN s USING (frame_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, target ORDER BY km, source) AS k FROM d WHERE km <= 2)
    SELECT t.frame_id, t.target, round(CASE WHEN k.valid THEN k.value END, 4) AS value, coalesce(k.valid, false) AS valid FROM t LEFT JOIN k ON k.frame_id = t.frame_id AND k.target = t.target AND k.k = 1
"""


@query("regrid_nearest", REGRID)
def regrid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame on a grid that is shifted by a third of a pixel."""
    p = b.pixels(spark, sf_dir).selectExpr("frame_id", "row", "col", "cast(v7 AS double) AS value", "NOT invalid AS valid", "30 + row * 0.01D AS lat", "-120 + col * 0.01D AS lon")
    tiles = r.tiles(p, ["lat", "lon", "value", "valid"], ["frame_id"])
    shift = lambda c, by: F.transform(c, lambda x: x + by)
    found = track.regrid(tiles, tiles.select("frame_id", shift("lat", 0.0033).alias("lat"), shift("lon", 0.0137).alias("lon")), ["frame_id"], 2.0)
    return found.select("frame_id", F.posexplode(F.arrays_zip("value", "valid")).alias("target", "p")).select("frame_id", F.col("target").cast("long").alias("target"), F.round("p.value", 4).alias("value"), F.col("p.valid").alias("valid"))


@query("regrid_nearest_pixels", REGRID)
def regrid_nearest_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.pixels(spark, sf_dir).selectExpr("frame_id", "cast(row * 8 + col AS bigint) AS source", "30 + row * 0.01D AS lat", "-120 + col * 0.01D AS lon", "cast(v7 AS double) AS value", "NOT invalid AS valid")
    t = s.selectExpr("frame_id", "source AS target", "lat + 0.0033D AS lat", "lon + 0.0137D AS lon")
    return track.regrid_pixels(s, t, "frame_id", 2.0).select("frame_id", "target", F.round("value", 4).alias("value"), "valid")


# Decisions over facts that stand in for evidence packets

FACTS = [
    "doc_id AS case_id", "doc_id % 4 AS persistence_count", "cast(doc_id % 11 AS double) / 10 AS persistence_confidence", "doc_id % 3 AS candidate_region_count", "1 + doc_id % 3 AS usable_observation_count", "doc_id % 41 = 0 AS budget_exhausted",
    "cast(1 + doc_id % 4 AS int) AS max_observations", "cast(doc_id % 3 AS int) AS used_observations", "1000 AS max_bytes", "cast((doc_id * 7) % 1100 AS int) AS used_bytes", "120.0 AS max_elapsed_seconds", "cast(doc_id % 130 AS double) AS used_elapsed_seconds",
    "1 AS max_retries", "cast(doc_id % 2 AS int) AS used_retries",
]
CODES = [("doc_id % 5 = 1", "coverage_insufficient"), ("doc_id % 7 = 2", "contrast_low"), ("doc_id % 13 = 3", "bands_conflict"), ("doc_id % 17 = 4", "alignment_failed"), ("doc_id % 19 = 5", "source_missing"), ("doc_id % 6 = 0", "no_persistent_evidence")]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents")
    codes = "array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in CODES) + "))"
    actions = "filter(array(named_struct('action_type', 'next_timestamp', 'observation_id', 'later'), named_struct('action_type', 'alternate_band', 'observation_id', 'alternate'), named_struct('action_type', 'pre_event_baseline', 'observation_id', 'baseline')), (a, i) -> shiftright(doc_id, i) % 2 = 0)"
    return d.selectExpr(*FACTS, f"{codes} AS reason_codes", f"{actions} AS available", "CASE WHEN doc_id % 23 = 0 THEN false WHEN doc_id % 2 = 0 THEN true END AS last_accepted")


HAS = {v: f"({c})" for c, v in CODES}
FACTS_SQL = "f AS (SELECT doc_id, " + ", ".join(FACTS) + ", " + ", ".join(f"{c} AS {v}" for v, c in HAS.items()) + ", doc_id % 2 = 0 AS a_next, (doc_id >> 1) % 2 = 0 AS a_band, (doc_id >> 2) % 2 = 0 AS a_base FROM documents)"
OUTCOME = """
    o AS (SELECT *, CASE WHEN source_missing THEN 'failed' WHEN budget_exhausted OR coverage_insufficient OR contrast_low OR alignment_failed THEN 'insufficient_evidence' WHEN bands_conflict THEN 'human_review'
        WHEN usable_observation_count < 2 THEN 'insufficient_evidence' WHEN persistence_count >= 2 AND persistence_confidence >= 0.5 THEN 'review_escalation' ELSE 'no_persistent_evidence' END AS outcome FROM f)
"""


@query("outcome_calibration", f"""
    WITH {FACTS_SQL}, {OUTCOME} SELECT case_id, outcome, CASE outcome WHEN 'insufficient_evidence' THEN least(persistence_confidence, 0.49) WHEN 'review_escalation' THEN persistence_confidence ELSE 0.0 END::DOUBLE AS outcome_confidence,
        CASE outcome WHEN 'review_escalation' THEN 'positive' WHEN 'no_persistent_evidence' THEN 'control' END AS prediction FROM o
""")  # fmt: skip
def outcome_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = decide.calibrate(facts(spark, sf_dir))
    return o.select("case_id", "outcome", "outcome_confidence", decide.prediction(F.col("outcome")).alias("prediction"))


def _case(values: dict[str, str], of: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE {of} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + " END"


@query("outcome_explanations", f"""
    WITH {FACTS_SQL}, {OUTCOME}, r AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {v} THEN '{v}' END" for v in HAS)}], lambda x: x IS NOT NULL) AS base FROM o),
    e AS (SELECT outcome, list_concat(base, CASE WHEN outcome = 'failed' THEN [] WHEN budget_exhausted THEN ['budget_exhausted', 'insufficient_evidence'] WHEN outcome = 'insufficient_evidence' THEN ['insufficient_evidence'] WHEN outcome = 'human_review' THEN ['human_review_required']
        WHEN outcome = 'review_escalation' THEN ['thermal_evidence_persistent', 'human_review_required'] WHEN candidate_region_count = 0 THEN ['thermal_evidence_absent', 'no_persistent_evidence'] ELSE ['thermal_anomaly_weak', 'no_persistent_evidence'] END) AS every FROM r),
    d AS (SELECT outcome, list_filter(every, lambda x, i: list_position(every, x) = i) AS codes FROM e)
    SELECT outcome, array_to_string(codes, ',') AS outcome_reasons, {_case(decide.OUTCOME_TEXT, 'outcome')} || ' ' || array_to_string(list_transform(codes, lambda x: {_case(decide.REASON_TEXT, 'x')}), ' ') AS explanation, count(*) AS cases FROM d GROUP BY ALL
""")  # fmt: skip
def outcome_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decide.calibrate(facts(spark, sf_dir)).withColumn("outcome_reasons", F.array_join("outcome_reasons", ","))
    return found.groupBy("outcome", "outcome_reasons", "explanation").agg(F.count("*").alias("cases"))


POLICY = """
    c AS (SELECT *, coverage_insufficient OR alignment_failed AS poor, used_observations >= max_observations OR used_bytes >= max_bytes OR used_elapsed_seconds >= max_elapsed_seconds AS spent FROM f),
    p AS (SELECT *, CASE WHEN doc_id % 23 = 0 THEN 'tool_failure_abstain' WHEN spent THEN 'budget_exhausted_abstain' WHEN poor AND used_retries >= max_retries AND (a_next OR a_band OR a_base) THEN 'recovery_retry_exhausted_abstain'
        WHEN poor THEN CASE WHEN a_next OR a_band OR a_base THEN 'poor_quality_retry' ELSE 'no_followup_abstain' END WHEN bands_conflict THEN CASE WHEN a_band OR a_next THEN 'bands_conflict_alternate' ELSE 'no_followup_abstain' END
        WHEN persistence_count >= 2 AND persistence_confidence >= 0.5 THEN 'persistent_evidence_review' WHEN no_persistent_evidence THEN 'absent_persistence_finalize'
        WHEN contrast_low THEN CASE WHEN a_next OR a_base THEN 'weak_contextual_followup' ELSE 'no_followup_abstain' END ELSE CASE WHEN a_next OR a_base THEN 'no_decisive_evidence_followup' ELSE 'no_followup_abstain' END END AS rule FROM c)
"""


@query("policy_decision", f"""
    WITH {FACTS_SQL}, {POLICY} SELECT case_id, rule, CASE WHEN rule = 'persistent_evidence_review' THEN 'request_human_review' WHEN rule = 'absent_persistence_finalize' THEN 'finalize' WHEN rule LIKE '%abstain' THEN 'abstain'
        WHEN rule = 'bands_conflict_alternate' THEN CASE WHEN a_band THEN 'alternate_band' ELSE 'next_timestamp' END WHEN a_next THEN 'next_timestamp' WHEN rule = 'poor_quality_retry' AND a_band THEN 'alternate_band' ELSE 'pre_event_baseline' END AS action_type,
        3 + a_next::INTEGER + a_band::INTEGER + a_base::INTEGER AS considered_count FROM p
""")  # fmt: skip
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decide(facts(spark, sf_dir)).select("case_id", "rule", "action_type", F.size("considered").alias("considered_count"))


@query("admission_errors", """
    WITH q AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'later' WHEN 1 THEN 'alternate' WHEN 2 THEN 'Bad Id' WHEN 3 THEN 'other' ELSE 'baseline' END AS observation_id, CASE WHEN doc_id % 10 = 9 THEN 'alternate_band' WHEN doc_id % 6 = 0 THEN 'next_timestamp' WHEN doc_id % 6 = 1 THEN 'alternate_band' ELSE 'pre_event_baseline' END AS action_type FROM documents),
    w AS (SELECT *, CASE observation_id WHEN 'later' THEN 'next_timestamp' WHEN 'alternate' THEN 'alternate_band' WHEN 'baseline' THEN 'pre_event_baseline' END AS wanted FROM q)
    SELECT doc_id AS case_id, CASE WHEN wanted IS NULL THEN 'observation_not_allowed' WHEN wanted <> action_type THEN 'action_not_allowed' WHEN observation_id = 'later' AND doc_id % 4 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'terminal'
        WHEN (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END) >= doc_id % 3 THEN 'observation_budget_exhausted' WHEN doc_id % 130 >= 120 THEN 'elapsed_time_exhausted' WHEN (doc_id * 7) % 1100 + (CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 100 END) > 1000 THEN 'byte_budget_exhausted' END AS error FROM w
""")  # fmt: skip
def admission_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = b.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE doc_id % 6 WHEN 0 THEN 'later' WHEN 1 THEN 'alternate' WHEN 2 THEN 'Bad Id' WHEN 3 THEN 'other' ELSE 'baseline' END AS observation_id",
        "CASE WHEN doc_id % 10 = 9 THEN 'alternate_band' WHEN doc_id % 6 = 0 THEN 'next_timestamp' WHEN doc_id % 6 = 1 THEN 'alternate_band' ELSE 'pre_event_baseline' END AS action_type",
        "map('later', 'next_timestamp', 'alternate', 'alternate_band', 'baseline', 'pre_event_baseline') AS allowed", "CASE WHEN doc_id % 4 = 0 THEN array('later') ELSE cast(array() AS array<string>) END AS selected", "CASE WHEN doc_id % 11 = 0 THEN 'abstain' END AS terminal_action",
        "map('later', array(named_struct('source_id', 's1', 'bytes', 100L)), 'alternate', array(named_struct('source_id', 's1', 'bytes', 100L)), 'baseline', array(named_struct('source_id', 's1', 'bytes', 100L))) AS sources", "CASE WHEN doc_id % 4 = 0 THEN array('s1') ELSE cast(array() AS array<string>) END AS used_sources",
        "doc_id % 3 AS max_observations", "doc_id % 130 AS used_elapsed_seconds", "120 AS max_elapsed_seconds", "(doc_id * 7) % 1100 AS used_bytes", "1000 AS max_bytes",
    )
    return q.select(F.col("doc_id").alias("case_id"), decide.admission_error().alias("error"))


@query("agent_loop_outcomes")
def agent_loop_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unrolled loop over all cases; pytest holds it against a one-by-one replay."""
    d = b.table(spark, sf_dir, "documents")
    allow = "array(named_struct('action_type', 'next_timestamp', 'observation_id', 'later', 'bytes', 100L), named_struct('action_type', 'alternate_band', 'observation_id', 'alternate', 'bytes', 100L + doc_id % 900), named_struct('action_type', 'pre_event_baseline', 'observation_id', 'baseline', 'bytes', 100L))"
    cases = d.selectExpr("doc_id AS case_id", f"{allow} AS allowlist", "3 AS max_observations", "1000L AS max_bytes", "120.0 AS max_elapsed_seconds", "1 AS max_retries")
    keys = ["later", "alternate", "baseline", "alternate,later", "baseline,later", "alternate,baseline", "alternate,baseline,later"]
    seen = d.select("doc_id", F.explode(F.array(*[F.lit(k) for k in keys])).alias("selected_key")).withColumn("h", F.pmod(F.xxhash64("doc_id", "selected_key"), F.lit(24)))
    n = F.size(F.split("selected_key", ","))
    evidence = seen.select(
        F.col("doc_id").alias("case_id"), "selected_key", F.array_compact(F.array(F.when(F.col("h") % 6 == 0, "coverage_insufficient"), F.when(F.col("h") % 8 == 1, "contrast_low"), F.when(F.col("h") == 3, "bands_conflict"))).alias("reason_codes"), (F.col("h") % 3).alias("component_count"),
        (F.col("h") % 3 * 5).alias("candidate_region_count"), n.alias("usable_observation_count"), F.when(F.col("h") % 3 == 0, 0).otherwise(n).alias("persistence_count"), (F.col("h") / 24).alias("persistence_confidence"),
    )
    return decide.run_loop(cases, evidence, 3).select("case_id", "outcome", "outcome_confidence", "final_state", "rule", F.array_join("selected", ",").alias("selected"), "used_bytes", "used_retries", "transitions")


# Evaluation

RATIO = python_round_sql("CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END")
MEAN = python_round_sql("({a} + {b}) / 2")


def _metrics_sql() -> str:
    parts = []
    for c in evaluate.LABELS:
        parts.append(f"{RATIO.format(a=f'{c}_tp', b=f'{c}_tp + {c}_fp')} AS {c}_precision, {RATIO.format(a=f'{c}_tp', b=f'{c}_tp + {c}_fn')} AS {c}_recall")
    return ", ".join(parts)


CONFUSION_SQL = ", ".join(f"count(*) FILTER (label = '{c}' AND prediction = '{c}') AS {c}_tp, count(*) FILTER (label <> '{c}' AND prediction = '{c}') AS {c}_fp, count(*) FILTER (label = '{c}' AND prediction IS DISTINCT FROM '{c}') AS {c}_fn" for c in evaluate.LABELS)
TABLES_SQL = f"""
    {b.SCORE_ROWS}, op AS (SELECT split, case_id FROM sr WHERE mode = 'one_shot' AND prediction IS NULL), j AS (SELECT sr.*, op.case_id IS NOT NULL AS opened FROM sr LEFT JOIN op USING (split, case_id)),
    g AS (SELECT CASE WHEN grouping(split) = 1 THEN 'combined' ELSE split END AS split, mode, count(*) AS case_count, {CONFUSION_SQL}, count(*) FILTER (prediction IS NULL) AS abstention_count, count(*) FILTER (opened) AS ambiguous_count, count(*) FILTER (opened AND prediction IS NOT NULL) AS resolved_count,
        CAST(sum(observation_count) AS BIGINT) AS observation_count, {python_round_sql("avg(observation_count)")} AS mean_observation_count, CAST(sum(selected_source_bytes) AS BIGINT) AS selected_source_bytes, round(sum(latency_milliseconds), 4) AS latency_milliseconds, count(*) FILTER (error_count > 0) AS error_case_count FROM j GROUP BY GROUPING SETS ((split, mode), (mode))),
    h AS (SELECT *, {_metrics_sql()} FROM g),
    k AS (SELECT *, {RATIO.format(a='2.0 * positive_precision * positive_recall', b='positive_precision + positive_recall')} AS positive_f1, {RATIO.format(a='2.0 * control_precision * control_recall', b='control_precision + control_recall')} AS control_f1 FROM h)
"""
TABLE_COLUMNS = ["split", "mode", "case_count", "positive_tp", "positive_fp", "positive_fn", "abstention_count", "ambiguous_count", "resolved_count", "observation_count", "mean_observation_count", "selected_source_bytes", "error_case_count"]


@query("classification_tables", f"WITH {TABLES_SQL} SELECT {', '.join(TABLE_COLUMNS)}, latency_milliseconds, {', '.join(f'{MEAN.format(a=f"positive_{m}", b=f"control_{m}")} AS macro_{m}' for m in ('f1', 'precision', 'recall'))}, {RATIO.format(a='resolved_count', b='ambiguous_count')} AS resolution_rate FROM k")
def classification_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = evaluate.tables(b.score_rows(spark, sf_dir))
    return t.select(*TABLE_COLUMNS, F.round("latency_milliseconds", 4).alias("latency_milliseconds"), "macro_f1", "macro_precision", "macro_recall", "resolution_rate")


@query("ambiguity_resolution", f"WITH {TABLES_SQL} SELECT split, mode, ambiguous_count, resolved_count FROM g")
def ambiguity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.tables(b.score_rows(spark, sf_dir)).select("split", "mode", "ambiguous_count", "resolved_count")


POISSON = "".join(f"(u >= {t})::INTEGER + " for t in [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238463, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974021, 0.9999998885745217, 0.9999999899522337, 0.9999999991683892])[:-3]
WEIGHTED = ", ".join(f"coalesce(sum(CASE WHEN label = '{c}' AND prediction = '{c}' THEN times ELSE 0 END), 0)::BIGINT AS {c}_tp, coalesce(sum(CASE WHEN label <> '{c}' AND prediction = '{c}' THEN times ELSE 0 END), 0)::BIGINT AS {c}_fp, coalesce(sum(CASE WHEN label = '{c}' AND prediction IS DISTINCT FROM '{c}' THEN times ELSE 0 END), 0)::BIGINT AS {c}_fn" for c in evaluate.LABELS)


@query("bootstrap_interval_hash", f"""
    WITH {b.SCORE_ROWS}, dw AS (SELECT sr.*, s AS sample, ('0x' || substr(sha256('7:' || s || ':' || mode || ':' || case_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM sr, range(0, 40) t(s)),
    tm AS (SELECT *, {POISSON} AS times FROM dw), g AS (SELECT mode, sample, {WEIGHTED} FROM tm GROUP BY mode, sample), h AS (SELECT *, {_metrics_sql()} FROM g),
    k0 AS (SELECT mode, {RATIO.format(a='2.0 * positive_precision * positive_recall', b='positive_precision + positive_recall')} AS p, {RATIO.format(a='2.0 * control_precision * control_recall', b='control_precision + control_recall')} AS c FROM h),
    k AS (SELECT mode, {MEAN.format(a='p', b='c')} AS f FROM k0),
    l AS (SELECT mode, list_sort(list(f)) AS v FROM k GROUP BY mode)
    SELECT mode, v[floor(0.025 * (len(v) - 1))::INTEGER + 1] AS lower, v[ceil(0.975 * (len(v) - 1))::INTEGER + 1] AS upper FROM l
""")  # fmt: skip
def bootstrap_interval_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bootstrap(b.score_rows(spark, sf_dir), 40, 7)


@query("bootstrap_interval_seeded")
def bootstrap_interval_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.seeded_bootstrap(b.score_rows(spark, sf_dir), 20, 7)


@query("mode_efficiency", f"WITH {b.SCORE_ROWS} SELECT mode, count(*) AS case_count, {RATIO.format(a='''count(*) FILTER (label = 'positive' AND prediction = 'positive')''', b='''count(*) FILTER (label = 'positive')''')} AS recall, round(avg(observation_count), 4) AS mean_observation_count, round(avg(latency_milliseconds), 4) AS mean_latency_milliseconds FROM sr GROUP BY mode")
def mode_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mode_efficiency(b.score_rows(spark, sf_dir)).select("mode", "case_count", "recall", F.round("mean_observation_count", 4).alias("mean_observation_count"), F.round("mean_latency_milliseconds", 4).alias("mean_latency_milliseconds"))


@query("error_outcomes", f"""
    WITH {b.SCORE_ROWS} SELECT mode, count(*) FILTER (label = 'control' AND prediction = 'positive') AS false_positives, count(*) FILTER (label = 'positive' AND prediction = 'control') AS decisive_false_negatives,
        count(*) FILTER (prediction IS NULL) AS abstentions, count(*) FILTER (label = 'positive' AND prediction IS DISTINCT FROM 'positive') AS scoring_false_negatives FROM sr GROUP BY mode
""")  # fmt: skip
def error_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_outcomes(b.score_rows(spark, sf_dir))


@query("error_keys", f"""
    WITH {b.SCORE_ROWS}, k AS (SELECT mode, CASE WHEN prediction IS NULL THEN 'abstention' WHEN label = 'control' AND prediction = 'positive' THEN 'false_positive' WHEN label = 'positive' AND prediction = 'control' THEN 'decisive_false_negative' END AS kind, split, case_id FROM sr)
    SELECT * FROM k WHERE kind IS NOT NULL
""")  # fmt: skip
def error_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_keys(b.score_rows(spark, sf_dir))


VALUE = f"""
    {b.SCORE_ROWS}, one AS (SELECT split, case_id, coalesce(prediction = label, false) AS was, observation_count AS first_observations, prediction AS first_prediction FROM sr WHERE mode = 'one_shot'),
    vs AS (SELECT sr.*, coalesce(prediction = label, false) AS now, was, first_observations, first_prediction FROM sr JOIN one USING (split, case_id) WHERE mode <> 'one_shot')
"""


@query("agent_value", f"WITH {VALUE} SELECT mode, count(*) FILTER (now AND NOT was) AS improved, count(*) FILTER (NOT now AND was) AS regressed, count(*) FILTER (now AND was) AS unchanged_correct FROM vs GROUP BY mode")
def agent_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.agent_value(b.score_rows(spark, sf_dir))


@query("extra_observations", f"""
    WITH {VALUE} SELECT split, case_id, label, CASE WHEN NOT now AND was THEN 'adaptive regressed after requesting more observations' WHEN prediction IS NULL THEN 'adaptive remained safely abstaining after more observations'
        WHEN prediction IS NOT DISTINCT FROM first_prediction THEN 'adaptive kept the same decision after more observations' ELSE 'adaptive changed the decision without correcting the one-shot result' END AS reason
    FROM vs WHERE mode = 'adaptive' AND observation_count > first_observations AND NOT (now AND NOT was)
""")  # fmt: skip
def extra_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.extra_observations(b.score_rows(spark, sf_dir))


@query("representatives", f"""
    WITH {VALUE}, ok AS (SELECT * FROM vs WHERE mode = 'adaptive' AND case_id % 3 <> 0)
    SELECT 'success' AS category, k.split, k.case_id FROM (SELECT min(CASE WHEN label = 'positive' AND now AND NOT was THEN {{split: split, case_id: case_id}} END) AS k FROM ok) UNION ALL
    SELECT 'control', k.split, k.case_id FROM (SELECT min(CASE WHEN label = 'control' AND now THEN {{split: split, case_id: case_id}} END) AS k FROM ok) UNION ALL
    SELECT 'abstention', k.split, k.case_id FROM (SELECT min(CASE WHEN prediction IS NULL THEN {{split: split, case_id: case_id}} END) AS k FROM ok) UNION ALL
    SELECT 'genuine_limitation', k.split, k.case_id FROM (SELECT coalesce(min(CASE WHEN observation_count > first_observations AND NOT now AND prediction IS NOT NULL THEN {{split: split, case_id: case_id}} END), min(CASE WHEN observation_count > first_observations AND NOT now THEN {{split: split, case_id: case_id}} END)) AS k FROM ok)
""")  # fmt: skip
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.score_rows(spark, sf_dir)
    traces = rows.where("mode = 'adaptive'").select("split", "case_id", F.when(F.col("case_id") % 3 == 0, "torn").otherwise("complete").alias("status"))
    return evaluate.representatives(rows, traces)


@query("mode_coverage", f"WITH {b.SCORE_ROWS}, kept AS (SELECT case_id, CASE WHEN mode = 'adaptive' AND case_id % 50 = 1 THEN 'one_shot' ELSE mode END AS mode FROM sr), e AS (SELECT DISTINCT case_id FROM sr), x AS (SELECT e.case_id, m.mode FROM e, (VALUES ('one_shot'), ('fixed_bundle'), ('adaptive')) m(mode)) SELECT x.case_id, x.mode, count(kept.case_id) AS n FROM x LEFT JOIN kept USING (case_id, mode) GROUP BY ALL HAVING count(kept.case_id) <> 1")
def mode_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.score_rows(spark, sf_dir)
    return evaluate.coverage(rows, rows.withColumn("mode", F.expr("CASE WHEN mode = 'adaptive' AND case_id % 50 = 1 THEN 'one_shot' ELSE mode END"))).select("case_id", "mode", "n")


# Splits: cases that share a source, a week or an event never part




CASE_COLUMNS = [
    "o_orderkey AS case_id", "o_orderkey // 36 AS event_id", "CASE WHEN o_orderkey % 72 = 32 THEN o_orderkey // 72 ELSE 1000000 + o_orderkey END AS geographic_cell", "CASE WHEN o_orderkey % 72 = 36 THEN o_orderkey // 144 ELSE 2000000 + o_orderkey END AS time_period",
    "CASE WHEN o_custkey % 3 = 0 THEN 'positive' ELSE 'control' END AS label", "cast((o_orderkey * 7) % 90 AS double) AS view_angle", "cast((o_orderkey * 13) % 101 AS double) / 100 AS missingness", "month(o_orderdate) AS month",
]
CASES = "cs AS (SELECT " + ", ".join(CASE_COLUMNS) + " FROM orders)"
KEYS = ["event_id", "geographic_cell", "time_period"]
SPLIT_SQL = f"""
    {CASES}, ky AS (SELECT case_id, 'e' || event_id AS k FROM cs UNION ALL SELECT case_id, 'g' || geographic_cell FROM cs UNION ALL SELECT case_id, 't' || time_period FROM cs),
    lk AS (SELECT DISTINCT a.case_id AS x, b.case_id AS y FROM ky a JOIN ky b USING (k)),
    reach(x, root) AS (SELECT case_id, case_id FROM cs UNION SELECT lk.y, reach.root FROM reach JOIN lk ON lk.x = reach.x WHERE reach.root <= lk.y),
    rt AS (SELECT x AS case_id, min(root) AS root FROM reach GROUP BY x)
"""


def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.table(spark, sf_dir, "orders")
    return o.selectExpr(*[c.replace(" // ", " div ") for c in CASE_COLUMNS])


@query("split_components", f"WITH RECURSIVE {SPLIT_SQL} SELECT case_id, root FROM rt")
def split_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.by_shared_keys(case_rows(spark, sf_dir), "case_id", KEYS)


def split_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = case_rows(spark, sf_dir)
    return c.join(graph.allocate(graph.by_shared_keys(c, "case_id", KEYS), "case_id"), "case_id")


@query("split_allocation", f"""
    WITH RECURSIVE {SPLIT_SQL}, gr AS (SELECT root, count(*) AS n, sha256(string_agg(case_id::VARCHAR, chr(0) ORDER BY case_id::VARCHAR)) AS h FROM rt GROUP BY root), od AS (SELECT *, row_number() OVER (ORDER BY n DESC, h) AS k FROM gr),
    fold(k, root, a, b, c, split) AS (
        SELECT k, root, n, 0::BIGINT, 0::BIGINT, 'development' FROM od WHERE k = 1
        UNION ALL
        SELECT k, root, a + CASE split WHEN 'development' THEN n ELSE 0 END, b + CASE split WHEN 'test' THEN n ELSE 0 END, c + CASE split WHEN 'stress' THEN n ELSE 0 END, split FROM (
            SELECT od.k, od.root, od.n, a, b, c, CASE WHEN od.k = 2 THEN 'test' WHEN od.k = 3 THEN 'stress' WHEN a / 0.6::DOUBLE <= b / 0.2::DOUBLE AND a / 0.6::DOUBLE <= c / 0.2::DOUBLE THEN 'development' WHEN b <= c THEN 'test' ELSE 'stress' END AS split
            FROM fold JOIN od ON od.k = fold.k + 1)
    )
    SELECT rt.case_id, fold.split FROM rt JOIN fold USING (root)
""")  # fmt: skip
def split_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_cases(spark, sf_dir).select("case_id", "split")


@query("split_leakage_report", f"WITH {CASES} SELECT 'event_id' AS axis, count(DISTINCT event_id) AS unique_groups, 0::BIGINT AS groups_spanning_splits FROM cs UNION ALL SELECT 'geographic_cell', count(DISTINCT geographic_cell), 0 FROM cs UNION ALL SELECT 'time_period', count(DISTINCT time_period), 0 FROM cs")
def split_leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leakage(split_cases(spark, sf_dir), KEYS)


def plain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_rows(spark, sf_dir).withColumn("split", F.when(F.col("case_id") % 3 == 0, "test").otherwise("development"))


PLAIN = f"{CASES}, sp AS (SELECT *, CASE WHEN case_id % 3 = 0 THEN 'test' ELSE 'development' END AS split FROM cs)"


@query("split_distribution", f"""
    WITH {PLAIN}, l AS (SELECT split, 'label' AS dimension, label AS value FROM sp UNION ALL SELECT split, 'month', CAST(month AS VARCHAR) FROM sp)
    SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, dimension, value, count(*) AS n FROM l GROUP BY GROUPING SETS ((split, dimension, value), (dimension, value))
""")  # fmt: skip
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.distribution(plain_split(spark, sf_dir), ["label", "month"])


@query("split_histogram", f"WITH {PLAIN}, l AS (SELECT split, round(least(floor(view_angle / 10.0) * 10.0, 80.0), 6)::DOUBLE AS lower FROM sp) SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, lower, round(lower + 10.0, 6)::DOUBLE AS upper, count(*) AS n FROM l GROUP BY GROUPING SETS ((split, lower), (lower))")
def split_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(plain_split(spark, sf_dir), "view_angle", 10.0, 0.0, 90.0)


@query("split_summary", f"WITH {PLAIN} SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(missingness) AS n, {python_round_sql("min(missingness)")} AS minimum, {python_round_sql("max(missingness)")} AS maximum, {python_round_sql("avg(missingness)")} AS mean, {python_round_sql("median(missingness)")} AS median FROM sp GROUP BY GROUPING SETS ((split), ())")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(plain_split(spark, sf_dir), "missingness")


@query("sha_case_ids", f"WITH {PLAIN} SELECT split || '-' || substr(sha256(split || chr(0) || case_id || chr(0) || 'abc'), 1, 24) AS case_id, view_angle FROM sp")
def sha_case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.blind(plain_split(spark, sf_dir), "abc", ["view_angle"])


@query("inspection_sample", f"WITH {PLAIN} SELECT split, case_id FROM sp ORDER BY sha256(split || chr(0) || case_id), case_id LIMIT 25")
def inspection_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.inspection_sample(plain_split(spark, sf_dir).select("split", "case_id"), 25)


# Journals and records


@query("journal_contiguity", f"WITH {b.JOURNAL}, l AS (SELECT *, lag(sequence) OVER (PARTITION BY trace_id ORDER BY sequence) AS p FROM jr) SELECT trace_id, count(*) AS transitions, count(*) FILTER (sequence <> coalesce(p, 0) + 1) AS gaps FROM l GROUP BY trace_id")
def journal_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.contiguity(b.journal(spark, sf_dir))


@query("journal_last_state", f"WITH {b.JOURNAL} SELECT trace_id, max(sequence) AS sequence, arg_max(to_state, sequence) AS to_state FROM jr GROUP BY trace_id")
def journal_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.last_states(b.journal(spark, sf_dir)).select("trace_id", "sequence", "to_state")


@query("record_link_violations", """
    WITH requests AS (SELECT doc_id % 100 AS case_id, doc_id AS observation_id FROM documents), evidence AS (SELECT doc_id % 100 AS case_id, doc_id AS evidence_id, CASE WHEN doc_id % 3 = 1 THEN -1 - doc_id ELSE doc_id - doc_id % 2 END AS observation_id FROM labels)
    SELECT evidence_id, 'observation' AS link FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.observation_id = e.observation_id)
    UNION ALL SELECT e.evidence_id, 'case' FROM evidence e JOIN requests r USING (observation_id) WHERE r.case_id <> e.case_id
""")  # fmt: skip
def record_link_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thermal_lake.operators import records

    requests = b.table(spark, sf_dir, "documents").selectExpr("doc_id % 100 AS case_id", "doc_id AS observation_id")
    evidence = b.table(spark, sf_dir, "labels").selectExpr("doc_id % 100 AS case_id", "doc_id AS evidence_id", "CASE WHEN doc_id % 3 = 1 THEN -1 - doc_id ELSE doc_id - doc_id % 2 END AS observation_id")
    return records.broken_links(evidence, "evidence_id", requests, "observation_id", "case_id").select("evidence_id", "link")


@query("identifier_validity", """
    SELECT l_orderkey, l_linenumber, l_quantity >= 0 AS is_count, l_discount BETWEEN 0 AND 0.05 AS is_fraction, l_returnflag IN ('A', 'N') AS is_known, regexp_full_match(lower(l_returnflag) || '-' || l_orderkey, '[a-z0-9][a-z0-9_-]{0,79}') AS is_identifier FROM lineitem
""")  # fmt: skip
def identifier_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", checks.is_count(F.col("l_quantity")).alias("is_count"), checks.is_between(F.col("l_discount"), 0, 0.05).alias("is_fraction"), checks.is_one_of(F.col("l_returnflag"), ("A", "N")).alias("is_known"), checks.is_identifier(F.concat_ws("-", F.lower("l_returnflag"), "l_orderkey")).alias("is_identifier"))


@query("gated_outcomes", f"WITH RECURSIVE {b.PIXELS}, {MASKS}, {COMPONENTS}, {QUALITY.format(v='v7')}, t AS (SELECT frame_id, sum(area) AS area FROM cs WHERE area >= 4 AND edge_distance >= 1 GROUP BY frame_id) SELECT frame_id // 8 AS case_id, count(*) AS observation_count, count(*) FILTER (reason IS NULL) AS usable_observation_count, CAST(coalesce(sum(CASE WHEN reason IS NULL THEN t.area END), 0) AS BIGINT) AS candidate_region_count FROM qr LEFT JOIN t USING (frame_id) GROUP BY case_id")
def gated_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.pixels(spark, sf_dir)
    reasons = r.quality_reason(r.frame_quality(p)).select("frame_id", "reason")
    cells = r.anomaly_components(r.anomaly_tiles(p), SMALL).where("kept").select("frame_id", F.explode("cells").alias("cell"), F.lit(True).alias("candidate"))
    area = r.gate(cells, reasons, "candidate").groupBy("frame_id").agg(F.count_if("candidate").alias("area"))
    usable = F.count_if(F.col("reason").isNull())
    return reasons.join(area, "frame_id", "left").groupBy(F.expr("frame_id div 8").alias("case_id")).agg(F.count("*").alias("observation_count"), usable.alias("usable_observation_count"), F.sum(F.coalesce("area", F.lit(0))).alias("candidate_region_count"))
