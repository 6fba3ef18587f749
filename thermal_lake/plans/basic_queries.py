"""Smaller queries: set operations, neighbourhoods, views, budgets, timings, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermal_lake import bindings as b
from thermal_lake.functions import checks, geo
from thermal_lake.functions.rounding import python_round_sql
from thermal_lake.operators import decide, evaluate, raster, records, relate
from thermal_lake.plans import pipelines, views
from thermal_lake.sources import catalog

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Set operations


@query("observations_remaining", "SELECT o_custkey AS case_id, o_orderkey AS observation_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 50 = o_custkey % 50)")
def observations_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = b.table(spark, sf_dir, "orders").selectExpr("o_custkey AS case_id", "o_orderkey AS observation_id")
    chosen = b.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS observation_id", "l_suppkey % 50 AS s").join(allowed, "observation_id").where("s = case_id % 50")
    return decide.remaining(allowed, chosen)


@query("key_set_difference", "WITH a AS (SELECT CASE WHEN doc_id % 7 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id FROM documents), b AS (SELECT doc_id FROM labels) SELECT (SELECT count(*) FROM (SELECT doc_id FROM a EXCEPT ALL SELECT doc_id FROM b)) AS only_first, (SELECT count(*) FROM (SELECT doc_id FROM b EXCEPT ALL SELECT doc_id FROM a)) AS only_second")
def key_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, l = b.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 7 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id")), b.table(spark, sf_dir, "labels").select("doc_id")  # noqa: E741
    return relate.membership(a, l, "doc_id").agg(F.sum(F.greatest(F.col("in_first") - F.col("in_second"), F.lit(0))).alias("only_first"), F.sum(F.greatest(F.col("in_second") - F.col("in_first"), F.lit(0))).alias("only_second"))


@query("reason_subset_violations", "SELECT doc_id AS case_id, len(list_filter(['valid', 'timeout'], lambda r: r = CASE WHEN doc_id % 3 = 0 THEN 'timeout' ELSE 'valid' END AND doc_id % 4 = 0)) AS outside FROM documents WHERE doc_id % 4 = 0")
def reason_subset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").selectExpr("doc_id AS case_id", "array(CASE WHEN doc_id % 3 = 0 THEN 'timeout' ELSE 'valid' END) AS part", "CASE WHEN doc_id % 4 = 0 THEN cast(array() AS array<string>) ELSE array('valid', 'timeout') END AS whole")
    return records.not_subset(d, "part", "whole").select("case_id", F.size("outside").cast("long").alias("outside"))


@query("source_bytes_used", "SELECT case_id, CAST(sum(bytes) AS BIGINT) AS used_bytes, count(*) AS sources FROM (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS source_id, l_suppkey * 1000 AS bytes FROM lineitem) GROUP BY case_id")
def source_bytes_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of a case counts once."""
    t = b.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS case_id", "l_suppkey AS source_id", "l_suppkey * 1000 AS bytes")
    return decide.source_bytes(t)


@query("first_seen_reasons", """
    WITH r AS (SELECT conv_id AS case_id, turn, role AS reason FROM conversations), f AS (SELECT case_id, reason, min(turn) AS first_turn FROM r GROUP BY ALL)
    SELECT case_id, string_agg(reason, ',' ORDER BY first_turn) AS reasons FROM f GROUP BY case_id
""")  # fmt: skip
def first_seen_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.table(spark, sf_dir, "conversations").selectExpr("conv_id AS case_id", "turn", "role AS reason")
    return decide.first_seen(t, "case_id", "turn", "reason").select("case_id", F.array_join("reasons", ",").alias("reasons"))


# Neighbourhoods


@query("active_detections", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS active FROM events")
def active_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many detections of a hotspot are at most an hour old, itself and its equals included."""
    e = b.table(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    return relate.active(e, ["user_id"], "event_id", "at", 3600).select("event_id", "active")


@query("evidence_changes", """
    WITH s AS (SELECT conv_id AS case_id, turn AS step, length(text) % 3 AS c, turn % 2 AS p FROM conversations), l AS (SELECT *, lag(c) OVER w AS pc, lag(p) OVER w AS pp, lag(step) OVER w AS ps FROM s WINDOW w AS (PARTITION BY case_id ORDER BY step))
    SELECT case_id, step, 'component_count' AS field FROM l WHERE ps IS NOT NULL AND pc <> c UNION ALL SELECT case_id, step, 'persistence_count' FROM l WHERE ps IS NOT NULL AND pp <> p
""")  # fmt: skip
def evidence_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.table(spark, sf_dir, "conversations").selectExpr("conv_id AS case_id", "turn AS step", "length(text) % 3 AS component_count", "turn % 2 AS persistence_count", "0.5D AS persistence_confidence", "array('valid') AS reason_codes", "array('e') AS evidence_ids")
    return views.changes(s).select("case_id", "step", "field")


@query("sphere_distances", f"""
    SELECT s_suppkey, round(2 * {geo.RADIUS_KM} * asin(sqrt(pow(sin((radians(y) - radians(x)) / 2), 2) + cos(radians(x)) * cos(radians(y)) * pow(sin(radians(v - u) / 2), 2))), 6) AS plain,
        round(2 * {geo.RADIUS_KM} * asin(sqrt(pow(sin((radians(y) - radians(x)) / 2), 2) + cos(radians(x)) * cos(radians(y)) * pow(sin(radians(((v - u + 180) - 360 * floor((v - u + 180) / 360)) - 180) / 2), 2))), 6) AS wrapped
    FROM (SELECT s_suppkey, (s_suppkey % 80) * 1.0::DOUBLE AS x, (s_suppkey % 70) * 1.0::DOUBLE AS y, 170.5 + s_suppkey % 9 AS u, -175.25 - s_suppkey % 4 AS v FROM supplier)
""")  # fmt: skip
def sphere_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "cast(s_suppkey % 80 AS double) AS x", "cast(s_suppkey % 70 AS double) AS y", "170.5D + s_suppkey % 9 AS u", "-175.25D - s_suppkey % 4 AS v")
    c = [F.col(n) for n in "xuyv"]
    return s.select("s_suppkey", F.round(geo.haversine_km(*c), 6).alias("plain"), F.round(geo.haversine_wrapped_km(*c), 6).alias("wrapped"))


# Views, budgets, timings


@query("budget_rows", """
    WITH t AS (SELECT o_orderkey AS case_id, o_custkey % 4 AS u, 3 AS m, o_orderkey % 900 AS ub, o_orderkey % 2 AS r FROM orders)
    SELECT case_id, 'observations' AS resource, u::DOUBLE AS used, m::DOUBLE AS "limit", round(u / m::DOUBLE, 4) AS share FROM t UNION ALL SELECT case_id, 'bytes', ub::DOUBLE, 1000.0, round(ub / 1000.0::DOUBLE, 4) FROM t
    UNION ALL SELECT case_id, 'elapsed_seconds', 1.5, 120.0, 0.0125 FROM t UNION ALL SELECT case_id, 'retries', r::DOUBLE, 0.0, NULL FROM t
""")  # fmt: skip
def budget_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS case_id", "o_custkey % 4 AS used_observations", "3 AS max_observations", "o_orderkey % 900 AS used_bytes", "1000 AS max_bytes", "1.5D AS used_elapsed_seconds", "120.0D AS max_elapsed_seconds", "o_orderkey % 2 AS used_retries", "0 AS max_retries")
    return views.budget(t)


@query("budget_violations", "SELECT o_orderkey AS case_id, o_custkey % 5 <= 3 AND o_orderkey % 1100 <= 1000 AND o_orderkey % 2 <= 1 AS ok FROM orders")
def budget_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS case_id", "o_custkey % 5 AS used_observations", "3 AS max_observations", "o_orderkey % 1100 AS used_bytes", "1000 AS max_bytes", "1.5D AS used_elapsed_seconds", "120.0D AS max_elapsed_seconds", "o_orderkey % 2 AS used_retries", "1 AS max_retries")
    return t.select("case_id", checks.within_budget().alias("ok"))


@query("measurement_rows", f"""
    WITH {b.PIXELS}, f AS (SELECT frame_id, round(max(CASE WHEN NOT invalid THEN v7 END)::DOUBLE, 3) AS hottest, round(CASE WHEN frame_id % 3 = 0 THEN NULL ELSE avg(v14::DOUBLE) END, 3) AS background FROM px GROUP BY frame_id)
    SELECT frame_id, 'hottest' AS name, hottest AS value, 'K' AS unit, CASE WHEN hottest IS NULL THEN 'not measured' END AS missing_reason FROM f UNION ALL SELECT frame_id, 'background', background, 'K', CASE WHEN background IS NULL THEN 'not measured' END FROM f
""")  # fmt: skip
def measurement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.pixels(spark, sf_dir).groupBy("frame_id").agg(F.round(F.max(F.when(~F.col("invalid"), F.col("v7"))).cast("double"), 3).alias("hottest"), F.avg(F.col("v14").cast("double")).alias("m"))
    f = f.withColumn("background", F.round(F.when(F.col("frame_id") % 3 != 0, F.col("m")), 3))
    return views.measurements(f, {"hottest": "K", "background": "K"})


@query("stage_totals", "SELECT split_part(event_type || ':' || user_id, ':', 1) AS stage, round(sum(value), 3) AS milliseconds, count(*) AS runs FROM events GROUP BY stage")
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.stage_totals(b.table(spark, sf_dir, "events").selectExpr("concat(event_type, ':', user_id) AS stage", "value AS milliseconds"))


@query("baseline_summary", f"""
    WITH {b.SCORE_ROWS} SELECT mode, count(*) AS case_count, count(*) FILTER (error_count = 0) AS completed_case_count, count(*) FILTER (error_count > 0) AS failed_case_count, count(*) FILTER (prediction IS NULL) AS open_cases,
        sum(observation_count)::BIGINT AS observations, sum(selected_source_bytes)::BIGINT AS selected_source_bytes, round(sum(latency_milliseconds), 3) AS latency_milliseconds, sum(error_count)::BIGINT AS error_count FROM sr GROUP BY mode
""")  # fmt: skip
def baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.score_rows(spark, sf_dir).withColumn("outcome", F.coalesce("prediction", F.lit("open")))
    return evaluate.baseline_summary(rows).select("mode", "case_count", "completed_case_count", "failed_case_count", F.coalesce(F.col("outcomes")["open"], F.lit(0)).alias("open_cases"), "observations", "selected_source_bytes", F.round("latency_milliseconds", 3).alias("latency_milliseconds"), "error_count")


@query("benchmark_audit", "SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality <> 1) AS controls, count(DISTINCT doc_id % 40) AS sources, sha256(list_aggregate(list_sort(list(DISTINCT sha256((doc_id % 40)::VARCHAR))), 'string_agg', ',')) AS source_digest FROM labels")
def benchmark_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "positive").otherwise("control").alias("label"), F.array(F.sha2((F.col("doc_id") % 40).cast("string"), 256)).alias("source_hashes"))
    return pipelines.benchmark_audit(t).select("positives", "controls", F.size("source_hashes").cast("long").alias("sources"), F.sha2(F.array_join("source_hashes", ","), 256).alias("source_digest"))


# Sources and boxes


@query("source_requests", "SELECT p_partkey AS case_id, 'https://host/' || replace(p_brand, '#', '%23') || '/' || replace(p_name, ' ', '%20') AS url, p_size AS size_bytes FROM part")
def source_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part").selectExpr("p_partkey AS case_id", "array(named_struct('source_id', 's', 'object_key', concat(p_brand, '/', p_name), 'size_bytes', p_size, 'sha256', 'x')) AS sources")
    return catalog.source_requests(p, "https://host").select("case_id", "url", "size_bytes")


@query("crop_boxes", f"WITH {b.WINDOWS} SELECT window_id, round(latitude - 45, 4) AS south, round(longitude + 51, 4) AS east, CASE WHEN NOT (latitude - 45 BETWEEN -90 AND 90 AND latitude + 45 BETWEEN -90 AND 90 AND longitude - 51 BETWEEN -180 AND 180 AND longitude + 51 BETWEEN -180 AND 180) THEN 'configuration_invalid' END AS error FROM win")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.crop_box(b.windows(spark, sf_dir), 45.0, 51.0).select("window_id", F.round("south", 4).alias("south"), F.round("east", 4).alias("east"), "error")


@query("scan_timing", """
    WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 1 AND o_orderkey % 3 <> 0 THEN o_orderdate END AS s, CASE WHEN o_orderkey % 5 <> 2 AND o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 7 - 1) END AS e, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS o FROM orders)
    SELECT o_orderkey, coalesce(s, o) AS scan_start, coalesce(e, o) AS scan_end, CASE WHEN (s IS NULL) <> (e IS NULL) THEN 'one coverage time is missing' WHEN s IS NULL AND o IS NULL THEN 'no time' WHEN e < s THEN 'scan ends before it starts' END AS timing_error FROM t
""")  # fmt: skip
def scan_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 <> 1 AND o_orderkey % 3 <> 0 THEN o_orderdate END AS coverage_start", "CASE WHEN o_orderkey % 5 <> 2 AND o_orderkey % 3 <> 0 THEN o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 7 - 1 AS int), 0) END AS coverage_end", "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS time")
    return raster.scan_timing(t).select("o_orderkey", "scan_start", "scan_end", "timing_error")


@query("role_selection", """
    WITH r AS (SELECT doc_id AS case_id, CASE doc_id % 4 WHEN 0 THEN 'initial' WHEN 1 THEN 'alternate' WHEN 2 THEN 'baseline' ELSE 'later' END AS missing FROM documents),
    m(mode, role) AS (VALUES ('one_shot', 'initial'), ('one_shot', 'alternate'), ('fixed_bundle', 'baseline'), ('fixed_bundle', 'initial'), ('fixed_bundle', 'later'), ('fixed_bundle', 'alternate'))
    SELECT case_id, mode, role, CASE WHEN role = missing THEN 'source_missing' END AS error FROM r CROSS JOIN m
""")  # fmt: skip
def role_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents")
    have = d.selectExpr("doc_id AS case_id", "CASE doc_id % 4 WHEN 0 THEN 'initial' WHEN 1 THEN 'alternate' WHEN 2 THEN 'baseline' ELSE 'later' END AS missing", "explode(array('baseline', 'initial', 'later', 'alternate')) AS role").where("role <> missing").selectExpr("case_id", "role", "role AS source_id")
    return pipelines.selected(have).select("case_id", "mode", "role", "error")


@query("available_action_order", "SELECT doc_id AS case_id, array_to_string(list_concat(CASE WHEN doc_id % 2 = 0 THEN ['next_timestamp'] ELSE [] END, CASE WHEN doc_id % 3 = 0 THEN ['alternate_band'] ELSE [] END, ['pre_event_baseline']), ',') AS actions FROM documents")
def available_action_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = lambda kind, ok: F.when(ok, F.struct(F.lit(kind).alias("action_type"), F.lit("o").alias("observation_id")))
    k = F.col("doc_id")
    some = F.array_compact(F.array(act("pre_event_baseline", F.lit(True)), act("alternate_band", k % 3 == 0), act("next_timestamp", k % 2 == 0)))
    return b.table(spark, sf_dir, "documents").select(k.alias("case_id"), F.array_join(F.transform(decide.canonical(some), lambda a: a["action_type"]), ",").alias("actions"))


@query("packet_facts", """
    SELECT conv_id AS case_id, count(*) AS observation_count, count(*) FILTER (turn % 4 <> 1) AS usable_observation_count, CAST(sum(turn % 3) AS BIGINT) AS component_count, CAST(sum(turn % 3 * 5) AS BIGINT) AS candidate_region_count FROM conversations GROUP BY conv_id
""")  # fmt: skip
def packet_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both region counts of an evidence packet: components, and candidate pixels under the outcome's name."""
    o = F.struct("turn", F.when(F.col("turn") % 4 == 1, F.array(F.lit("contrast_low"))).otherwise(F.array(F.lit("valid"))).alias("reason_codes"), (F.col("turn") % 3).alias("component_count"), (F.col("turn") % 3 * 5).alias("candidate_pixels"))
    p = b.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.collect_list(o).alias("observations"))
    p = p.withColumn("persistence", F.expr("named_struct('count', 0, 'confidence', 0.0D, 'reason_codes', cast(array() AS array<string>))"))
    s = decide.snapshot(p)
    return s.select("case_id", F.col("observation_count").cast("long").alias("observation_count"), F.col("usable_observation_count").cast("long").alias("usable_observation_count"), "component_count", "candidate_region_count")


@query("prediction_by_label", f"WITH {b.SCORE_ROWS} SELECT label, prediction, mode, count(*) AS n FROM sr GROUP BY ALL")
def prediction_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("prediction") == "positive", "review_escalation").when(F.col("prediction") == "control", "no_persistent_evidence").otherwise("human_review")
    rows = b.score_rows(spark, sf_dir).withColumn("outcome", outcome).select("case_id", "mode", "outcome", "label")
    return pipelines.score(rows.drop("label"), rows.select("case_id", "label").distinct()).groupBy("label", "prediction", "mode").agg(F.count("*").alias("n"))


@query("headline_claims", f"""
    WITH {b.SCORE_ROWS}, ef AS (SELECT mode, {python_round_sql("count(*) FILTER (label = 'positive' AND prediction = 'positive') / (count(*) FILTER (label = 'positive'))::DOUBLE")} AS recall, {python_round_sql("avg(observation_count)")} AS obs,
        count(*) FILTER (label = 'control' AND prediction = 'positive') AS fp, count(*) FILTER (label = 'positive' AND prediction = 'control') AS fn, count(*) FILTER (prediction IS NULL) AS ab FROM sr GROUP BY mode),
    ad AS (SELECT * FROM ef WHERE mode = 'adaptive'), fb AS (SELECT * FROM ef WHERE mode = 'fixed_bundle'),
    ex AS (SELECT count(*) AS n FROM sr x JOIN sr y USING (split, case_id) WHERE x.mode = 'adaptive' AND y.mode = 'one_shot' AND x.observation_count > y.observation_count AND NOT (coalesce(x.prediction = x.label, false) AND NOT coalesce(y.prediction = y.label, false)))
    SELECT 'mode_efficiency' AS "table", 'Adaptive recall is ' || ad.recall || ', compared with fixed-bundle recall ' || fb.recall || '; mean observations are ' || ad.obs || ' versus ' || fb.obs || ', respectively.' AS claim FROM ad, fb
    UNION ALL SELECT 'extra_observations_without_help', n || ' adaptive cases used more observations than one-shot without correcting the one-shot result.' FROM ex
    UNION ALL SELECT 'error_outcomes', 'Adaptive produced ' || fp || ' false positives, ' || fn || ' decisive false negatives, and ' || ab || ' abstentions.' FROM ad
""")  # fmt: skip
def headline_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.score_rows(spark, sf_dir)
    return evaluate.claims(evaluate.mode_efficiency(rows), evaluate.extra_observations(rows), evaluate.error_outcomes(rows))


@query("evidence_packets")
def evidence_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evidence job over all cases, to packets and outcomes."""
    from thermal_lake.plans.raster_queries import SMALL

    p = b.pixels(spark, sf_dir).withColumns({"lat": F.expr("30 + row * 0.01D"), "lon": F.expr("-120 + col * 0.01D")})
    steps = b.table(spark, sf_dir, "embeddings").selectExpr("vec_id div 8 AS case_id", "cast(vec_id % 8 AS int) AS step", "CASE WHEN vec_id % 29 <> 5 THEN vec_id END AS frame_id")
    job = pipelines.evidence_job(p, steps, SMALL)
    return pipelines.outcomes(job.packets).select("case_id", "outcome", "outcome_confidence", "observation_count", "usable_observation_count", "candidate_region_count", "persistence_count", "content_hash")


@query("built_benchmark")
def built_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives, controls, seeded one-to-one pairs and their cases."""
    s = b.shipped(spark, sf_dir)
    events = s.selectExpr("detection_id AS event_id", "acquired_at AS start_time", "acquired_at + interval 60 minutes AS end_time", "latitude", "longitude")
    return pipelines.build_benchmark(events, b.windows(spark, sf_dir), s, None, 5).cases.select("case_id", "label", "window_id", "season", "region_cell")


# Lookups


@query("resolved_sources", """
    SELECT l_orderkey AS observation_id, l_linenumber AS line, CASE WHEN p.p_partkey IS NULL THEN 'unresolved source' WHEN l_linenumber % 2 <> p_size % 2 THEN 'channel' WHEN l_shipdate <> TIMESTAMP '1996-01-01' + INTERVAL 1 DAY * (p_partkey % 900) THEN 'time' END AS error
    FROM lineitem LEFT JOIN part p ON CASE WHEN l_partkey % 10 = 3 THEN -l_partkey ELSE l_partkey END = p_partkey
""")  # fmt: skip
def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = lambda c: F.when(c % 2 == 0, "C07").otherwise("C14")
    o = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("observation_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_partkey") % 10 == 3, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("source_id"), band(F.col("l_linenumber")).alias("channel"), F.col("l_shipdate").alias("observed_at"))
    s = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), band(F.col("p_size")).alias("channel"), F.expr("timestamp_ntz'1996-01-01' + make_dt_interval(cast(p_partkey % 900 AS int))").alias("scan_start"))
    return relate.resolved(o, s).select("observation_id", "line", "error")


@query("band_pairs", "WITH o AS (SELECT l_orderkey, l_linenumber // 2 AS step, l_linenumber % 2 AS band, l_partkey FROM lineitem) SELECT a.l_orderkey AS case_id, a.step, a.l_partkey AS source_id, b.l_partkey AS companion_source_id FROM o a LEFT JOIN o b ON a.l_orderkey = b.l_orderkey AND a.step = b.step AND b.band = 1 WHERE a.band = 0")
def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS case_id", "cast(l_linenumber div 2 AS int) AS step", "CASE WHEN l_linenumber % 2 = 0 THEN 'C07' ELSE 'C14' END AS channel", "l_partkey AS source_id")
    return relate.band_pairs(o, ["case_id", "step"]).select("case_id", "step", "source_id", "companion_source_id")


@query("control_events", "SELECT c.doc_id AS case_id, p.doc_id * 10 AS event_id, CASE WHEN p.doc_id IS NULL THEN 'no positive' END AS error FROM labels c LEFT JOIN labels p ON p.doc_id = c.doc_id + 1 AND p.quality = 1 WHERE c.quality = 0")
def control_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.table(spark, sf_dir, "labels")
    return relate.inherited(t.where("quality = 0").selectExpr("doc_id AS case_id", "doc_id + 1 AS matched_case_id"), t.where("quality = 1").selectExpr("doc_id AS case_id", "doc_id * 10 AS event_id")).select("case_id", "event_id", "error")


@query("membership_differences", "SELECT doc_id, count(l.q)::BIGINT AS in_first, count(d.t)::BIGINT AS in_second FROM (SELECT CASE WHEN doc_id % 6 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, 1 AS t FROM documents) d FULL JOIN (SELECT doc_id, quality AS q FROM labels) l USING (doc_id) GROUP BY doc_id HAVING count(l.q) <> 1 OR count(d.t) <> 1")
def membership_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.membership(b.table(spark, sf_dir, "labels"), b.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 6 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id")), "doc_id")


@query("terminal_actions", """
    WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'abstain' WHEN 1 THEN 'finalize' END AS existing, CASE WHEN doc_id % 2 = 0 THEN 'abstain' ELSE 'finalize' END AS asked FROM documents)
    SELECT doc_id AS case_id, existing IS NULL OR existing = asked AS accepted, coalesce(existing = asked, false) AS idempotent, CASE WHEN existing <> asked THEN 'terminal' END AS error FROM t
""")  # fmt: skip
def terminal_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.table(spark, sf_dir, "documents").selectExpr("doc_id AS case_id", "CASE doc_id % 3 WHEN 0 THEN 'abstain' WHEN 1 THEN 'finalize' END AS existing", "CASE WHEN doc_id % 2 = 0 THEN 'abstain' ELSE 'finalize' END AS asked")
    return t.select("case_id", decide.terminal_result(F.col("existing"), F.col("asked")).alias("r")).select("case_id", "r.*")


@query("restored_state_errors", """
    SELECT doc_id AS case_id, CASE WHEN doc_id % 5 = 0 THEN 'unaligned' WHEN doc_id % 7 = 0 THEN 'repeated' WHEN doc_id % 3 = 0 THEN 'not allowed' WHEN doc_id % 4 = 0 THEN 'other limits' WHEN doc_id % 11 > 8 THEN 'over the limit' END AS error FROM documents
""")  # fmt: skip
def restored_state_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 7 = 0 THEN array('later', 'later') WHEN doc_id % 3 = 0 THEN array('later', 'other') ELSE array('later', 'baseline') END AS selected", "CASE WHEN doc_id % 5 = 0 THEN array('e1') ELSE array('e1', 'e2') END AS evidence_ids",
        "map('later', 'next_timestamp', 'baseline', 'pre_event_baseline') AS allowed", "3 AS max_observations", "CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 3 END AS stored_max_observations", "doc_id % 11 AS used_bytes", "8 AS max_bytes",
    )
    return t.select(F.col("doc_id").alias("case_id"), decide.restored_error().alias("error"))
