"""The three-mode evaluation over whole tables: fixed baselines, the adaptive loop, scoring, a sealed report and its verification."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermal_lake.functions import checks
from thermal_lake.operators import decide, evaluate, records
from thermal_lake.operators.graph import written
from thermal_lake.plans import pipelines
from thermal_lake.sources.sinks import fingerprint

#: Roles that are frames of their own, in the order of time; the alternate band comes with the initial frame.
FRAMES = ("baseline", "initial", "later")
#: What an adaptive case may use.
LIMITS = {"max_observations": 3, "max_bytes": 10**9, "max_elapsed_seconds": 120.0, "max_retries": 1}
RECORD = {"schema_version": "1.0", "record_type": "frozen_evaluation", "analysis_status": "frozen_before_error_analysis"}


def packets_of(runs: DataFrame, pixels: DataFrame, anomaly: checks.Anomaly = checks.Anomaly(), persistence: checks.Persistence = checks.Persistence()) -> DataFrame:  # noqa: B008
    """Packets (run_id and what a packet holds) of runs (run_id, roles, frames as a map of role to frame id), all as one job: a frame that several runs use is worked on once."""
    step = F.posexplode(F.filter(F.array(*map(F.lit, FRAMES)), lambda r: F.array_contains("roles", r) | ((r == "initial") & F.array_contains("roles", "alternate"))))
    steps = runs.select("run_id", "frames", step.alias("step", "role")).select(F.col("run_id").alias("case_id"), "step", F.try_element_at("frames", F.col("role")).alias("frame_id"))
    return pipelines.evidence_job(pixels, steps, anomaly, persistence).packets.withColumnRenamed("case_id", "run_id")


def numbered_runs(runs: DataFrame) -> DataFrame:
    """Runs with a number each, written, so that all that follows finds the same ones."""
    return written(runs.withColumn("run_id", F.monotonically_increasing_id()), "evaluation-runs")


def frames_of(cases: DataFrame) -> DataFrame:
    """(case_id, frames, sizes): maps of a case's roles to their frame and bytes. cases: case_id, role, source_id (the frame), size_bytes."""
    by = cases.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", F.col("source_id").cast("long"))))).alias("frames"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", F.col("size_bytes").cast("long"))))).alias("sizes"))
    return by


RESULT = ["mode", "case_id", "outcome", "outcome_reasons", "outcome_confidence", "prediction", "observation_count", "selected_source_bytes", "downloaded_bytes", "errors", "error_count", "evidence_id"]


def baselines(cases: DataFrame, pixels: DataFrame, **parameters) -> DataFrame:
    """One row for each fixed mode and case (RESULT). A case that lacks a role's source, or whose frame isn't in pixels, fails in that mode alone: outcome `failed`, prediction null, and errors say which."""
    roles = {m: list(r) for m, r in pipelines.MODE_ROLES.items()}
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.array(*map(F.lit, r)).alias("roles")) for m, r in roles.items()]))
    runs = numbered_runs(frames_of(cases).withColumn("m", modes).select("case_id", "frames", "sizes", "m.*"))
    known = pixels.select(F.col("frame_id").alias("f")).distinct()
    asked = runs.select("run_id", F.explode(F.transform("roles", lambda r: F.struct(r.alias("role"), F.try_element_at("frames", r).alias("frame")))).alias("x")).select("run_id", "x.*")
    gone = asked.join(known, F.col("frame") == F.col("f"), "left").where("f IS NULL").groupBy("run_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("source_missing: "), "role"))).alias("errors"))
    runs = runs.join(gone, "run_id", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
    outcome = pipelines.outcomes(packets_of(runs.where(F.size("errors") == 0), pixels, **parameters))
    done = runs.join(outcome.select("run_id", "outcome", "outcome_reasons", "outcome_confidence", F.col("content_hash").alias("evidence_id")), "run_id", "left")
    failed = F.size("errors") > 0
    total = F.aggregate(F.transform("roles", lambda r: F.coalesce(F.try_element_at("sizes", r), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    done = done.withColumns({
        "outcome": F.when(failed, "failed").otherwise(F.col("outcome")), "outcome_reasons": F.when(failed, F.array(F.lit("source_missing"))).otherwise(F.col("outcome_reasons")), "outcome_confidence": F.when(failed, 0.0).otherwise(F.col("outcome_confidence")),
        "observation_count": F.size("roles").cast("long"), "selected_source_bytes": total, "downloaded_bytes": F.lit(0).cast("long"), "error_count": F.size("errors"),
    })
    return done.withColumn("prediction", decide.prediction(F.col("outcome"))).select(*RESULT)


def adaptive(cases: DataFrame, pixels: DataFrame, limits: dict | None = None, checkpoints: DataFrame | None = None, **parameters) -> DataFrame:
    """One row for each case (RESULT) of the decision loop, which sees the evidence of whatever observations it has selected so far."""
    limits = LIMITS | (limits or {})
    allow = pipelines.tool_manifest(cases).withColumn("bytes", F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))
    # a type of action has one observation: the initial frame stands for the next one until it is taken
    listed = allow.where("observation_id <> 'initial'").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("action_type", "observation_id", "bytes"))).alias("allowlist"))
    every = [list(c) for n in range(1, 5) for c in combinations((*FRAMES, "alternate"), n)]
    chosen = F.explode(F.array(*[F.array(*map(F.lit, c)) for c in every]))
    have = lambda: F.forall("roles", lambda r: F.map_contains_key("frames", r))
    runs = numbered_runs(frames_of(cases).withColumn("roles", chosen).where(have()))
    facts = decide.snapshot(packets_of(runs, pixels, **parameters)).join(runs.select("run_id", "case_id", F.array_join(F.array_sort("roles"), ",").alias("selected_key")), "run_id")
    state = listed.withColumns({k: F.lit(v) for k, v in limits.items()})
    loop = decide.run_loop(state, facts.select("case_id", "selected_key", *decide.FACTS), int(limits["max_observations"]), checkpoints)
    found = loop.join(facts.select("case_id", F.col("selected_key").alias("k"), F.col("content_hash").alias("evidence_id")).withColumnRenamed("case_id", "c"), (F.col("case_id") == F.col("c")) & (F.array_join(F.array_sort("selected"), ",") == F.col("k")), "left")
    return found.select(
        F.lit("adaptive").alias("mode"), "case_id", "outcome", "outcome_reasons", "outcome_confidence", decide.prediction(F.col("outcome")).alias("prediction"), F.size("selected").cast("long").alias("observation_count"), F.col("used_bytes").alias("selected_source_bytes"),
        F.lit(0).cast("long").alias("downloaded_bytes"), F.array().cast("array<string>").alias("errors"), F.lit(0).alias("error_count"), "evidence_id",
    )


@dataclass(frozen=True)
class Evaluation:
    rows: DataFrame
    tables: DataFrame
    report: dict


def evaluate_frozen(cases: DataFrame, labels: DataFrame, pixels: DataFrame, limits: dict | None = None, **parameters) -> Evaluation:
    """All three modes over frozen cases (case_id, role, source_id, size_bytes) and their labels (case_id, split, label), scored, with the aggregate tables and a sealed report. Rows are written first, so what is sealed is what returns."""
    results = baselines(cases, pixels, **parameters).unionByName(adaptive(cases, pixels, limits, **parameters))
    scored = pipelines.score(results.join(labels.select("case_id", "split"), "case_id"), labels.select("case_id", "label")).withColumn("latency_milliseconds", F.lit(0.0))
    rows = written(scored, "evaluation-rows")
    tables = written(evaluate.tables(rows), "evaluation-tables")
    inputs = {"cases": fingerprint(cases), "labels": fingerprint(labels), "pixels": fingerprint(pixels)}
    return Evaluation(rows, tables, sealed_report(rows, tables, inputs, LIMITS | (limits or {}) | {k: repr(v) for k, v in parameters.items()}))


def sealed_report(rows: DataFrame, tables: DataFrame, inputs: dict[str, tuple[int, str]], configuration: dict) -> dict:
    """What the error analysis may rest on: digests of inputs, results and tables, sealed before it."""
    say = lambda x: {"rows": x[0], "sha256": x[1]}
    return records.sealed(RECORD | {"inputs": {k: say(v) for k, v in inputs.items()}, "configuration": configuration, "results": say(fingerprint(rows)), "tables": say(fingerprint(tables))})


def report_problems(report: dict, rows: DataFrame, tables: DataFrame, **inputs: DataFrame) -> list[str]:
    """Why a stored report doesn't hold: its seal, its kind, or inputs, results and tables that changed since. Empty if it holds."""
    found = [] if records.seal_holds(report) else ["seal"]
    found += [k for k, v in RECORD.items() if report.get(k) != v]
    for name, df in {**inputs, "results": rows, "tables": tables}.items():
        then = report.get(name) if name in ("results", "tables") else report.get("inputs", {}).get(name)
        if then != dict(zip(("rows", "sha256"), fingerprint(df), strict=True)):
            found.append(name)
    return found


def analysis(report: dict, evaluation_rows: DataFrame, tables: DataFrame, traces: DataFrame) -> dict[str, DataFrame]:
    """The error analysis of sealed results; a report that doesn't hold raises."""
    if wrong := report_problems(report, evaluation_rows, tables):
        raise ValueError(f"the report doesn't hold: {', '.join(wrong)}")
    return pipelines.error_analysis(evaluation_rows, traces)


def analysis_problems(stored: dict[str, DataFrame], evaluation_rows: DataFrame, traces: DataFrame) -> list[str]:
    """The tables of a stored error analysis that don't say what the results say, missing ones among them."""
    now = pipelines.error_analysis(evaluation_rows, traces)
    return sorted(n for n in now if n not in stored or fingerprint(stored[n]) != fingerprint(now[n]))
