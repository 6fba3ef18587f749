import datetime as dt
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from thermal_lake.functions import checks
from thermal_lake.plans import evaluation, pipelines

ROOT = Path(__file__).parents[1]
T0 = dt.datetime(2025, 1, 1, 12)


def frames(spark, hot):
    """Frames of 12 x 12 pixels with a hot block where `hot` says, None for a flat (blank) one."""
    rows = []
    for name, at in hot.items():
        for r in range(12):
            for c in range(12):
                base = 290 + ((r * 7 + c * 13) % 11) * 0.05
                block = at is not None and at[0] <= r < at[0] + 5 and at[1] <= c < at[1] + 5
                rows.append((name, r, c, 0.0 if at is None else 335.0 if block else base, 0.0 if at is None else 280 + ((r * 5 + c * 3) % 7) * 0.05, False, 30 + r * 0.01, -120 + c * 0.01))
    return spark.createDataFrame(rows, "frame_id long, row int, col int, v7 float, v14 float, invalid boolean, lat double, lon double")


def test_evidence_job(spark):
    p = frames(spark, {1: (3, 3), 2: (3, 3), 3: None, 4: (50, 50)})
    steps = spark.createDataFrame([(10, 0, 1), (10, 1, 2), (20, 0, 1), (20, 1, 3), (30, 0, 1), (30, 1, None), (40, 0, 4), (40, 1, 4)], "case_id long, step int, frame_id long")
    job = pipelines.evidence_job(p, steps, checks.Anomaly())
    out = {r["case_id"]: r for r in pipelines.outcomes(job.packets).collect()}
    assert (out[10]["outcome"], out[10]["prediction"], out[10]["persistence_count"]) == ("review_escalation", "positive", 2)
    assert out[20]["outcome"] == "insufficient_evidence"
    assert "frame_blank" in out[20]["reason_codes"]
    assert (out[30]["outcome"], out[30]["usable_observation_count"]) == ("insufficient_evidence", 1)
    assert (out[40]["outcome"], out[40]["prediction"]) == ("no_persistent_evidence", "control")
    again = pipelines.evidence_job(p.repartition(7), steps, checks.Anomaly()).packets.collect()
    assert {r["case_id"]: r["content_hash"] for r in again} == {r["case_id"]: r["content_hash"] for r in job.packets.collect()}


def test_evidence_job_on_other_grids(spark):
    """The second frame's grid stands three columns further east, so the same hot place has other columns; its companion band has a grid of half a pixel further."""
    p = frames(spark, {1: (3, 5), 2: (3, 2), 5: (3, 5)})
    east = F.when(F.col("frame_id") == 2, 0.03).when(F.col("frame_id") == 5, 50.0).otherwise(0.0)
    p = p.withColumn("lon", F.col("lon") + east)
    companion = p.select("frame_id", "row", "col", "v14", "invalid", (F.col("lat") + 0.004).alias("lat"), (F.col("lon") + 0.003).alias("lon"))
    steps = spark.createDataFrame([(10, 0, 1), (10, 1, 2), (20, 0, 1), (20, 1, 5), (30, 0, 1), (30, 1, 1)], "case_id long, step int, frame_id long")
    plain = {r["case_id"]: r for r in pipelines.evidence_job(p, steps).persistence.collect()}
    job = pipelines.evidence_job(p.drop("v14"), steps, companion=companion, align=True)
    found = {r["case_id"]: r for r in job.persistence.collect()}
    assert found[10]["mean_iou"] == 1.0 > plain[10]["mean_iou"]
    assert found[30]["mean_iou"] == plain[30]["mean_iou"] == 1.0
    out = {r["case_id"]: r for r in pipelines.outcomes(job.packets).collect()}
    assert (out[10]["outcome"], out[30]["outcome"]) == ("review_escalation", "review_escalation")
    assert (out[20]["outcome"], "alignment_failed" in out[20]["reason_codes"]) == ("insufficient_evidence", True)
    near = pipelines.with_companion(p.drop("v14"), companion.where("col < 6"), 0.6)
    bad = {(r["col"], r["invalid_companion"]) for r in near.where("frame_id = 1").select("col", "invalid_companion").distinct().collect()}
    assert {c for c, x in bad if not x} == set(range(6))
    cropped = pipelines.evidence_job(p, steps, window=(1, 11, 1, 12)).components.where("frame_id = 1").first()
    assert (cropped["box_y"], cropped["box_x"]) == (2, 4)


@pytest.fixture(scope="module")
def evaluated(spark):
    """Cases of four sources: a hot place that stays, one that comes later, none, and one whose sources are gone in part."""
    p = frames(spark, {1: (3, 3), 2: (3, 3), 3: (3, 3), 11: (50, 50), 12: (50, 50), 13: (3, 3), 21: (50, 50), 22: (50, 50), 23: (50, 50)})
    rows = [(c, role, f, 100 + i) for c, fs in (("hot", (1, 2, 3)), ("late", (11, 12, 13)), ("cold", (21, 22, 23)), ("gone", (1, 2, 99))) for i, (role, f) in enumerate(zip(("baseline", "initial", "later", "alternate"), (*fs, fs[1]), strict=True))]
    cases = spark.createDataFrame(rows + [("bare", "initial", 1, 5)], "case_id string, role string, source_id long, size_bytes long")
    labels = spark.createDataFrame([("hot", "test", "positive"), ("late", "test", "positive"), ("cold", "stress", "control"), ("gone", "stress", "positive"), ("bare", "test", "control")], "case_id string, split string, label string")
    return cases, labels, p, evaluation.evaluate_frozen(cases.where("case_id <> 'bare'"), labels, p)


def test_baselines_keep_failures_to_their_case(spark, evaluated):
    cases, _, p, _ = evaluated
    r = {(x["mode"], x["case_id"]): x for x in evaluation.baselines(cases, p).collect()}
    assert len(r) == 10
    assert r["fixed_bundle", "hot"]["outcome"] == "review_escalation"
    assert (r["fixed_bundle", "hot"]["observation_count"], r["fixed_bundle", "hot"]["selected_source_bytes"], r["fixed_bundle", "hot"]["error_count"]) == (4, 406, 0)
    assert (r["fixed_bundle", "gone"]["outcome"], r["fixed_bundle", "gone"]["errors"], r["fixed_bundle", "gone"]["prediction"]) == ("failed", ["source_missing: later"], None)
    assert r["one_shot", "gone"]["error_count"] == 0
    assert r["one_shot", "bare"]["errors"] == ["source_missing: alternate"]
    assert r["fixed_bundle", "bare"]["error_count"] == 3
    assert r["fixed_bundle", "cold"]["prediction"] == "control"


def test_three_modes_are_sealed_and_verified(spark, evaluated):
    cases, labels, p, e = evaluated
    cases = cases.where("case_id <> 'bare'")
    rows = {(x["mode"], x["case_id"]): x for x in e.rows.collect()}
    assert len(rows) == 12
    assert rows["adaptive", "hot"]["observation_count"] >= 2
    assert rows["adaptive", "hot"]["prediction"] == "positive"
    t = {(r["split"], r["mode"]): r for r in e.tables.collect()}
    assert t["combined", "adaptive"]["case_count"] == 4
    assert t["stress", "fixed_bundle"]["error_case_count"] == 1
    holds = evaluation.report_problems(e.report, e.rows, e.tables, cases=cases, labels=labels, pixels=p)
    assert holds == []
    assert evaluation.report_problems(e.report | {"analysis_status": "after"}, e.rows, e.tables) == ["seal", "analysis_status"]
    assert evaluation.report_problems(e.report, e.rows.limit(5), e.tables, labels=labels.limit(2)) == ["labels", "results"]
    traces = e.rows.where("mode = 'adaptive'").select("split", "case_id", F.lit("complete").alias("status"))
    found = evaluation.analysis(e.report, e.rows, e.tables, traces)
    assert found["coverage"].count() == 0
    assert evaluation.analysis_problems(found, e.rows, traces) == []
    changed = found | {"claims": found["claims"].withColumn("claim", F.lit("all is well"))}
    del changed["agent_value"]
    assert evaluation.analysis_problems(changed, e.rows, traces) == ["agent_value", "claims"]
    with pytest.raises(ValueError, match="results"):
        evaluation.analysis(e.report, e.rows.limit(3), e.tables, traces)


@pytest.fixture(scope="module")
def inputs(spark):
    """Daily events at one place, a window near each and a control window half a degree away on another day without a detection."""
    events, windows, detections = [], [], []
    for i in range(20):
        at = T0 + dt.timedelta(days=4 * i)
        events.append((i, at, at + dt.timedelta(minutes=30), 30.2, -119.8))
        detections.append((at, 30.2, -119.8))
        windows.append((100 + i, at + dt.timedelta(minutes=20), 30.3, -119.8, 20.0, 0.9))
        windows.append((200 + i, at + dt.timedelta(days=2), 31.5, -119.0, 22.0, 0.95))
    return (
        spark.createDataFrame(events, "event_id long, start_time timestamp, end_time timestamp, latitude double, longitude double"),
        spark.createDataFrame(windows, "window_id long, anchor_at timestamp, latitude double, longitude double, view_zenith_degrees double, usable_fraction double"),
        spark.createDataFrame(detections, "acquired_at timestamp, latitude double, longitude double"),
    )


def test_benchmark(spark, inputs):
    b = pipelines.build_benchmark(*inputs, count=12, seed=3)
    cases = b.cases.collect()
    assert len(cases) == 24
    assert pipelines.benchmark_problems(b, inputs[2]).count() == 0
    pairs = {(r["positive_id"], r["control_id"]) for r in b.pairs.collect()}
    seasons = {r["window_id"]: (r["season"], r["region_cell"]) for r in cases}
    assert all(seasons[p] == seasons[c] for p, c in pairs)
    assert pairs == {(r["positive_id"], r["control_id"]) for r in pipelines.build_benchmark(*[d.repartition(5) for d in inputs], count=12, seed=3).pairs.collect()}
    with pytest.raises(ValueError):
        pipelines.build_benchmark(*inputs, count=21, seed=3)
    near = inputs[2].unionByName(spark.createDataFrame([(T0 + dt.timedelta(days=2), 31.5, -119.0)], inputs[2].schema))
    wrong = pipelines.benchmark_problems(b, near).collect()
    assert {r["problem"] for r in wrong} <= {"detection near"}


def test_freeze(spark):
    rows = [(f"c{i:02d}", i // 4, f"cell{i // 4}", f"week{i // 8}", "positive" if i % 2 else "control", float(i)) for i in range(60)]
    cases = spark.createDataFrame(rows, "case_id string, event_id int, cell string, week string, label string, angle double")
    f = pipelines.freeze(cases, ["event_id", "cell", "week"], ["angle"], ["label"], "abc")
    assert f.leakage.where("groups_spanning_splits > 0").count() == 0
    assert {r["split"] for r in f.cases.select("split").distinct().collect()} == {"development", "test", "stress"}
    assert pipelines.frozen_problems(f).count() == 0
    assert f.blind.where("split = 'development'").count() == 0
    assert "label" not in f.blind.columns
    assert f.sample.count() == 10
    with pytest.raises(ValueError):
        pipelines.freeze(cases.withColumn("week", F.lit("w")), ["week"], ["angle"], ["label"], "abc")


def test_modes_and_manifest(spark):
    rows = [("c", r, f"s-{r}", 10) for r in ("baseline", "initial", "later", "alternate")] + [("d", "initial", "s", 5)]
    cases = spark.createDataFrame(rows, "case_id string, role string, source_id string, size_bytes long")
    s = pipelines.selected(cases).collect()
    assert len([r for r in s if r["case_id"] == "c" and r["error"] is None]) == 6
    assert len([r for r in s if r["case_id"] == "d" and r["error"] == "source_missing"]) == 4
    m = {r["observation_id"]: r for r in pipelines.tool_manifest(cases.where("case_id = 'c'")).collect()}
    assert [x["source_id"] for x in m["alternate"]["sources"]] == ["s-alternate", "s-initial"]
    assert m["later"]["action_type"] == "next_timestamp"


def test_failures_have_a_reason(spark):
    errors = ["No such file", "timeout after 3 s", "cancelled", "disk full", "SHA-256 differs", "what?", None]
    df = spark.createDataFrame([(e,) for e in errors], "e string").select(pipelines.failure_reason(F.col("e")).alias("r"))
    assert [r["r"] for r in df.collect()] == ["source_missing", "timeout", "cancelled", "artifact_write_failed", "source_corrupt", "configuration_invalid", None]


def test_time_limit_cancels(spark):
    slow = spark.range(4).repartition(4).mapInPandas(_sleep, "id long")
    with pytest.raises(Exception, match="(?i)cancel"), pipelines.time_limit(spark, "slow", 2.0):
        slow.collect()
    with pipelines.time_limit(spark, "quick", 60.0):
        assert spark.range(5).count() == 5


def _sleep(batches):
    import time

    for b in batches:
        time.sleep(20)
        yield b


def test_nothing_else_imports_the_text_operators():
    for p in [*ROOT.glob("thermal_lake/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p


def test_deciding_code_does_not_import_evaluation():
    text = (ROOT / "thermal_lake/operators/decide.py").read_text()
    assert "evaluate" not in text


def test_command_line_lists_queries():
    out = subprocess.run([sys.executable, "-m", "thermal_lake", "list"], cwd=ROOT, capture_output=True, text=True, env=os.environ, timeout=120)
    assert "frame_quality_reason" in out.stdout.split()


def test_command_line_pipelines(spark, evaluated, tmp_path, capsys):
    from thermal_lake.__main__ import main

    cases, labels, p, _ = evaluated
    folder, out = tmp_path / "in", tmp_path / "out"
    for name, df in (("cases", cases.where("case_id <> 'bare'")), ("labels", labels), ("pixels", p), ("steps", spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "case_id long, step int, frame_id long"))):
        df.write.parquet(f"{folder}/{name}.parquet")
    assert main(["evidence", str(folder), "--output", str(out)]) == 0
    assert spark.read.parquet(f"{out}/outcomes.parquet").first()["outcome"] == "review_escalation"
    assert main(["evidence", str(folder), "--output", str(out)]) == 0
    assert "outcomes unchanged" in capsys.readouterr().out
    assert main(["slice", str(folder), "--output", str(out)]) == 0
    report = tmp_path / "report.json"
    assert main(["frozen-evaluation", str(folder), "--output", str(tmp_path / "e"), "--report", str(report)]) == 0
    rows = spark.read.parquet(f"{tmp_path}/e/rows.parquet")
    rows.where("mode = 'adaptive'").select("split", "case_id", F.lit("complete").alias("status")).write.parquet(f"{tmp_path}/e/traces.parquet")
    assert main(["error-analysis", str(tmp_path / "e"), "--output", str(tmp_path / "a"), "--report", str(report)]) == 0
    assert spark.read.parquet(f"{tmp_path}/a/claims.parquet").count() == 3
    (tmp_path / "j.jsonl").write_text("not json\n{}\n")
    assert main(["replay", str(tmp_path / "j.jsonl")]) == 1
    from thermal_lake.sources import blobs

    blobs.BlobCache(tmp_path / "cache", lambda url: [b"x"])
    assert main(["cache-inspect", str(tmp_path / "cache")]) == 0
