import pytest
from pyspark.sql import functions as F

from thermal_lake.operators import decide

BUDGET = {"max_observations": 3, "used_observations": 1, "max_bytes": 100, "used_bytes": 1, "max_elapsed_seconds": 10.0, "used_elapsed_seconds": 1.0, "max_retries": 1, "used_retries": 0}
ALL = [("pre_event_baseline", "base"), ("alternate_band", "alt"), ("next_timestamp", "later")]
SHAPE = "reason_codes array<string>, persistence_count int, persistence_confidence double, last_accepted boolean, available array<struct<action_type: string, observation_id: string>>, max_observations int, used_observations int, max_bytes int, used_bytes int, max_elapsed_seconds double, used_elapsed_seconds double, max_retries int, used_retries int"


def decided(spark, reasons=(), count=0, confidence=0.0, accepted=None, available=ALL, **budget):
    b = BUDGET | budget
    row = (list(reasons), count, confidence, accepted, list(available), *[b[k] for k in ("max_observations", "used_observations", "max_bytes", "used_bytes", "max_elapsed_seconds", "used_elapsed_seconds", "max_retries", "used_retries")])
    r = decide.decide(spark.createDataFrame([row], SHAPE)).first()
    return r["rule"], r["action_type"], r["observation_id"], r


@pytest.mark.parametrize(
    ("given", "rule", "action", "observation"),
    [
        ({"accepted": False, "used_observations": 3}, "tool_failure_abstain", "abstain", None),
        ({"count": 2, "confidence": 0.9, "used_observations": 3}, "budget_exhausted_abstain", "abstain", None),
        ({"reasons": ["frame_blank"], "used_retries": 1}, "recovery_retry_exhausted_abstain", "abstain", None),
        ({"reasons": ["frame_blank"], "used_retries": 1, "available": []}, "no_followup_abstain", "abstain", None),
        ({"reasons": ["alignment_failed"]}, "poor_quality_retry", "next_timestamp", "later"),
        ({"reasons": ["bands_conflict"]}, "bands_conflict_alternate", "alternate_band", "alt"),
        ({"count": 2, "confidence": 0.5}, "persistent_evidence_review", "request_human_review", None),
        ({"count": 2, "confidence": 0.49, "reasons": ["no_persistent_evidence"]}, "absent_persistence_finalize", "finalize", None),
        ({"reasons": ["contrast_low"], "available": [("pre_event_baseline", "base")]}, "weak_contextual_followup", "pre_event_baseline", "base"),
        ({}, "no_decisive_evidence_followup", "next_timestamp", "later"),
        ({"available": [("alternate_band", "alt")]}, "no_followup_abstain", "abstain", None),
    ],
)
def test_rules(spark, given, rule, action, observation):
    r = decided(spark, **given)
    assert r[:3] == (rule, action, observation)
    chosen = [c for c in r[3]["considered"] if c["status"] == "selected"]
    assert len(chosen) == 1
    assert (chosen[0]["action_type"], chosen[0]["reason"]) == (action, r[3]["selection_reason"])


def outcome(spark, reasons=(), usable=2, regions=1, count=0, confidence=0.0, spent=False):
    row = (list(reasons), usable, regions, count, confidence, spent)
    return decide.calibrate(spark.createDataFrame([row], "reason_codes array<string>, usable_observation_count int, candidate_region_count int, persistence_count int, persistence_confidence double, budget_exhausted boolean")).first()


@pytest.mark.parametrize(
    ("given", "state", "confidence", "reasons"),
    [
        ({"reasons": ["timeout"], "count": 2, "confidence": 1.0}, "failed", 0.0, ["timeout"]),
        ({"spent": True, "confidence": 0.9}, "insufficient_evidence", 0.49, ["budget_exhausted", "insufficient_evidence"]),
        ({"reasons": ["contrast_low"], "confidence": 0.2}, "insufficient_evidence", 0.2, ["contrast_low", "insufficient_evidence"]),
        ({"reasons": ["alignment_failed"]}, "insufficient_evidence", 0.0, ["alignment_failed", "insufficient_evidence"]),
        ({"reasons": ["bands_conflict"]}, "human_review", 0.0, ["bands_conflict", "human_review_required"]),
        ({"usable": 1, "count": 2, "confidence": 0.9}, "insufficient_evidence", 0.49, ["insufficient_evidence"]),
        ({"count": 2, "confidence": 0.5}, "review_escalation", 0.5, ["thermal_evidence_persistent", "human_review_required"]),
        ({"count": 2, "confidence": 0.49}, "no_persistent_evidence", 0.0, ["thermal_anomaly_weak", "no_persistent_evidence"]),
        ({"regions": 0}, "no_persistent_evidence", 0.0, ["thermal_evidence_absent", "no_persistent_evidence"]),
    ],
)
def test_outcomes(spark, given, state, confidence, reasons):
    r = outcome(spark, **given)
    assert (r["outcome"], r["outcome_confidence"], r["outcome_reasons"]) == (state, confidence, reasons)
    assert r["explanation"].startswith(decide.OUTCOME_TEXT[state])
    assert r["explanation"].endswith(decide.REASON_TEXT[reasons[-1]])


def test_snapshot_counts_both_ways(spark):
    row = [(1, [(["valid", "contrast_low"], 2, 9), (["valid"], 1, 5)], (2, 0.7, ["alignment_failed"]))]
    r = decide.snapshot(spark.createDataFrame(row, "case_id long, observations array<struct<reason_codes: array<string>, component_count: long, candidate_pixels: long>>, persistence struct<count: int, confidence: double, reason_codes: array<string>>")).first()
    assert r["reason_codes"] == ["valid", "contrast_low", "alignment_failed"]
    assert (r["component_count"], r["candidate_region_count"], r["usable_observation_count"]) == (3, 14, 1)


def test_changes(spark):
    s = "struct<component_count: long, persistence_count: int, persistence_confidence: double, reason_codes: array<string>, evidence_ids: array<string>>"
    df = spark.createDataFrame([((1, 0, 0.0, ["a"], ["x"]), (1, 1, 0.0, ["a", "b"], ["x"])), (None, (1, 1, 0.0, ["a"], ["x"]))], f"a {s}, b {s}")
    got = df.select(F.transform(decide.changes(F.col("a"), F.col("b")), lambda c: c["field"]).alias("f")).collect()
    assert [r["f"] for r in got] == [["persistence_count", "reason_codes"], []]


# One case after the other, as a plain program would


def replay(case, facts):
    selected, used, retries, accepted, steps, spent = [], 0, 0, None, 0, 0.0
    while True:
        f = facts.get((case["case_id"], ",".join(sorted(selected))))
        steps += 0 if accepted is False else (2 if selected else 1)
        reasons, count, confidence = (f["reason_codes"], f["persistence_count"], f["persistence_confidence"]) if f else ([], 0, 0.0)
        open_ = {a["action_type"]: a for a in case["allowlist"] if a["observation_id"] not in selected}
        poor = set(reasons) & set(decide.POLICY_POOR)
        first = lambda *t: next((open_[x] for x in t if x in open_), None)
        retry = False
        if accepted is False or len(selected) >= case["max_observations"] or used >= case["max_bytes"] or spent >= case["max_elapsed_seconds"] or (poor and retries >= case["max_retries"] and open_):
            act = "abstain"
        elif poor:
            act = first("next_timestamp", "alternate_band", "pre_event_baseline") or "abstain"
            retry = act != "abstain"
        elif "bands_conflict" in reasons:
            act = first("alternate_band", "next_timestamp") or "abstain"
        elif count >= 2 and confidence >= 0.5:
            act = "request_human_review"
        elif set(reasons) & set(decide.ABSENT):
            act = "finalize"
        else:
            act = first("next_timestamp", "pre_event_baseline") or "abstain"
        steps += 2
        if isinstance(act, str):
            return act, ",".join(selected), used, retries, steps
        retries += retry
        begun = used + act["bytes"] <= case["max_bytes"] and spent < case["max_elapsed_seconds"]
        seconds = act.asDict().get("seconds", 0.0) if hasattr(act, "asDict") else 0.0
        accepted = begun and spent + seconds <= case["max_elapsed_seconds"]
        spent += seconds * begun
        if accepted:
            selected.append(act["observation_id"])
            used += act["bytes"]


def test_loop_is_the_replay(spark):
    from thermal_lake.plans import decision_queries as q

    seen = {}
    original = decide.run_loop

    def spy(cases, evidence, rounds):
        seen["cases"], seen["evidence"] = cases, evidence
        return original(cases, evidence, rounds)

    decide.run_loop = spy
    try:
        got = {r["case_id"]: r for r in q.agent_loop_outcomes(spark, "/root/testdata/sf0.001").collect()}
    finally:
        decide.run_loop = original
    facts = {(r["case_id"], r["selected_key"]): r.asDict() for r in seen["evidence"].collect()}
    cases = seen["cases"].collect()
    assert len(got) == len(cases)
    for c in cases:
        act, selected, used, retries, steps = replay(c, facts)
        r = got[c["case_id"]]
        assert (r["selected"], r["used_bytes"], r["used_retries"], r["transitions"]) == (selected, used, retries, steps)
        if act == "abstain":
            assert (r["outcome"], r["outcome_confidence"], r["final_state"]) == ("insufficient_evidence", 0.0, "abstain")
        if act == "request_human_review":
            assert r["outcome"] in ("review_escalation", "human_review")


def timed_cases(spark):
    from thermal_lake.plans import decision_queries as q

    seen = {}
    original = decide.run_loop
    decide.run_loop = lambda cases, evidence, rounds: seen.update(cases=cases, evidence=evidence) or cases.select("case_id", *[F.lit(None).alias(c) for c in ("outcome", "outcome_confidence", "final_state", "rule", "used_bytes", "used_retries", "transitions")], F.array().alias("selected"))
    try:
        q.agent_loop_outcomes(spark, "/root/testdata/sf0.001")
    finally:
        decide.run_loop = original
    timed = F.transform("allowlist", lambda a: a.withField("seconds", (F.col("case_id") % 7 * 10 + 5).cast("double")))
    return seen["cases"].withColumn("allowlist", timed).withColumn("max_elapsed_seconds", F.lit(60.0)), seen["evidence"]


def test_time_passes_and_is_a_budget(spark):
    cases, evidence = timed_cases(spark)
    got = {r["case_id"]: r for r in decide.run_loop(cases, evidence, 3).collect()}
    facts = {(r["case_id"], r["selected_key"]): r.asDict() for r in evidence.collect()}
    rows = cases.collect()
    for c in rows:
        act, selected, used, retries, steps = replay(c, facts)
        r = got[c["case_id"]]
        assert (",".join(r["selected"]), r["used_bytes"], r["used_retries"], r["transitions"]) == (selected, used, retries, steps)
        assert r["used_elapsed_seconds"] >= 0
    assert any(r["used_elapsed_seconds"] > 60 for r in got.values())
    assert len({r["used_elapsed_seconds"] for r in got.values()}) > 5


def test_a_loop_goes_on_from_its_checkpoint(spark):
    cases, evidence = timed_cases(spark)
    key = lambda rows: sorted((r["case_id"], r["outcome"], tuple(r["selected"]), r["used_bytes"], r["used_elapsed_seconds"], r["transitions"]) for r in rows)
    whole = key(decide.run_loop(cases, evidence, 3).collect())
    finished, going = decide.advance(decide.started(cases), evidence)
    kept = spark.createDataFrame(decide.checkpoint(going).collect(), decide.checkpoint(going).schema)
    rest = decide.run_loop(cases.join(finished.select("case_id"), "case_id", "left_anti"), evidence, 3, kept)
    assert key(finished.collect() + rest.collect()) == whole
    one = kept.limit(1)
    some = spark.createDataFrame(one.collect(), one.schema)
    for wrong in (
        some.withColumn("stored_max_observations", F.lit(9)), some.withColumn("stored_max_elapsed_seconds", F.lit(9.0)), some.withColumn("selected", F.array(F.lit("later"), F.lit("later"))), some.withColumn("selected", F.array(F.lit("elsewhere"))),
        some.withColumn("used_bytes", F.lit(10**9)), some.withColumn("case_id", F.lit(-1).cast("long")),
    ):
        with pytest.raises(Exception, match="can't resume"):
            decide.resumed(cases, wrong).collect()
