import random

import duckdb
import pytest
from pyspark.sql import functions as F

from thermal_lake.functions.rounding import python_round, python_round_sql
from thermal_lake.operators import evaluate

SHAPE = "split string, case_id string, label string, mode string, prediction string, observation_count int, selected_source_bytes long, downloaded_bytes long, latency_milliseconds double, error_count int"


def row(case, label, mode, prediction, observations=2, split="test"):
    return (split, case, label, mode, prediction, observations, 10, 0, 1.5, 0)


def test_two_cases(spark):
    rows = [row("a", "positive", "one_shot", "positive"), row("b", "control", "one_shot", None), row("a", "positive", "adaptive", "positive"), row("b", "control", "adaptive", "control", 4)]
    t = {(r["split"], r["mode"]): r for r in evaluate.tables(spark.createDataFrame(rows, SHAPE)).collect()}
    one, adaptive = t["test", "one_shot"], t["combined", "adaptive"]
    assert (one["macro_f1"], one["abstention_coverage"]) == (0.5, 0.5)
    assert (adaptive["ambiguous_count"], adaptive["resolved_count"], adaptive["resolution_rate"]) == (1, 1, 1.0)
    assert adaptive["macro_f1"] == 1.0


@pytest.fixture(scope="module")
def four(spark):
    rows = []
    for case, label, split, by in (
        ("success", "positive", "test", (None, "positive", "positive")),
        ("control", "control", "test", ("control", "control", "control")),
        ("limit", "control", "stress", ("control", "control", "positive")),
        ("abstain", "positive", "stress", (None, "control", None)),
    ):
        for mode, p, n in zip(evaluate.MODES, by, (2, 4, 3), strict=True):
            rows.append(row(case, label, mode, p, n, split))
    return spark.createDataFrame(rows, SHAPE)


def test_error_tables(spark, four):
    e = {r["mode"]: r for r in evaluate.mode_efficiency(four).collect()}
    assert (e["fixed_bundle"]["recall"], e["adaptive"]["recall"], e["adaptive"]["mean_observation_count"]) == (0.5, 0.5, 3.0)
    w = {r["mode"]: r for r in evaluate.error_outcomes(four).collect()}["adaptive"]
    assert (w["false_positives"], w["decisive_false_negatives"], w["abstentions"], w["scoring_false_negatives"]) == (1, 0, 1, 1)
    v = {r["mode"]: r for r in evaluate.agent_value(four).collect()}["adaptive"]
    assert (v["improved"], v["regressed"], v["unchanged_correct"]) == (1, 1, 1)
    x = {r["case_id"]: r["reason"] for r in evaluate.extra_observations(four).collect()}
    assert set(x) == {"control", "limit", "abstain"}
    assert x["limit"].startswith("adaptive regressed")
    traces = spark.createDataFrame([("test", "success", "complete"), ("test", "control", "complete"), ("stress", "limit", "complete"), ("stress", "abstain", "torn")], "split string, case_id string, status string")
    r = {x["category"]: x["case_id"] for x in evaluate.representatives(four, traces).collect()}
    assert r == {"success": "success", "control": "control", "abstention": None, "genuine_limitation": "limit"}
    assert evaluate.coverage(four, four).count() == 0
    assert evaluate.claims(evaluate.mode_efficiency(four), evaluate.extra_observations(four), evaluate.error_outcomes(four)).count() == 3


def test_bootstraps(spark, four):
    exact = evaluate.seeded_bootstrap(four, 30, 1).collect()
    assert len(exact) == 9
    assert exact == evaluate.seeded_bootstrap(four.repartition(5), 30, 1).collect() or sorted(exact) == sorted(evaluate.seeded_bootstrap(four.repartition(5), 30, 1).collect())
    for r in exact:
        assert 0 <= r["macro_f1_lower"] <= r["macro_f1_upper"] <= 1
    for r in evaluate.bootstrap(four, 50, 1).collect():
        assert 0 <= r["lower"] <= r["upper"] <= 1


def test_leakage_and_histogram(spark):
    c = spark.createDataFrame([("a", "x", 1, 0.0), ("a", "y", 1, 90.0), ("b", "y", 2, 45.0)], "split string, k string, j int, v double")
    r = {x["axis"]: x for x in evaluate.leakage(c, ["k", "j"]).collect()}
    assert (r["k"]["groups_spanning_splits"], r["j"]["groups_spanning_splits"]) == (1, 0)
    h = {(x["split"], x["lower"]): x["n"] for x in evaluate.histogram(c, "v", 10.0, 0.0, 90.0).collect()}
    assert h["all", 80.0] == 1
    assert h["b", 40.0] == 1


def test_rounding_is_pythons(spark):
    """Ratios with denominators of powers of two and five stand on ties, or look as if they did."""
    rng = random.Random(31)
    x = [a / b for b in (64, 128, 256, 640, 2000000, 1280, 3, 7, 625) for a in range(1, 60)] + [rng.random() for _ in range(2000)] + [k / 1e6 + 5e-7 for k in range(500)] + [rng.randrange(10**7) / 1e7 for _ in range(2000)] + [0.0, 1.0, 89.9999995, 1500.1234565]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(python_round(F.col("v"))).collect()]
    want = [round(v, 6) for v in x]
    assert got == want
    c = duckdb.connect()
    assert [c.execute(f"SELECT {python_round_sql('v')} FROM (SELECT ?::DOUBLE AS v)", [v]).fetchone()[0] for v in x[:1500]] == want[:1500]
    assert [evaluate_one(spark, a, b) for a, b in ((1, 128), (3, 64), (5, 0))] == [round(1 / 128, 6), round(3 / 64, 6), 0.0]


def evaluate_one(spark, a, b):
    return spark.range(1).select(evaluate.ratio(F.lit(a), F.lit(b))).first()[0]


def test_metrics_equal_the_plain_ones_for_sixty_fourths(spark):
    rows = [row(str(k), "positive" if k % 3 else "control", m, None if k % 7 == 0 else "positive" if k % 2 else "control") for k in range(128) for m in evaluate.MODES]
    got = {r["mode"]: r for r in evaluate.tables(spark.createDataFrame(rows, SHAPE)).where("split = 'combined'").collect()}
    counts = {}
    for r in rows:
        if r[3] == "adaptive":
            counts[r[2], r[4]] = counts.get((r[2], r[4]), 0) + 1
    assert (got["adaptive"]["macro_f1"], got["adaptive"]["macro_precision"], got["adaptive"]["macro_recall"]) == evaluate._score(counts)
