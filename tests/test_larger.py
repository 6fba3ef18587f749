"""Queries over rows that larger tables have, held against their SQL."""

import pytest

from tests import oracle
from thermal_lake import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """Events of users whose longitudes go beyond 180 degrees, some of them once around the Earth."""
    folder = str(tmp_path_factory.mktemp("users"))
    for t in oracle.TABLES:
        df = spark.read.parquet(f"{FOLDER}/{t}.parquet")
        if t == "events":
            df = df.selectExpr("event_id", "ts", "user_id", "event_type", "value", "props").unionAll(df.selectExpr("event_id + 1000 AS event_id", "ts", "user_id + 25000 + 3800 * (event_id % 2) AS user_id", "event_type", "value", "props"))
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", ["detections_normalised", "detections_invalid_rows", "event_clusters", "event_clusters_all"])
def test_places_of_many_users(spark, many_users, name):
    c = oracle.duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{many_users}/events.parquet/*.parquet')")
    oracle.check(catalog.QUERIES[name](spark, many_users), c, catalog.ORACLES[name])


def test_built_benchmark_finds_its_candidates_once(spark, monkeypatch):
    """Whatever reads the candidates reads a written table: one assignment, one place where rows are tested for nearness."""
    from thermal_lake.operators import relate

    plans, real = [], relate.maximum_matching
    monkeypatch.setattr(relate, "maximum_matching", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    assert catalog.QUERIES["built_benchmark"](spark, FOLDER).count() > 0
    assert plans and not any(x in p for p in plans for x in ("FlatMapGroupsInArrow", "l_shipdate"))


def test_leaks_hash_a_text_once(spark):
    """No step hashes the words of all texts a second time: a condition on them would be asked where texts are read."""
    from pyspark.sql import functions as F

    from thermal_lake.llm import decontaminate

    texts = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None), (4, " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    hashed = texts.select("doc_id", decontaminate.word_hashes(F.col("text")).alias("words"))
    found = decontaminate.windows(hashed, "words", list(decontaminate.MASKS), ["doc_id"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {r[0] for r in found.where("window IS NOT NULL").select("doc_id").distinct().collect()} == {4}


def test_anti_join_is_of_rows_and_explodes_none(spark, monkeypatch):
    """Every row is asked for itself, also under an id that repeats; windows are not multiplied by cells and times, whichever way places are joined."""
    import math
    import random
    from datetime import datetime, timedelta

    from thermal_lake.operators import relate

    rng, day = random.Random(5), datetime(2024, 5, 1)
    place = lambda: (30 + rng.randrange(12) * 0.25, -120 + rng.randrange(12) * 0.25)
    windows = [(i % 150, day + timedelta(hours=rng.randrange(400)), *place()) for i in range(300)] + [(900, day, None, 1.0), (901, None, 30.0, -120.0)]
    seen = [(day + timedelta(hours=rng.randrange(400), microseconds=rng.choice((0, 1))), *place()) for _ in range(60)] + [(None, 30.0, -120.0)]

    def far(w, d):
        if None in w or None in d or abs(w[1] - d[0]) > timedelta(hours=24):
            return True
        a, b = math.radians(w[2]), math.radians(d[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(d[2] - w[3]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h)) > 50

    want = sorted(w[0] for w in windows if all(far(w, d) for d in seen))
    w, d = spark.createDataFrame(windows, "window_id long, anchor_at timestamp, latitude double, longitude double"), spark.createDataFrame(seen, "acquired_at timestamp, latitude double, longitude double")
    for few in (relate.FEW_PLACES, 0):
        monkeypatch.setattr(relate, "FEW_PLACES", few)
        found = relate.without_detections(w, d)
        assert found.columns == w.columns and sorted(r[0] for r in found.collect()) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # of the written buckets
    assert len(want) > len(set(want))


def test_candidates_meet_in_bins(spark):
    """Windows of a block don't all meet: bins of zenith and usable fraction are keys of the join, and lose no pair at their edges."""
    from datetime import datetime

    from thermal_lake.operators import relate

    at = datetime(2024, 5, 1)
    rows = [(i, at, 30.5, -120.5, i * 7 % 90 + (0.5 if i % 11 == 0 else 0.0), i * 13 % 101 / 100) for i in range(400)] + [(1000, at, 30.5, -120.5, float("nan"), 0.5), (1001, at, 30.5, -120.5, float("inf"), 0.5), (1002, at, 30.5, -120.5, -30.0, 0.5)]
    kind = "window_id long, anchor_at timestamp, latitude double, longitude double, view_zenith_degrees double, usable_fraction double"
    found = relate.match_candidates(spark.createDataFrame(rows[::2], kind), spark.createDataFrame(rows[1::2], kind))
    want = sorted((a[0], b[0]) for a in rows[::2] for b in rows[1::2] if abs(a[4] - b[4]) <= 10.0 and abs(a[5] - b[5]) <= 0.10)
    assert sorted((r[0], r[1]) for r in found.collect()) == want and want
    join = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert "(_z" in join and "(_u" in join


def test_events_that_repeat_make_no_pairs(spark, monkeypatch):
    """Ids of several events ask at their first start, then at later ones, over areas that one start of them connects; no pair of rows is made."""
    import random
    from datetime import datetime, timedelta

    from thermal_lake.operators import relate

    rng, day = random.Random(3), datetime(2024, 5, 1)
    place = lambda: (30 + rng.randrange(3) * 0.7, -120 + rng.randrange(2) * 0.7)
    at = lambda: day + timedelta(days=rng.randrange(8), minutes=30 * rng.randrange(6))
    events = [(rng.randrange(120), t, t + timedelta(minutes=60), *place()) for t in (at() for _ in range(300))]
    windows = [(i, at(), *place()) for i in range(90)]
    assert len({(e[0], e[1]) for e in events}) < len({(e[0], e[1], *e[3:]) for e in events})
    e = spark.createDataFrame(events, "event_id long, start_time timestamp, end_time timestamp, latitude double, longitude double")
    w = spark.createDataFrame(windows, "window_id long, anchor_at timestamp, latitude double, longitude double")
    want = sorted(map(tuple, relate.greedy_assignment(relate.positive_candidates(e, w)).collect()))
    monkeypatch.setattr(relate, "positive_candidates", None)
    assert sorted(map(tuple, relate.nearest_free(e, w).collect())) == want and want


def test_built_benchmark_makes_no_pairs(spark, monkeypatch):
    """Events take windows, and positives controls, without a row for every pair that could be."""
    from thermal_lake.operators import relate

    for name in ("positive_candidates", "match_candidates", "greedy_assignment"):
        monkeypatch.setattr(relate, name, None)
    assert catalog.QUERIES["built_benchmark"](spark, FOLDER).count() > 0
