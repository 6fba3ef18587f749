import pathlib
import types
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from thermal_lake.operators import graph, relate
from thermal_lake.sources import catalog

T0 = dt.datetime(2025, 1, 1)


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def test_as_of_boundaries(spark):
    at = lambda h, m, s=0: T0 + dt.timedelta(hours=h, minutes=m, seconds=s)
    scans = spark.createDataFrame([(at(0, 0), "C07", "a"), (at(0, 10), "C07", "b"), (at(0, 0), "C14", "c")], "scan_start timestamp, channel string, object_key string")
    asked = [(1, at(0, 4, 59), "C07"), (2, at(0, 5), "C07"), (3, at(0, 5, 1), "C07"), (4, at(0, 20), "C07"), (5, at(5, 0), "C07"), (6, at(0, 3), "C14")]
    r = {x["id"]: x for x in relate.nearest_scans(spark.createDataFrame(asked, "id int, at timestamp, channel string"), scans, "id", "at", "channel", 300_000_000).collect()}
    assert [r[i]["object_key"] for i in range(1, 7)] == ["a", "a", "b", None, None, "c"]
    assert (r[4]["missing_reason"], r[4]["candidate_count"]) == ("outside_maximum_offset", 2)
    assert (r[5]["missing_reason"], r[5]["candidate_count"]) == ("no_matching_objects", 0)


def test_as_of_makes_no_pairs(spark):
    """Scans of one start, ties before and after, requests on a start, hours that touch, and no join of requests with scans' hours."""
    rng = random.Random(9)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(4 * 360) * 10)
    scans = [(at(), rng.choice(["C07", "C14"]), f"k{i}") for i in range(300)]
    asked = [(i, at(), rng.choice(["C07", "C14", "C01"])) for i in range(200)] + [(200, None, "C07"), (201, T0 + dt.timedelta(hours=5), "C07"), (3, at(), "C14")]
    hour = lambda t: t.replace(minute=0, second=0)
    want = []
    limit = dt.timedelta(seconds=600)
    for i, _, _ in asked:
        met = [(abs(s - t), s, k) for j, t, c in asked if j == i and t for s, d, k in scans if c == d and hour(t - limit) <= hour(s) <= hour(t + limit)]
        best = min(met, default=None)
        near = best is not None and best[0] <= limit
        want.append((i, best[1] if near else None, best[2] if near else None, "no_matching_objects" if best is None else None if near else "outside_maximum_offset", len(met)))
    s = spark.createDataFrame(scans, "scan_start timestamp, channel string, object_key string")
    found = relate.nearest_scans(spark.createDataFrame(asked, "id int, at timestamp, channel string"), s, "id", "at", "channel", 600_000_000)
    assert sorted(map(repr, want)) == sorted(repr((r["id"], r["scan_start"], r["object_key"], r["missing_reason"], r["candidate_count"])) for r in found.collect())
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert not any("_hour" in x for x in joins)
    assert any("Window" in x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_candidates_explode_places_not_rows(spark, monkeypatch):
    rows = [(i, T0 + dt.timedelta(minutes=37 * (i % 50)), 30 + (i % 4) * 0.1, -120.0) for i in range(300)]
    seen, real = [], relate.near_cells
    monkeypatch.setattr(relate, "near_cells", lambda df, *a: seen.append(df.count()) or real(df, *a))
    e = spark.createDataFrame([(i, t, t + dt.timedelta(minutes=200 * (i % 3)), a, o) for i, t, a, o in rows], "event_id long, start_time timestamp, end_time timestamp, latitude double, longitude double")
    w = spark.createDataFrame(rows, "window_id long, anchor_at timestamp, latitude double, longitude double")
    got = {(r["event_id"], r["window_id"], r["distance_micros"]) for r in relate.positive_candidates(e, w).collect()}
    late = lambda t, end, m: 0 if t <= m <= end else min(abs(m - t), abs(m - end)) // dt.timedelta(microseconds=1)
    every = {(i, j, late(t, t + dt.timedelta(minutes=200 * (i % 3)), m)) for i, t, a, o in rows for j, m, b, q in rows if km((a, o), (b, q)) <= 25}
    assert got == {x for x in every if x[2] <= 90 * 60_000_000}
    assert max(seen) == 4


def test_object_keys(spark):
    good = spark.createDataFrame([(dt.datetime(2024, 12, 31, 23, 59, 50), "C07")], "at timestamp, channel string").select(catalog.object_key(F.col("at"), F.col("channel")).alias("object_key")).first()[0]
    keys = [good, good.replace("C07", "C08"), good.replace("/366/", "/365/"), "x.nc", good.replace("_s2024366", "_s2024999"), None]
    r = catalog.parsed(spark.createDataFrame([(k,) for k in keys], "object_key string")).collect()
    assert r[0]["error"] is None
    assert r[0]["scan_start"] == dt.datetime(2024, 12, 31, 23, 59, 50)
    assert [x["error"] for x in r[1:]] == ["unsupported channel", "path and scan disagree", "not a key of the product", "not a time", "not a key of the product"]


def points(n, seed, spread=0.4):
    rng = random.Random(seed)
    return [(i, T0 + dt.timedelta(minutes=rng.randrange(600)), 30 + rng.random() * spread, -120 + rng.random() * spread) for i in range(n)]


def test_single_linkage_is_exact(spark):
    rows = points(150, 1)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a[0] < b[0] and abs(a[1] - b[1]) <= dt.timedelta(minutes=60) and km(a[2:], b[2:]) <= 10:
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    df = spark.createDataFrame(rows, "detection_id long, acquired_at timestamp, latitude double, longitude double")
    got = {r["detection_id"]: r["cluster"] for r in relate.single_linkage(df).collect()}
    assert got == {r[0]: find(r[0]) for r in rows}
    assert 1 < len(set(got.values())) < len(rows)


def test_greedy_assignment_is_the_loop(spark):
    events = [(i, t, t + dt.timedelta(minutes=30), a, o) for i, t, a, o in points(60, 2)]
    windows = [(1000 + i, t, a, o) for i, t, a, o in points(60, 3)]
    e = spark.createDataFrame(events, "event_id long, start_time timestamp, end_time timestamp, latitude double, longitude double")
    w = spark.createDataFrame(windows, "window_id long, anchor_at timestamp, latitude double, longitude double")
    pairs = relate.positive_candidates(e, w)
    used, want = set(), set()
    late = lambda x, m: dt.timedelta(0) if x[1] <= m <= x[2] else min(abs(m - x[1]), abs(m - x[2]))
    every = {(x[0], y[0]) for x in events for y in windows if late(x, y[1]) <= dt.timedelta(minutes=90) and km(x[3:], y[2:]) <= 25}
    assert {(r["event_id"], r["window_id"]) for r in pairs.collect()} == every
    for x in sorted(events, key=lambda x: (x[1], x[0])):
        options = [y for y in windows if (x[0], y[0]) in every and y[0] not in used]
        if options:
            y = min(options, key=lambda y: (late(x, y[1]), km(x[3:], y[2:]), y[0]))
            used.add(y[0])
            want.add((x[0], y[0]))
    assert {(r["event_id"], r["window_id"]) for r in relate.greedy_assignment(pairs).collect()} == want


def test_anti_join(spark):
    w = spark.createDataFrame([(i, t, a, o) for i, t, a, o in points(40, 4, 3.0)], "window_id long, anchor_at timestamp, latitude double, longitude double")
    d = points(15, 5, 3.0)
    got = {r["window_id"] for r in relate.without_detections(w, spark.createDataFrame(d, "i long, acquired_at timestamp, latitude double, longitude double")).collect()}
    assert got == {i for i, t, a, o in points(40, 4, 3.0) if not any(abs(t - x[1]) <= dt.timedelta(hours=24) and km((a, o), x[2:]) <= 50 for x in d)}


def test_maximum_matching(spark):
    rng = random.Random(6)
    edges = {(p, 100 + c) for p in range(12) for c in range(12) if rng.random() < 0.18}
    df = spark.createDataFrame([(p, c, "DJF", "x") for p, c in edges], "positive_id long, control_id long, season string, region_cell string")
    got = [(r["positive_id"], r["control_id"]) for r in relate.maximum_matching(df).collect()]
    assert len({p for p, _ in got}) == len({c for _, c in got}) == len(got)
    assert set(got) <= edges
    best = {}

    def place(p, seen):
        for q, c in sorted(edges):
            if q == p and c not in seen:
                seen.add(c)
                if c not in best or place(best[c], seen):
                    best[c] = p
                    return True
        return False

    assert len(got) == sum(place(p, set()) for p in range(12))


def test_matched_windows_are_the_matching_of_the_pairs(spark):
    """Many windows alike, two seasons and two cells, repeated ids; no pair is made."""
    rng = random.Random(31)
    rows = [(i % 180, T0 + dt.timedelta(days=rng.choice([0, 100]), hours=rng.randrange(4)), 30.0, rng.choice([-120.0, -110.0]), float(rng.randrange(30, 60, 3)), rng.randrange(5) / 10) for i in range(200)]
    w = spark.createDataFrame(rows, "window_id long, anchor_at timestamp, latitude double, longitude double, view_zenith_degrees double, usable_fraction double")
    sides = w.where("view_zenith_degrees < 45"), w.where("view_zenith_degrees >= 45")
    want = sorted(map(tuple, relate.maximum_matching(relate.match_candidates(*sides)).collect()))
    found = relate.matched_windows(*sides)
    assert want == sorted(map(tuple, found.collect()))
    assert len(want) > 20
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert relate.matched_windows(sides[0], sides[1].limit(0)).count() == 0


@pytest.mark.parametrize("few", [relate.FEW_PLACES, 0])
@pytest.mark.parametrize("repeated", [False, True])
def test_nearest_free_is_the_assignment_of_the_pairs(spark, monkeypatch, few, repeated):
    """Rows of one place and time, equal distances, an event that ends before it starts, null places, and ids with several places; pairs of rows are made for these alone."""
    monkeypatch.setattr(relate, "FEW_PLACES", few)
    rng = random.Random(17)
    at = lambda: T0 + dt.timedelta(minutes=15 * rng.randrange(200))
    place = lambda: (30 + rng.randrange(6) * 0.2, -120 + rng.randrange(2) * 0.2)
    starts = [at() for _ in range(140)]
    e = [(i % 120 if repeated else i, t, t + dt.timedelta(minutes=30 * (i % 4 - 1)), *place()) for i, t in enumerate(starts)] + [(500, T0, T0, None, -120.0), (501, None, None, 30.0, -120.0)]
    w = [(i % 90 if repeated else i, at(), *place()) for i in range(100)]
    events = spark.createDataFrame(e, "event_id long, start_time timestamp, end_time timestamp, latitude double, longitude double")
    windows = spark.createDataFrame(w, "window_id long, anchor_at timestamp, latitude double, longitude double")
    want = sorted(map(tuple, relate.greedy_assignment(relate.positive_candidates(events, windows)).collect()))
    if not repeated:
        monkeypatch.setattr(relate, "positive_candidates", None)
    assert sorted(map(tuple, relate.nearest_free(events, windows).collect())) == want
    assert len(want) > 50


@pytest.mark.parametrize("one", [graph.ONE_TASK, 0])
def test_components_of_a_long_chain_and_a_hot_star(spark, monkeypatch, one):
    monkeypatch.setattr(graph, "ONE_TASK", one)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(v == (0 if k < 1000 else 1000) for k, v in got.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("held", "one"), [(graph.HELD, graph.ONE_TASK), (graph.HELD, 0), (3, 0)])
def test_hot_nodes_are_split_and_old_rounds_deleted(spark, monkeypatch, held, one):
    import random

    monkeypatch.setattr(graph, "ONE_TASK", one)
    monkeypatch.setattr(graph, "HOT_ROWS", 8)
    monkeypatch.setattr(graph, "HELD", held)
    rng = random.Random(3)
    edges = [(5, k) for k in range(100, 300)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (120, 455)] + [(rng.randrange(1000, 1040), rng.randrange(1000, 1040)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    before = set(pathlib.Path(graph.shared_folder(spark).removeprefix("file:")).iterdir())
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "split").collect()}
    assert got == {x: find(x) for x in parent}
    assert len(set(pathlib.Path(graph.shared_folder(spark).removeprefix("file:")).iterdir()) - before) == 1


def test_scratch_tables_are_deleted_but_for_those_kept(spark):
    folder = pathlib.Path(graph.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with graph.scratch(spark) as outer:
        with graph.scratch(spark) as keep:
            gone, inner, last = (graph.written(spark.range(n), "scratch") for n in (1, 2, 3))
            keep(inner), keep(last)
        assert len(set(folder.iterdir()) - before) == 2
        assert outer(last).count() == 3
    assert len(set(folder.iterdir()) - before) == 1
    assert last.count() == 3
    with pytest.raises(ZeroDivisionError), graph.scratch(spark):
        graph.written(spark.range(1), "scratch")
        1 / 0
    assert len(set(folder.iterdir()) - before) == 1
    assert gone is not inner


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(Conf)  # noqa: N815
        _jsc = types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: False)))

    with pytest.raises(RuntimeError):
        graph.shared_folder(types.SimpleNamespace(sparkContext=Context()))


def test_allocation_is_the_fold(spark):
    import hashlib

    sizes = [9, 7, 7, 5, 4, 3, 3, 2, 1, 1]
    rows = [(f"c{k}-{i}", f"r{k}") for k, n in enumerate(sizes) for i in range(n)]
    got = {r["case_id"]: r["split"] for r in graph.allocate(spark.createDataFrame(rows, "case_id string, root string"), "case_id").collect()}
    comps = {}
    for c, r in rows:
        comps.setdefault(r, []).append(c)
    order = sorted(comps.values(), key=lambda x: (-len(x), hashlib.sha256("\0".join(sorted(x)).encode()).hexdigest()))
    filled, want = dict.fromkeys(graph.SPLITS, 0), {}
    for i, x in enumerate(order):
        s = list(graph.SPLITS)[i] if i < 3 else min(graph.SPLITS, key=lambda s: (filled[s] / graph.SPLITS[s], list(graph.SPLITS).index(s)))
        filled[s] += len(x)
        want |= dict.fromkeys(x, s)
    assert got == want
    with pytest.raises(ValueError):
        graph.allocate(spark.createDataFrame(rows[:9], "case_id string, root string"), "case_id")
