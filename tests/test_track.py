import numpy as np
import pytest

from thermal_lake.functions import checks
from thermal_lake.operators import track


def regions(step, label, rows, cols, temperature=320.0, case=1):
    cells = [r * 20 + c for r in rows for c in cols]
    return (case, step, label, len(cells), float(np.mean(list(rows))) * 0.01, float(np.mean(list(cols))) * 0.01, temperature, cells)


SHAPE = "case_id long, step int, label int, area int, lat double, lon double, temperature double, cells array<int>"


def run(spark, missing, found, p=None):
    f = spark.createDataFrame([(1, i, m) for i, m in enumerate(missing)], "case_id long, step int, missing boolean")
    t = track.tracks(f, spark.createDataFrame(found, SHAPE), p or checks.Persistence())
    return t.orderBy("track_id").collect(), track.persistence(f, t).first()


def test_persistent_region(spark):
    t, s = run(spark, [False, False], [regions(0, 1, range(3, 6), range(3, 6)), regions(1, 1, range(3, 6), range(3, 6), 322.0)])
    assert (s["persistence_count"], s["mean_iou"], s["confidence"], s["area_trend"], s["temperature_trend"]) == (2, 1.0, 1.0, 0.0, 2.0)
    assert not s["disappeared"]


def test_region_that_goes(spark):
    t, s = run(spark, [False, False], [regions(0, 1, range(3), range(3))])
    assert (s["persistence_count"], s["confidence"], s["disappeared"]) == (1, 0.0, True)
    assert t[0]["disappeared_at"] == 1


def test_a_missing_frame_ends_tracks_without_disappearance(spark):
    t, s = run(spark, [False, True, False], [regions(0, 1, range(3), range(3)), regions(2, 1, range(3), range(3))])
    assert len(t) == 2
    assert not s["disappeared"]
    assert s["missing_count"] == 1


def test_partial_overlap(spark):
    t, s = run(spark, [False, False], [regions(0, 1, range(4), range(3, 7)), regions(1, 1, range(4), range(6, 10))], checks.Persistence(minimum_iou=0.01))
    assert s["mean_iou"] == pytest.approx(4 / 28)
    assert 0 < s["confidence"] < 0.2


def test_greedy_prefers_overlap_then_distance():
    box = lambda cells, lat: {"area": len(cells), "lat": lat, "lon": 0.0, "temperature": 0.0, "cells": frozenset(cells)}
    tracks, matches = track.follow([{1: box([1, 2, 3], 0.0), 2: box([3, 4], 0.0)}, {1: box([1, 2, 3], 0.0), 2: box([4], 0.0)}], checks.Persistence())
    assert [(m["earlier"], m["later"]) for m in matches] == [(1, 1), (2, 2)]
    assert len(tracks) == 2


def test_overlaps_by_join(spark):
    cells = spark.createDataFrame([(1, 0, 1, c) for c in range(4)] + [(1, 1, 1, c) for c in range(2, 6)], "case_id long, step int, label int, cell int")
    r = track.overlaps(cells).first()
    assert (r["shared"], r["iou"]) == (2, pytest.approx(2 / 6))


def test_regrid_asks_validity_after_nearness(spark):
    tile = [(1, [0.0, 0.0], [0.0, 1.0], [10.0, 20.0], [False, True])]
    s = spark.createDataFrame(tile, "frame_id long, lat array<double>, lon array<double>, value array<double>, valid array<boolean>")
    t = spark.createDataFrame([(1, [0.0, 0.0, 5.0], [0.1, 0.9, 5.0])], "frame_id long, lat array<double>, lon array<double>")
    r = track.regrid(s, t, ["frame_id"], 30.0).first()
    assert r["value"] == [None, 20.0, None]
    assert r["mapped"] == 2
    far = track.regrid(s, spark.createDataFrame([(1, [20.0], [0.0])], "frame_id long, lat array<double>, lon array<double>"), ["frame_id"], 1.0).first()
    assert far["mapped"] == 0


def test_nearest_source_wraps_and_takes_the_first():
    at = track.nearest_source(np.array([0.0, 0.0]), np.array([179.9, -179.9]), np.array([0.0]), np.array([180.0]), 50)
    assert at.tolist() == [0]


def test_regridding_pixels_broadcasts_nothing(spark):
    """A small table may explode into many pixels; all places as the loop finds them, at the pole and across 180 degrees too."""
    rng = np.random.default_rng(5)
    lat, lon = np.concatenate((rng.uniform(29, 31, 150), rng.uniform(88, 90, 50))), np.concatenate((rng.uniform(-181, -179, 150), rng.uniform(-180, 180, 50)))
    rows = [(1, k, float(a), float((o + 180) % 360 - 180), float(k), k % 7 != 0) for k, (a, o) in enumerate(zip(lat, lon, strict=True))]
    s = spark.createDataFrame(rows[::2], "frame_id long, source long, lat double, lon double, value double, valid boolean")
    t = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in rows[1::2]], "frame_id long, target long, lat double, lon double")
    found = track.regrid_pixels(s, t, "frame_id", 25.0)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    place = lambda some, k: np.array([r[k] for r in some])
    at = track.nearest_source(place(rows[::2], 2), place(rows[::2], 3), place(rows[1::2], 2), place(rows[1::2], 3), 25.0)
    want = {r[1]: rows[::2][i][4] if i >= 0 and rows[::2][i][5] else None for r, i in zip(rows[1::2], at, strict=True)}
    assert {r["target"]: r["value"] for r in found.collect()} == want
    assert 10 < sum(i >= 0 for i in at) < len(at)
