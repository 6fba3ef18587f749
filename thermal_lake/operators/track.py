"""Regridding, region overlap, and tracking of regions through time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thermal_lake.functions import checks, geo
from thermal_lake.shipping import ship


def haversine(lat_a, lon_a, lat_b, lon_b) -> np.ndarray:
    """Kilometres, with the longitude difference wrapped."""
    a, b = np.deg2rad(lat_a), np.deg2rad(lat_b)
    d = np.deg2rad((np.asarray(lon_b) - lon_a + 180) % 360 - 180)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(d / 2) ** 2
    return 2 * geo.RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def nearest_source(lat: np.ndarray, lon: np.ndarray, target_lat: np.ndarray, target_lon: np.ndarray, km: float, chunk: int = 1024) -> np.ndarray:
    """For each target place the index of the nearest geolocated source place (the first of equals), -1 beyond km or if it isn't geolocated."""
    out = np.full(target_lat.size, -1, dtype=np.int64)
    there, asked = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon)), np.flatnonzero(np.isfinite(target_lat) & np.isfinite(target_lon))
    if there.size:
        for s in range(0, asked.size, chunk):
            at = asked[s : s + chunk]
            d = haversine(target_lat[at, None], target_lon[at, None], lat[None, there], lon[None, there])
            best = d.argmin(1)
            near = d[np.arange(len(at)), best] <= km
            out[at[near]] = there[best[near]]
    return out


def regrid(sources: DataFrame, targets: DataFrame, by: list[str], km: float = 5.0) -> DataFrame:
    """Values of source tiles (lat, lon, value, valid as arrays) on the grid of target tiles (lat, lon) of the same keys: keys, value, valid, mapped.

    The nearest geolocated source pixel is taken, and whether it is valid is asked only then: a nearest but invalid pixel makes the target
    invalid. One tile pair is one kernel call, in chunks.
    """
    ship(sources.sparkSession)
    t = targets.select(*by, F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    keys = ", ".join(f"{k} {sources.schema[k].dataType.simpleString()}" for k in by)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = {k: [r[k] for r in rows] for k in by} | {"value": [], "valid": [], "mapped": []}
            for r in rows:
                a = lambda c, r=r: np.array([np.nan if x is None else x for x in r[c]], dtype=float)
                at = nearest_source(a("lat"), a("lon"), a("tlat"), a("tlon"), km)
                value, valid = a("value"), np.array(r["valid"], dtype=bool)
                good = (at >= 0) & valid[at]
                out["value"].append([float(value[i]) if g else None for i, g in zip(at, good, strict=True)])
                out["valid"].append(good.tolist())
                out["mapped"].append(int((at >= 0).sum()))
            yield pa.RecordBatch.from_pydict(out)

    return sources.select(*by, "lat", "lon", "value", "valid").join(t, by).mapInArrow(run, f"{keys}, value array<double>, valid array<boolean>, mapped long")


#: Edge of a cell, in distances: a target's box touches 3.4 cells of that size on average.
CELL = 4


def regrid_pixels(sources: DataFrame, targets: DataFrame, by: str, km: float) -> DataFrame:
    """The same on pixel rows, for mosaics that are no tile: targets (by, target, lat, lon) meet the source pixels (by, source, lat, lon, value, valid) of the cells that a box around them touches, and the minimum is partial.

    Sizes of tables that explode() made are guessed too small, so both joins say that they shuffle: nothing passes through the driver.
    """
    cells, near = ("_x", "_y", "_z"), ("_tx", "_ty", "_tz")
    edge, reach = CELL * geo.chord(km), geo.chord(km) * (1 + 1e-9) + 1e-12
    cell = lambda x: F.floor((x + 1.0) / edge)
    s = sources.withColumns({n: cell(x) for n, x in zip(cells, geo.unit_vector(F.col("lat"), F.col("lon")), strict=True)}).select(F.col(by).alias("_by"), "source", F.col("lat").alias("slat"), F.col("lon").alias("slon"), "value", "valid", *cells)
    t = targets
    for n, x in zip(near, geo.unit_vector(F.col("lat"), F.col("lon")), strict=True):
        t = t.withColumn(n, F.explode(F.sequence(cell(x - reach), cell(x + reach))))
    met = t.join(s.hint("merge"), (F.col(by) == F.col("_by")) & (F.col("_tx") == F.col("_x")) & (F.col("_ty") == F.col("_y")) & (F.col("_tz") == F.col("_z")))
    d = geo.haversine_wrapped_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    best = met.where(d <= km).groupBy(by, "target").agg(F.min(F.struct(d.alias("d"), F.col("source"), F.col("value"), F.col("valid"))).alias("b"))
    return targets.join(best.hint("merge"), [by, "target"], "left").select(by, "target", F.when(F.col("b.valid"), F.col("b.value")).alias("value"), F.coalesce("b.valid", F.lit(False)).alias("valid"))


ALIGNED = "case_id long, step int, label int, area int, lat double, lon double, temperature double, cells array<int>, mapped long"


def aligned_regions(frames: DataFrame, tiles: DataFrame, km: float = 5.0) -> DataFrame:
    """Regions of every frame on the grid of its case's first frame: case_id, step, label, area, lat, lon, temperature, cells (raster indices there), mapped.

    frames: case_id, step, frame_id (null: missing); tiles: frame_id, height, width, and lat, lon, v7, ok, mask as arrays. Each place of the first frame's grid takes the nearest geolocated pixel of a frame within km; if that is
    valid, its mask and temperature. Regions are the components of what is then masked, so frames on different grids compare. A frame of which no place is mapped gives one row without a label. One frame is one kernel call.
    """
    from thermal_lake.operators import stencil

    ship(frames.sparkSession)
    have = frames.where("frame_id IS NOT NULL")
    first = have.groupBy("case_id").agg(F.min_by("frame_id", "step").alias("_first"))
    grid = tiles.select(F.col("frame_id").alias("_first"), F.col("height").alias("th"), F.col("width").alias("tw"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    schema = to_arrow_schema(StructType.fromDDL(ALIGNED))
    joined = have.join(tiles.select("frame_id", "lat", "lon", "v7", "ok", "mask"), "frame_id").join(first, "case_id").join(grid, "_first")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a = lambda c, r=r: np.array([np.nan if x is None else x for x in r[c]], dtype=float)
                tlat, tlon = a("tlat"), a("tlon")
                at = nearest_source(a("lat"), a("lon"), tlat, tlon, km)
                good = (at >= 0) & np.array(r["ok"], dtype=bool)[at]
                mask = good & np.array(r["mask"], dtype=bool)[at]
                value = np.where(good, a("v7")[at], np.nan)
                found = stencil.labels(mask.reshape(r["th"], r["tw"])).ravel()
                head = {"case_id": r["case_id"], "step": r["step"], "mapped": int((at >= 0).sum())}
                if not head["mapped"]:
                    out.append(head | {"label": None, "area": None, "lat": None, "lon": None, "temperature": None, "cells": None})
                for label in range(1, int(found.max(initial=0)) + 1):
                    cells = np.flatnonzero(found == label)
                    out.append(head | {"label": label, "area": len(cells), "lat": float(tlat[cells].mean()), "lon": float(tlon[cells].mean()), "temperature": float(value[cells].mean()), "cells": cells.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return joined.select("case_id", "step", "lat", "lon", "v7", "ok", "mask", "th", "tw", "tlat", "tlon").mapInArrow(run, ALIGNED)


def overlaps(cells: DataFrame) -> DataFrame:
    """Regions of consecutive steps that share pixels: case_id, step (the earlier), earlier, later, shared, iou. cells: case_id, step, label, cell."""
    sizes = cells.groupBy("case_id", "step", "label").agg(F.count("*").alias("n"))
    a = cells.selectExpr("case_id", "step", "cell", "label AS earlier")
    b = cells.selectExpr("case_id", "step - 1 AS step", "cell", "label AS later")
    shared = a.join(b, ["case_id", "step", "cell"]).groupBy("case_id", "step", "earlier", "later").agg(F.count("*").alias("shared"))
    na = sizes.selectExpr("case_id", "step", "label AS earlier", "n AS na")
    nb = sizes.selectExpr("case_id", "step - 1 AS step", "label AS later", "n AS nb")
    found = shared.join(na, ["case_id", "step", "earlier"]).join(nb, ["case_id", "step", "later"])
    return found.withColumn("iou", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).drop("na", "nb")


TRACKS = "case_id long, track_id int, steps array<int>, labels array<int>, count int, mean_iou double, area_trend double, temperature_trend double, disappeared_at int"


def follow(frames: list[dict | None], p: checks.Persistence) -> tuple[list[dict], list[dict]]:
    """Tracks and matches of one case. A frame is a dict of label to region (area, lat, lon, temperature, cells), or None if it is missing: then tracks end without a disappearance."""
    tracks: list[dict] = []
    matches: list[dict] = []
    before: dict[int, tuple[dict, dict]] | None = None
    for step, regions in enumerate(frames):
        if regions is None:
            before = None
            continue
        now: dict[int, tuple[dict, dict]] = {}
        if before is not None:
            options = []
            for i, (old, _) in before.items():
                for j, new in regions.items():
                    shared = len(old["cells"] & new["cells"])
                    union = len(old["cells"]) + len(new["cells"]) - shared
                    iou = shared / union if union else 0.0
                    km = float(haversine(old["lat"], old["lon"], new["lat"], new["lon"]))
                    if iou >= p.minimum_iou and km <= p.maximum_centroid_km:
                        options.append((-iou, km, i, j))
            used: set[int] = set()
            for iou, km, i, j in sorted(options):
                if i not in used and j not in now:
                    used.add(i)
                    track = before[i][1]
                    track["regions"].append((step, j, regions[j]))
                    track["ious"].append(-iou)
                    now[j] = (regions[j], track)
                    matches.append({"step": step - 1, "earlier": i, "later": j, "iou": -iou, "km": km})
            for i, (_, track) in before.items():
                if i not in used:
                    track["gone"] = step
        for j in sorted(regions):
            if j not in now:
                tracks.append({"regions": [(step, j, regions[j])], "ious": [], "gone": None})
                now[j] = (regions[j], tracks[-1])
        before = now
    return tracks, matches


def track_rows(tracks: list[dict]) -> list[dict]:
    out = []
    for i, t in enumerate(tracks, 1):
        (first, _, a), (last, _, b) = t["regions"][0], t["regions"][-1]
        many = len(t["regions"]) > 1
        out.append({
            "track_id": i, "steps": [s for s, _, _ in t["regions"]], "labels": [x for _, x, _ in t["regions"]], "count": len(t["regions"]), "mean_iou": float(np.mean(t["ious"])) if t["ious"] else 0.0,
            "area_trend": (b["area"] - a["area"]) / (last - first) if many else None, "temperature_trend": (b["temperature"] - a["temperature"]) / (last - first) if many else None, "disappeared_at": t["gone"],
        })
    return out


def tracks(frames: DataFrame, regions: DataFrame, p: checks.Persistence = checks.Persistence()) -> DataFrame:  # noqa: B008
    """Tracks of every case. frames: case_id, step, missing; regions: case_id, step, label, area, lat, lon, temperature, cells.

    A case is a sequence of frames that is folded in order in one kernel call, so cases are to be bounded (a case is one window of observations).
    """
    ship(frames.sparkSession)
    none = {"label": "int", "area": "int", "lat": "double", "lon": "double", "temperature": "double", "cells": "array<int>"}
    marks = frames.select("case_id", "step", F.col("missing").alias("missing"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    rows = marks.unionByName(regions.where(F.col("area") >= p.minimum_area).select("case_id", "step", F.lit(False).alias("missing"), *[F.col(c).cast(t).alias(c) for c, t in none.items()]))

    def fold(table: pa.Table) -> pa.Table:
        data = table.to_pylist()
        steps: list[dict | None] = [{} for _ in range(max(r["step"] for r in data) + 1)]
        for r in data:
            if r["missing"]:
                steps[r["step"]] = None
        for r in data:
            if r["label"] is not None and steps[r["step"]] is not None:
                steps[r["step"]][r["label"]] = r | {"cells": frozenset(r["cells"])}
        found, _ = follow(steps, p)
        schema = pa.schema([("case_id", pa.int64()), ("track_id", pa.int32()), ("steps", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("count", pa.int32()), ("mean_iou", pa.float64()), ("area_trend", pa.float64()), ("temperature_trend", pa.float64()), ("disappeared_at", pa.int32())])
        return pa.Table.from_pylist([{"case_id": data[0]["case_id"]} | t for t in track_rows(found)], schema=schema)

    return rows.groupBy("case_id").applyInArrow(fold, TRACKS)


def persistence(frames: DataFrame, found: DataFrame) -> DataFrame:
    """One row a case: the primary track (most regions, then overlap, then the first), confidence, and how many frames are missing."""
    primary = found.groupBy("case_id").agg(F.min(F.struct((-F.col("count")).alias("a"), (-F.col("mean_iou")).alias("b"), F.col("track_id"), F.col("count"), F.col("mean_iou"), F.col("area_trend"), F.col("temperature_trend"), F.col("disappeared_at"))).alias("t"), F.count("*").alias("tracks"))
    seen = frames.groupBy("case_id").agg(F.count_if("missing").alias("missing_count"), F.count_if(~F.col("missing")).alias("available"))
    out = seen.join(primary, "case_id", "left")
    count = F.coalesce("t.count", F.lit(0))
    share = F.when(count >= 2, (count - 1) / F.greatest(F.col("available") - 1, F.lit(1))).otherwise(0.0)
    return out.select(
        "case_id", "missing_count", count.alias("persistence_count"), F.coalesce("t.mean_iou", F.lit(0.0)).alias("mean_iou"), F.col("t.area_trend").alias("area_trend"), F.col("t.temperature_trend").alias("temperature_trend"),
        F.col("t.disappeared_at").isNotNull().alias("disappeared"), (F.coalesce("t.mean_iou", F.lit(0.0)) * share).alias("confidence"), F.coalesce("tracks", F.lit(0)).alias("track_count"),
    )
