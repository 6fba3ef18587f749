"""Raster operators. Pixel rows (frame_id, row, col, ...) stay in column expressions; tiles (arrays of one frame) go through Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thermal_lake.functions import checks
from thermal_lake.functions.geo import geostationary_inverse
from thermal_lake.operators import stencil
from thermal_lake.shipping import ship

FRAME = "frame_id"


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


# Decoding and masks


def decode(df: DataFrame, scale: float, offset: float, fill: int | None = None, valid_range: tuple[int, int] | None = None, maximum_quality: int = 1) -> DataFrame:
    """Pixel rows with raw and dqf (and perhaps lat, lon) to value (float, null if invalid) and invalid. The range is of raw values."""
    bad = F.col("raw").isNull()
    if fill is not None:
        bad = bad | (F.col("raw") == fill)
    if valid_range:
        bad = bad | (F.col("raw") < valid_range[0]) | (F.col("raw") > valid_range[1])
    bad = bad | F.col("dqf").isNull() | (F.col("dqf") > maximum_quality)
    for c in ("lat", "lon"):
        if c in df.columns:
            bad = bad | ~finite(F.col(c))
    value = (F.col("raw").cast("double") * scale + offset).cast("float")
    return df.withColumn("invalid", bad | ~finite(value)).withColumn("value", F.when(~F.col("invalid"), value))


def conflicting_ranges(df: DataFrame, minimum: str = "valid_min", maximum: str = "valid_max", both: str = "valid_range") -> DataFrame:
    """Calibration rows whose valid_range disagrees with their valid_min or valid_max."""
    return df.where((F.col(both).isNotNull()) & ((F.size(both) != 2) | (F.get(both, F.lit(0)) != F.col(minimum)) | (F.get(both, F.lit(1)) != F.col(maximum))))


def decode_axis(raw: Column, scale: float, offset: float) -> Column:
    """Scan coordinates of an axis's packed array."""
    return F.transform(raw, lambda x: x.cast("double") * scale + offset)


def is_monotonic(axis: Column) -> Column:
    """Whether an axis has two values at least and strictly ascends or strictly descends."""
    steps = F.zip_with(F.slice(axis, 2, F.size(axis) - 1), F.slice(axis, 1, F.size(axis) - 1), lambda a, b: a - b)
    return (F.size(axis) >= 2) & (F.forall(steps, lambda x: x > 0) | F.forall(steps, lambda x: x < 0))


def scan_timing(df: DataFrame, start: str = "coverage_start", end: str = "coverage_end", single: str = "time") -> DataFrame:
    """scan_start and scan_end: both coverage times, or the single time if there is neither; timing_error names what is wrong."""
    s, e = F.col(start), F.col(end)
    error = F.when(s.isNull() != e.isNull(), "one coverage time is missing").when(s.isNull() & F.col(single).isNull(), "no time").when(e < s, "scan ends before it starts")
    return df.withColumns({"scan_start": F.coalesce(s, single), "scan_end": F.coalesce(e, single), "timing_error": error})


def geolocate(df: DataFrame, height: float, lon0: float, semi_major: float, semi_minor: float) -> DataFrame:
    """Pixel rows with scan angles x and y to lat and lon; null off the Earth."""
    lat, lon = geostationary_inverse(F.col("x"), F.col("y"), height, lon0, semi_major, semi_minor)
    return df.withColumns({"lat": lat, "lon": lon})


def edge_points(south: Column, west: Column, north: Column, east: Column, samples: int = 33) -> Column:
    """Points (lon, lat) along the four edges of a box, `samples` on each: south, north, west, east."""
    step = lambda a, b, i: a + (b - a) * i / (samples - 1)
    along = F.sequence(F.lit(0), F.lit(samples - 1))
    side = lambda lon, lat: F.transform(along, lambda i: F.struct(lon(i).cast("double").alias("lon"), lat(i).cast("double").alias("lat")))
    return F.concat(
        side(lambda i: step(west, east, i), lambda i: south + 0 * i), side(lambda i: step(west, east, i), lambda i: north + 0 * i),
        side(lambda i: west + 0 * i, lambda i: step(south, north, i)), side(lambda i: east + 0 * i, lambda i: step(south, north, i)),
    )


def nearest_index(axis: Column, wanted: Column) -> Column:
    """The index of the axis's value nearest to wanted; of two as near, the lesser value's."""
    near = F.array_min(F.transform(axis, lambda x, i: F.struct(F.abs(x - wanted).alias("d"), x.alias("x"), i.alias("i"))))
    return near.getField("i")


def source_window(df: DataFrame, points: str = "points", x: str = "x_axis", y: str = "y_axis", padding: int = 1) -> DataFrame:
    """Half-open index ranges of the pixels that scan-angle points (x, y) touch, padded and cut at the edges; points off the Earth are null and left out."""
    known = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    ix = F.transform(known, lambda p: nearest_index(F.col(x), p["x"]))
    iy = F.transform(known, lambda p: nearest_index(F.col(y), p["y"]))
    return df.withColumns({
        "row_start": F.greatest(F.lit(0), F.array_min(iy) - padding), "row_stop": F.least(F.size(y), F.array_max(iy) + padding + 1),
        "col_start": F.greatest(F.lit(0), F.array_min(ix) - padding), "col_stop": F.least(F.size(x), F.array_max(ix) + padding + 1),
    })


def crop(pixels: DataFrame, row_start: int, row_stop: int, col_start: int, col_stop: int) -> DataFrame:
    """Pixel rows of a window; plain comparisons, so they reach the Parquet scan."""
    return pixels.where((F.col("row") >= row_start) & (F.col("row") < row_stop) & (F.col("col") >= col_start) & (F.col("col") < col_stop))


def actual_bounds(pixels: DataFrame, by: str = FRAME) -> DataFrame:
    ok = finite(F.col("lat")) & finite(F.col("lon"))
    return pixels.where(ok).groupBy(by).agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


def nearest_pixel(pixels: DataFrame, lat: Column, lon: Column, by: str = FRAME) -> DataFrame:
    """Each frame's pixel nearest in squared degrees; of several the first in raster order."""
    d = F.pow(F.col("lat") - lat, 2) + F.pow(F.col("lon") - lon, 2)
    best = F.min(F.struct(d.alias("d"), F.col("row"), F.col("col"), F.col("lat"), F.col("lon")))
    return pixels.where(finite(d)).groupBy(by).agg(best.alias("p")).select(by, "p.row", "p.col", "p.lat", "p.lon")


# Preparation


def physical_clip(pixels: DataFrame, value: str = "v7", p: checks.Tile = checks.Tile()) -> DataFrame:  # noqa: B008
    v, ok = F.col(value), ~F.col("invalid")
    return pixels.withColumns({
        "clipped": F.when(ok, F.least(F.greatest(v, F.lit(p.physical_minimum).cast("float")), F.lit(p.physical_maximum).cast("float"))),
        "low_clip": ok & F.coalesce(v < p.physical_minimum, F.lit(False)), "high_clip": ok & F.coalesce(v > p.physical_maximum, F.lit(False)),
    })


def display_range(clipped: DataFrame, by: str = FRAME, p: checks.Tile = checks.Tile()) -> DataFrame:  # noqa: B008
    """lower and upper of each frame: exact linear quantiles of valid values inside the physical range; that range if they degenerate."""
    q = clipped.groupBy(by).agg(F.percentile("clipped", F.array(F.lit(p.lower_quantile), F.lit(p.upper_quantile))).alias("q"))
    low, high = F.greatest(F.get("q", F.lit(0)), F.lit(p.physical_minimum)), F.least(F.get("q", F.lit(1)), F.lit(p.physical_maximum))
    good = F.coalesce(high > low, F.lit(False))
    return q.select(by, F.when(good, low).otherwise(p.physical_minimum).alias("lower"), F.when(good, high).otherwise(p.physical_maximum).alias("upper"))


def display_scale(value: Column, lower: Column, upper: Column) -> Column:
    """0 to 255, half to even; 0 for a null value."""
    share = F.least(F.greatest((value - lower) / (upper - lower), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.rint(share * 255.0).cast("int"), F.lit(0))


def fixed_display(value: Column, low: float, high: float) -> Column:
    """The single-band display: a fixed range to 0..255, rounded half to even and held to the range."""
    return F.coalesce(F.least(F.greatest(F.rint((value - low) * (255.0 / (high - low))), F.lit(0.0)), F.lit(255.0)).cast("int"), F.lit(0))


def overlay_range(pixels: DataFrame, value: str, by: str = FRAME) -> DataFrame:
    """The overlay's range: 2nd and 98th percentile; least and greatest if these degenerate; null (a constant 127) if those do."""
    q = pixels.groupBy(by).agg(F.percentile(value, F.array(F.lit(0.02), F.lit(0.98))).alias("q"), F.min(value).alias("a"), F.max(value).alias("b"))
    robust = F.get("q", F.lit(1)) > F.get("q", F.lit(0))
    whole = F.col("b") > F.col("a")
    return q.select(by, F.when(robust, F.get("q", F.lit(0))).when(whole, F.col("a").cast("double")).alias("lower"), F.when(robust, F.get("q", F.lit(1))).when(whole, F.col("b").cast("double")).alias("upper"))


# Quality


def frame_quality(pixels: DataFrame, value: str = "v7", invalid: str = "invalid", clipped: str | None = None, by: str = FRAME, t: checks.Quality = checks.Quality()) -> DataFrame:  # noqa: B008
    """Counts, fractions, span, deviation and neighbour differences of every frame: one shuffle by frame, in which two orders of the pixels share the partitioning."""
    rows = pixels.select(by, "row", "col", F.when(~F.col(invalid) & finite(F.col(value)), F.col(value)).alias("v"), (F.col(clipped) if clipped else F.lit(False)).alias("clip"))
    across, down = Window.partitionBy(by).orderBy("row", "col"), Window.partitionBy(by).orderBy("col", "row")
    step = lambda w, same, next_: F.when((F.lag(same).over(w) == F.col(same)) & (F.lag(next_).over(w) == F.col(next_) - 1), F.abs(F.col("v") - F.lag("v").over(w)).cast("double"))
    rows = rows.withColumns({"h": step(across, "row", "col"), "d": step(down, "col", "row")})
    v = F.col("v")
    hot = F.col("clip")
    if t.saturation_minimum is not None:
        hot = hot | (v <= t.saturation_minimum)
    if t.saturation_maximum is not None:
        hot = hot | (v >= t.saturation_maximum)
    q = rows.groupBy(by).agg(
        F.count("*").alias("pixel_count"), F.count("v").alias("usable_count"), F.count_if(v.isNotNull() & hot).alias("saturated_count"),
        F.coalesce((F.max("v") - F.min("v")).cast("double"), F.lit(0.0)).alias("contrast_span"), F.coalesce(F.stddev_pop(v.cast("double")), F.lit(0.0)).alias("texture_deviation"),
        F.coalesce((F.coalesce(F.sum("h"), F.lit(0.0)) + F.coalesce(F.sum("d"), F.lit(0.0))) / F.nullif(F.count("h") + F.count("d"), F.lit(0)), F.lit(0.0)).alias("neighbour_difference"),
        F.coalesce(F.max("v") <= t.blank_maximum, F.lit(False)).alias("blank"),
    )
    usable = F.col("usable_count") / F.col("pixel_count")
    return q.withColumns({"usable_fraction": usable, "missing_fraction": 1 - usable, "saturated_fraction": F.coalesce(F.col("saturated_count") / F.nullif(F.col("usable_count"), F.lit(0)), F.lit(0.0))})


def quality_reason(q: DataFrame, t: checks.Quality = checks.Quality()) -> DataFrame:  # noqa: B008
    """Scores, the one primary reason (null if usable) and the cap on confidence."""
    low = (F.col("contrast_span") < t.minimum_span) | (F.col("texture_deviation") < t.minimum_deviation)
    scores = {
        "coverage_score": F.least(F.col("usable_fraction") / t.minimum_coverage, F.lit(1.0)),
        "saturation_score": F.greatest(F.lit(0.0), 1 - F.col("saturated_fraction") / t.maximum_saturated),
        "contrast_score": F.least(F.col("contrast_span") / t.minimum_span, F.lit(1.0)),
        "texture_score": F.least(F.col("texture_deviation") / t.minimum_deviation, F.lit(1.0)),
    }
    reason = F.when(F.col("usable_fraction") < t.minimum_coverage, "coverage_insufficient").when(F.col("blank"), "frame_blank").when(F.col("saturated_fraction") > t.maximum_saturated, "frame_saturated").when(low, "contrast_low")
    q = q.withColumns(scores).withColumn("quality_score", F.least(*scores)).withColumn("reason", reason)
    return q.withColumn("confidence_cap", F.when(F.col("reason").isNull(), 1.0).otherwise(0.0))


def gate(pixels: DataFrame, reasons: DataFrame, mask: str, by: str = FRAME) -> DataFrame:
    """Clears the mask of frames that have a reason."""
    bad = reasons.where(F.col("reason").isNotNull()).select(by, F.lit(True).alias("_bad"))
    return pixels.join(bad, by, "left").withColumn(mask, F.col(mask) & F.col("_bad").isNull()).drop("_bad")


# Anomalies


def threshold(value: Column, limit: float) -> Column:
    """Strictly above; false for null."""
    return F.coalesce(value > limit, F.lit(False))


def difference(a: Column, b: Column, valid: Column) -> Column:
    return F.when(valid, a - b)


def tiles(pixels: DataFrame, planes: list[str], by: list[str]) -> DataFrame:
    """One row for each frame: height, width and the planes as arrays in raster order. A tile is bounded; frames beyond that come in as crops."""
    cell = F.struct("row", "col", *planes)
    t = pixels.groupBy(*by).agg(F.array_sort(F.collect_list(cell)).alias("t"), (F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))
    plane = lambda name: F.transform("t", lambda x: x[name])
    return t.select(*by, "height", "width", *[plane(p).alias(p) for p in planes])


def _plane(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column as one array (booleans, or doubles with NaN for null), and where each list starts."""
    values, at = lists.flatten(), lists.offsets.to_numpy()
    kind = bool if pa.types.is_boolean(values.type) else float
    return values.to_numpy(zero_copy_only=False).astype(kind), at[: len(lists) + 1] - at[0]


def over_stacks(df: DataFrame, schema: str, kernel: Callable[[dict, dict], list[dict] | dict], keys: list[str], planes: list[str]) -> DataFrame:
    """Rows that kernel(keys, planes) makes of all tiles of one shape in an Arrow batch: keys are lists, planes stacks of tiles; it returns rows, or columns as arrays (null: NaN)."""
    out = to_arrow_schema(StructType.fromDDL(schema))
    ship(df.sparkSession)

    def column(values, kind: pa.DataType) -> pa.Array:
        return pa.array(values, kind, mask=np.isnan(values)) if isinstance(values, np.ndarray) and values.dtype.kind == "f" else pa.array(values, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            part = lambda n, names=names, batch=batch: batch.column(names.index(n))
            heads = {n: part(n).to_pylist() for n in keys}
            shapes = list(zip(part("height").to_pylist(), part("width").to_pylist(), strict=True))
            flat = {p: _plane(part(p)) for p in planes}
            for shape in dict.fromkeys(shapes):
                at = [i for i, x in enumerate(shapes) if x == shape]
                stacks = {p: np.stack([v[o[i] : o[i + 1]].reshape(shape) for i in at]) for p, (v, o) in flat.items()}
                found = kernel({k: [v[i] for i in at] for k, v in heads.items()}, stacks)
                yield pa.RecordBatch.from_pylist(found, schema=out) if isinstance(found, list) else pa.record_batch([column(found[f.name], f.type) for f in out], schema=out)

    return df.select(*keys, "height", "width", *planes).mapInArrow(run, schema)


def pixel_columns(keys: dict, shape: tuple[int, int, int]) -> dict:
    """The keys, row and col of every pixel of a stack."""
    n, h, w = shape
    return {k: np.repeat(v, h * w) for k, v in keys.items()} | {"row": np.tile(np.repeat(np.arange(h), w), n), "col": np.tile(np.arange(w), n * h)}


def one_by_one(keys: dict, *stacks) -> Iterator[tuple]:
    """The keys and the tiles of each place in the stacks."""
    for i, values in enumerate(zip(*keys.values(), strict=True)):
        yield dict(zip(keys, values, strict=True)), *(x[i] for x in stacks)


def anomaly_masks(valid: np.ndarray, v7: np.ndarray, v14: np.ndarray, p: checks.Anomaly) -> dict[str, np.ndarray]:
    """Contrast, difference and the masks of a stack of frames before the quality gate."""
    contrast = stencil.local_contrast(v7, valid, p.background_kernel)
    diff = np.where(valid, (v7.astype(np.float32) - v14.astype(np.float32)).astype(float), np.nan)
    above = lambda x, limit: np.nan_to_num(x, nan=-np.inf) > limit
    local, band = above(contrast, p.minimum_contrast), above(diff, p.minimum_difference)
    raw = local & band & valid
    return {"contrast": contrast, "difference": diff, "local": local, "band": band, "raw": raw, "morphology": stencil.open_close(raw, p.morphology_kernel) & valid}


ANOMALY_PLANES = ["v7", "v14", "ok"]
MASK_SCHEMA = "frame_id long, row int, col int, contrast double, difference double, local boolean, band boolean, raw boolean, morphology boolean"
COMPONENT_SCHEMA = (
    "frame_id long, label int, area int, box_x int, box_y int, box_width int, box_height int, centroid_x double, centroid_y double, edge_distance int, edge_proximity double, "
    "mean_contrast double, max_contrast double, mean_difference double, max_difference double, touches_edge boolean, kept boolean, cells array<int>"
)


def anomaly_tiles(pixels: DataFrame) -> DataFrame:
    return tiles(pixels.withColumn("ok", ~F.col("invalid") & finite(F.col("v7")) & finite(F.col("v14"))), ANOMALY_PLANES, [FRAME])


def anomaly_pixels(frames: DataFrame, p: checks.Anomaly = checks.Anomaly()) -> DataFrame:  # noqa: B008
    """Pixel rows of every plane and mask, ungated."""

    def kernel(keys: dict, planes: dict) -> dict:
        m = anomaly_masks(planes["ok"], planes["v7"], planes["v14"], p)
        return pixel_columns(keys, m["raw"].shape) | {k: v.ravel() for k, v in m.items()}

    return over_stacks(frames, MASK_SCHEMA, kernel, [FRAME], ANOMALY_PLANES)


def anomaly_components(frames: DataFrame, p: checks.Anomaly = checks.Anomaly()) -> DataFrame:  # noqa: B008
    """Components of every frame's mask, with the number each has before the filter (kept says whether it passes area and edge distance); ungated. cells are raster indices."""

    def kernel(keys: dict, planes: dict) -> list[dict]:
        m = anomaly_masks(planes["ok"], planes["v7"], planes["v14"], p)
        out = []
        for head, found, contrast, difference in one_by_one(keys, stencil.stack_labels(m["morphology"]), m["contrast"], m["difference"]):
            rows = stencil.component_rows(found, {"contrast": contrast, "difference": difference})
            out += [head | r | {"touches_edge": r["edge_distance"] == 0, "kept": r["area"] >= p.minimum_area and r["edge_distance"] >= p.minimum_edge_distance, "cells": np.flatnonzero(found == r["label"]).tolist()} for r in rows]
        return out

    return over_stacks(frames, COMPONENT_SCHEMA, kernel, [FRAME], ANOMALY_PLANES)


def resized(frames: DataFrame, plane: str, shape: tuple[int, int], least: float = 0.5) -> DataFrame:
    """Pixel rows of the plane at another size; a value is null where too little valid area supports it."""

    def kernel(keys: dict, planes: dict) -> dict:
        value, bad = stencil.resize(planes[plane], planes["ok"], shape, least)
        return pixel_columns(keys, value.shape) | {"value": np.where(bad, np.nan, value).ravel()}

    return over_stacks(frames, "frame_id long, row int, col int, value double", kernel, [FRAME], [plane, "ok"])


def contour_rows(frames: DataFrame, p: checks.Anomaly = checks.Anomaly()) -> DataFrame:  # noqa: B008
    """Outer contours of the kept components: frame, place in the order, points (x, y)."""

    def kernel(keys: dict, planes: dict) -> list[dict]:
        m = anomaly_masks(planes["ok"], planes["v7"], planes["v14"], p)
        out = []
        for head, found in one_by_one(keys, stencil.stack_labels(m["morphology"])):
            kept = [r["label"] for r in stencil.component_rows(found, {}) if r["area"] >= p.minimum_area and r["edge_distance"] >= p.minimum_edge_distance]
            out += [head | {"place": i, "points": [{"x": x, "y": y} for x, y in c]} for i, c in enumerate(stencil.contours(np.isin(found, kept)))]
        return out

    return over_stacks(frames, "frame_id long, place int, points array<struct<x: int, y: int>>", kernel, [FRAME], ANOMALY_PLANES)


def equalized_display(displays: DataFrame, clip: float = 2.0, grid: tuple[int, int] = (8, 8)) -> DataFrame:
    """Tiles of display (0..255) and ok to equalized pixel rows; invalid pixels take the median of the valid ones (rounded, halves to even) and return as 0."""

    def kernel(keys: dict, planes: dict) -> dict:
        out = []
        for v, ok in zip(planes["display"], planes["ok"], strict=True):
            filled = np.where(ok, v, np.rint(np.median(v[ok])) if ok.any() else 0).astype(np.uint8)
            out.append(np.where(ok, stencil.equalized(filled, clip, grid), 0))
        return pixel_columns(keys, planes["ok"].shape) | {"display": np.stack(out).astype(np.int32).ravel()}

    return over_stacks(displays, "frame_id long, row int, col int, display int", kernel, [FRAME], ["display", "ok"])


def slice_components(frames: DataFrame, limit: float, kernel_pixels: int = 3, least: int = 1) -> DataFrame:
    """The single-band slice: threshold, morphology, components of v7."""

    def kernel(keys: dict, planes: dict) -> list[dict]:
        masks = planes["ok"] & (np.nan_to_num(planes["v7"], nan=-np.inf) > limit)
        out = []
        for head, found, v7 in one_by_one(keys, stencil.stack_labels(stencil.open_close(masks, kernel_pixels)), planes["v7"]):
            out += [head | {k: r[k] for k in ("label", "area", "box_x", "box_y", "box_width", "box_height", "centroid_x", "centroid_y", "mean_v7", "max_v7")} for r in stencil.component_rows(found, {"v7": v7}) if r["area"] >= least]
        return out

    return over_stacks(frames, "frame_id long, label int, area int, box_x int, box_y int, box_width int, box_height int, centroid_x double, centroid_y double, mean_v7 double, max_v7 double", kernel, [FRAME], ["v7", "ok"])
