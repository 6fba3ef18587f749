import numpy as np
import pytest
from pyspark.sql import functions as F

from thermal_lake.functions import checks, geo
from thermal_lake.operators import raster, stencil
from thermal_lake.sources import fixtures

#: coverage, saturated, span, deviation, neighbour difference
GOLDEN = {
    "persistent_heat/0": (1.0, 0, 35.58770751953125, 5.758030093593835, 1.3343513951157078),
    "persistent_heat/1": (1.0, 0, 35.736236572265625, 5.755574490099666, 1.3494577118844697),
    "transient_heat/0": (1.0, 0, 35.591278076171875, 5.757005471140724, 1.3177605831261836),
    "transient_heat/1": (1.0, 0, 1.119720458984375, 0.24587768902040247, 0.2802030389959162),
    "image_shift/0": (1.0, 0, 35.69830322265625, 5.758195145536157, 1.326088067257043),
    "image_shift/1": (1.0, 0, 35.766937255859375, 5.765341529494774, 1.3304356661709873),
    "missing_pixels/0": (0.4166666666666667, 0, 1.16070556640625, 0.24908848454424398, 0.27095579869538833),
    "saturated_pixels/0": (1.0, 0.027777777, 60.555419921875, 9.865239588048778, 2.0687806100556343),
    "low_contrast/0": (1.0, 0, 0.007904052734375, 0.0022825838663900443, 0.002631216338186553),
    "empty_frame/0": (1.0, 0, 0, 0, 0),
}


def test_fixture_digests():
    assert fixtures.bundle_digest(fixtures.cases()) == fixtures.BUNDLE_SHA256


def test_quality_of_fixtures(spark):
    q = raster.quality_reason(raster.frame_quality(fixtures.pixels(spark)))
    rows = {r["frame_id"]: r for r in q.collect()}
    for name, want in GOLDEN.items():
        r = rows[name]
        got = (r["usable_fraction"], r["saturated_fraction"], r["contrast_span"], r["texture_deviation"], r["neighbour_difference"])
        assert got == pytest.approx(want, abs=1e-6)
    reasons = {c.name: c.reason for c in fixtures.cases()}
    for name in ("missing_pixels", "saturated_pixels", "low_contrast", "empty_frame"):
        assert rows[f"{name}/0"]["reason"] == reasons[name]
        assert rows[f"{name}/0"]["confidence_cap"] == 0
    assert rows["persistent_heat/0"]["reason"] is None


def frame(spark, values, invalid=(), name=1):
    h, w = values.shape
    rows = [(name, r, c, float(values[r, c]), (r, c) in invalid) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "frame_id long, row int, col int, v7 float, invalid boolean")


def test_quality_counts_clips_and_blank_rows(spark):
    clipped = frame(spark, np.full((10, 10), 300.0)).withColumn("clip", F.col("row") < 2)
    r = raster.frame_quality(clipped, clipped="clip").first()
    assert r["saturated_fraction"] == pytest.approx(0.2)
    v = np.full((4, 4), 325.0)
    v[:3] = np.nan
    r = raster.quality_reason(raster.frame_quality(frame(spark, v))).first()
    assert r["missing_fraction"] == pytest.approx(0.75)
    assert r["reason"] == "coverage_insufficient"


def test_frame_order_and_partitions_do_not_matter(spark):
    p = fixtures.pixels(spark)
    a = raster.frame_quality(p).orderBy("frame_id").collect()
    b = raster.frame_quality(p.orderBy(F.rand(3)).repartition(7)).orderBy("frame_id").collect()
    assert [x["neighbour_difference"] for x in a] == pytest.approx([x["neighbour_difference"] for x in b], abs=1e-12)


def test_display(spark):
    v = np.array([[250, 260, 270, 280], [290, np.nan, 310, 320], [330, 340, 350, 360.0]])
    t = checks.Tile(physical_minimum=260.0, physical_maximum=340.0, lower_quantile=0.0, upper_quantile=1.0)
    p = raster.physical_clip(frame(spark, np.nan_to_num(v), {(1, 1)}), p=t)
    got = p.join(raster.display_range(p, p=t), "frame_id").withColumn("d", raster.display_scale(F.col("clipped"), F.col("lower"), F.col("upper"))).orderBy("row", "col").collect()
    assert [r["d"] for r in got] == [0, 0, 32, 64, 96, 0, 159, 191, 223, 255, 255, 255]
    assert [(r["row"], r["col"]) for r in got if r["low_clip"]] == [(0, 0)]
    assert [(r["row"], r["col"]) for r in got if r["high_clip"]] == [(2, 2), (2, 3)]


def test_resize_keeps_invalid_corners():
    value = np.array([[[300.0, 300], [300, np.nan]]])
    out, bad = stencil.resize(value, np.isfinite(value), (4, 4), 0.5)
    assert bad[0].tolist() == [[False] * 4] * 2 + [[False, False, True, True]] * 2
    assert np.allclose(out[0][~bad[0]], 300)


def test_structuring_elements_and_opening():
    assert stencil.ellipse(3).sum() == 5
    assert stencil.ellipse(5)[0].tolist() == [False, False, True, False, False]
    block = np.zeros((1, 9, 9), dtype=bool)
    block[0, 3:6, 3:6] = True
    opened = stencil.open_close(block, 3)
    assert opened.sum() == 5
    assert stencil.component_rows(stencil.labels(opened[0]), {})[0]["box_width"] == 3


def two_bands(spark, change):
    rng = np.random.default_rng(20260820)
    a, b = rng.normal(290, 0.2, (25, 25)), rng.normal(280, 0.2, (25, 25))
    bad = np.zeros((25, 25), dtype=bool)
    change(a, b, bad)
    rows = [(1, r, c, float(a[r, c]), float(b[r, c]), bool(bad[r, c])) for r in range(25) for c in range(25)]
    return raster.anomaly_tiles(spark.createDataFrame(rows, "frame_id long, row int, col int, v7 float, v14 float, invalid boolean"))


def hot(a, b, bad):
    a[10:15, 11:16] = 330


def test_hot_block_is_one_component(spark):
    r = raster.anomaly_components(two_bands(spark, hot)).where("kept").collect()
    assert len(r) == 1
    assert (r[0]["box_x"], r[0]["box_y"], r[0]["box_width"], r[0]["box_height"]) == (11, 10, 5, 5)
    assert (r[0]["centroid_x"], r[0]["centroid_y"], r[0]["edge_distance"]) == (13, 12, 9)


@pytest.mark.parametrize("change", [lambda a, b, bad: a.__setitem__((4, 4), 330), lambda a, b, bad: (hot(a, b, bad), b.__setitem__((slice(10, 15), slice(11, 16)), 330))])
def test_lonely_pixels_and_hot_companions_are_none(spark, change):
    assert raster.anomaly_components(two_bands(spark, change)).where("kept").count() == 0


def test_edge_filter(spark):
    t = two_bands(spark, lambda a, b, bad: a.__setitem__((slice(0, 5), slice(10, 15)), 330))
    found = raster.anomaly_components(t, checks.Anomaly(minimum_edge_distance=3)).collect()
    assert found
    assert not any(r["kept"] for r in found)


def test_contours_follow_the_border():
    m = np.zeros((6, 6), dtype=bool)
    m[1:4, 1:5] = True
    assert stencil.contours(m) == [[(1, 1), (4, 1), (4, 3), (1, 3)]]
    m[:] = False
    m[2, 2] = True
    assert stencil.contours(m) == [[(2, 2)]]


def test_decode_masks_raw_values(spark):
    raw = np.arange(63).reshape(7, 9)
    raw[0, 0], raw[6, 8] = -999, 61
    dqf = np.zeros((7, 9), dtype=int)
    dqf[2, 3], dqf[3, 3] = 2, 1
    df = spark.createDataFrame([(r, c, int(raw[r, c]), int(dqf[r, c])) for r in range(7) for c in range(9)], "row int, col int, raw int, dqf int")
    got = {(r["row"], r["col"]): r for r in raster.decode(df, 0.5, 200.0, -999, (0, 60)).collect()}
    assert got[2, 2]["value"] == 210.0
    assert got[2, 3]["invalid"]
    assert got[3, 3]["value"] == 215.0
    assert got[0, 0]["invalid"]
    assert got[6, 8]["invalid"]
    assert got[6, 8]["value"] is None


def test_projection_round_trip(spark):
    p = (35786023.0, -137.2, 6378137.0, 6356752.31414)
    df = spark.createDataFrame([(x, y) for x in np.linspace(-0.03, 0.03, 9).tolist() for y in np.linspace(0.03, -0.03, 7).tolist()], "x double, y double")
    lat, lon = geo.geostationary_inverse(F.col("x"), F.col("y"), *p)
    x, y = geo.geostationary_forward(F.col("lat"), F.col("lon"), *p)
    for r in df.withColumns({"lat": lat, "lon": lon}).withColumns({"x2": x, "y2": y}).collect():
        assert (r["x2"], r["y2"]) == pytest.approx((r["x"], r["y"]), abs=1e-9)
    off = spark.createDataFrame([(0.16, 0.0)], "x double, y double").select(geo.geostationary_inverse(F.col("x"), F.col("y"), *p)[0].alias("lat")).first()
    assert off["lat"] is None


def test_source_window(spark):
    row = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0, 0.0], [(1.5, 1.5), (2.2, 2.0), (None, 1.0)])], "x_axis array<double>, y_axis array<double>, points array<struct<x: double, y: double>>")
    r = raster.source_window(row, padding=1).first()
    assert (r["col_start"], r["col_stop"]) == (0, 4)
    assert (r["row_start"], r["row_stop"]) == (1, 5)
    assert row.select(raster.is_monotonic(F.col("x_axis")).alias("a"), raster.is_monotonic(F.array(F.lit(1.0), F.lit(1.0))).alias("b")).first() == (True, False)
    edges = row.select(raster.edge_points(F.lit(0.0), F.lit(10.0), F.lit(2.0), F.lit(14.0), 5).alias("e")).first()["e"]
    assert len(edges) == 20
    assert (edges[0]["lon"], edges[0]["lat"]) == (10.0, 0.0)
    assert (edges[-1]["lon"], edges[-1]["lat"]) == (14.0, 2.0)


def test_parameters_check_themselves():
    for wrong in (lambda: checks.Anomaly(background_kernel=4), lambda: checks.Quality(minimum_coverage=0.0), lambda: checks.Tile(lower_quantile=0.9, upper_quantile=0.1), lambda: checks.Persistence(minimum_iou=2.0), lambda: checks.Outcome(review_count=1), lambda: checks.Quality(minimum_span=float("nan"))):
        with pytest.raises(ValueError):
            wrong()


def test_equalized_display_keeps_range():
    v = np.arange(64, dtype=np.uint8).reshape(8, 8)
    out = stencil.equalized(v)
    assert out.dtype == np.uint8
    assert out.min() >= 0
    assert out[7, 7] >= out[0, 0]


def equalized_one_by_one(v, clip, grid):
    h, w = v.shape
    ty, tx = grid
    grow_y, grow_x = (0, 0) if h % ty == 0 and w % tx == 0 else (ty - h % ty, tx - w % tx)
    back = lambda i, n: i if i < n else back(2 * (n - 1) - i, n) if 2 * (n - 1) - i >= 0 else back(i - 2 * (n - 1), n)
    ch, cw = (h + grow_y) // ty, (w + grow_x) // tx
    luts = {}
    for i in range(ty):
        for j in range(tx):
            hist = [0] * 256
            for y in range(i * ch, (i + 1) * ch):
                for x in range(j * cw, (j + 1) * cw):
                    hist[v[back(y, h), back(x, w)]] += 1
            limit = max(1, int(clip * ch * cw / 256))
            over = sum(max(0, n - limit) for n in hist)
            hist = [min(n, limit) + over // 256 for n in hist]
            rest, k = over % 256, 0
            step = max(256 // rest, 1) if rest else 1
            while rest and k < 256:
                hist[k] += 1
                k, rest = k + step, rest - 1
            total, lut = 0, []
            for n in hist:
                total += n
                lut.append(min(255, round(float(np.float32(total) * np.float32(255 / (ch * cw))))))
            luts[i, j] = lut
    f = np.float32
    out = np.zeros_like(v)
    for y in range(h):
        fy = f(y) * f(1 / ch) - f(0.5)
        y0 = int(np.floor(fy))
        a = f(fy - f(y0))
        for x in range(w):
            fx = f(x) * f(1 / cw) - f(0.5)
            x0 = int(np.floor(fx))
            b = f(fx - f(x0))
            at = lambda i, j, y=y, x=x: f(luts[min(max(i, 0), ty - 1), min(max(j, 0), tx - 1)][v[y, x]])
            top, low = at(y0, x0) * (f(1) - b) + at(y0, x0 + 1) * b, at(y0 + 1, x0) * (f(1) - b) + at(y0 + 1, x0 + 1) * b
            out[y, x] = min(255, max(0, round(float(top * (f(1) - a) + low * a))))
    return out


@pytest.mark.parametrize(("shape", "clip", "grid"), [((16, 16), 2.0, (8, 8)), ((21, 17), 3.0, (2, 2)), ((9, 12), 1.0, (3, 4)), ((10, 12), 40.0, (3, 4)), ((40, 33), 2.5, (8, 8))])
def test_equalization_by_one_pixel_at_a_time(shape, clip, grid):
    v = (np.random.default_rng(5).normal(120, 40, shape).clip(0, 255)).astype(np.uint8)
    assert (stencil.equalized(v, clip, grid) == equalized_one_by_one(v, clip, grid)).all()


def test_equalization_fills_with_the_rounded_median_and_takes_parameters(spark):
    rows = [(1, r, c, [10, 11, 12, 13][(r * 4 + c) % 4], (r, c) != (0, 0)) for r in range(4) for c in range(4)]
    t = raster.tiles(spark.createDataFrame(rows, "frame_id long, row int, col int, display int, ok boolean"), ["display", "ok"], ["frame_id"])
    v = np.array([x[3] for x in rows], dtype=np.uint8).reshape(4, 4)
    v[0, 0] = round(float(np.median(v.ravel()[1:])))
    for clip, grid in ((2.0, (2, 2)), (4.0, (1, 1))):
        got = {(r["row"], r["col"]): r["display"] for r in raster.equalized_display(t, clip, grid).collect()}
        want = stencil.equalized(v, clip, grid)
        assert got == {(r, c): 0 if (r, c) == (0, 0) else int(want[r, c]) for r in range(4) for c in range(4)}
    for wrong in ((0.0, (2, 2)), (1.0, (0, 2))):
        with pytest.raises(ValueError):
            stencil.equalized(v, *wrong)


def test_stack_labels_are_the_flood_fill():
    rng = np.random.default_rng(11)
    spiral = np.zeros((15, 15), dtype=bool)
    for k in range(0, 7, 2):
        spiral[k, k : 15 - k] = spiral[k : 15 - k, 14 - k] = spiral[14 - k, k : 15 - k] = True
        spiral[k + 2 : 15 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    masks = np.stack([spiral, np.zeros_like(spiral), np.ones_like(spiral), *(rng.random((40, 15, 15)) < rng.random((40, 1, 1)))])
    for mask, found in zip(masks, stencil.stack_labels(masks), strict=True):
        want, n = np.zeros(mask.shape, dtype=int), 0
        for r, c in np.argwhere(mask):
            if not want[r, c]:
                n += 1
                todo = [(r, c)]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < 15 and 0 <= x < 15 and mask[y, x] and not want[y, x]:
                        want[y, x] = n
                        todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (found == want).all()
