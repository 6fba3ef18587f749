"""Raster queries: quality, display, masks, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermal_lake import bindings as b
from thermal_lake.operators import raster as r

QUERIES, ORACLES = {}, {}
#: Frames of 8 x 8 pixels hold smaller regions than the default area.
SMALL = r.checks.Anomaly(minimum_area=4)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: q(frame_id and what frame_quality measures) for a value and an invalid mask
QUALITY = """
    qv AS (SELECT frame_id, row, col, CASE WHEN NOT invalid AND isfinite({v}) THEN {v} END AS v FROM px),
    qn AS (
        SELECT *, abs(v - lag(v) OVER (PARTITION BY frame_id, row ORDER BY col))::DOUBLE AS h, abs(v - lag(v) OVER (PARTITION BY frame_id, col ORDER BY row))::DOUBLE AS d FROM qv
    ),
    q AS (
        SELECT frame_id, count(*) AS pixel_count, count(v) AS usable_count, count(*) FILTER (v >= 350) AS saturated_count,
            coalesce((max(v) - min(v))::DOUBLE, 0.0) AS contrast_span, coalesce(stddev_pop(v::DOUBLE), 0.0) AS texture_deviation,
            coalesce((coalesce(sum(h), 0) + coalesce(sum(d), 0)) / nullif(count(h) + count(d), 0), 0.0) AS neighbour_difference, coalesce(max(v) <= 1.0, false) AS blank
        FROM qn GROUP BY frame_id
    ),
    qf AS (
        SELECT *, usable_count::DOUBLE / pixel_count AS usable_fraction, 1 - usable_count::DOUBLE / pixel_count AS missing_fraction,
            coalesce(saturated_count::DOUBLE / nullif(usable_count, 0), 0.0) AS saturated_fraction FROM q
    ),
    qr AS (
        SELECT *, least(usable_fraction / 0.75, 1.0) AS coverage_score, greatest(0.0, 1 - saturated_fraction / 0.02) AS saturation_score,
            least(contrast_span / 0.05, 1.0) AS contrast_score, least(texture_deviation / 0.01, 1.0) AS texture_score,
            CASE WHEN usable_fraction < 0.75 THEN 'coverage_insufficient' WHEN blank THEN 'frame_blank' WHEN saturated_fraction > 0.02 THEN 'frame_saturated'
                WHEN contrast_span < 0.05 OR texture_deviation < 0.01 THEN 'contrast_low' END AS reason
        FROM qf
    )
"""
MEASURES = ["usable_fraction", "missing_fraction", "saturated_fraction", "contrast_span", "texture_deviation", "neighbour_difference"]
SCORES = ["coverage_score", "saturation_score", "contrast_score", "texture_score"]


def rounded(names: list[str], digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def sql_rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@query("frame_quality", f"WITH {b.PIXELS}, {QUALITY.format(v='v7')} SELECT frame_id, pixel_count, usable_count, saturated_count, {sql_rounded(MEASURES, 4)}, blank FROM qf")
def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.frame_quality(b.pixels(spark, sf_dir)).select("frame_id", "pixel_count", "usable_count", "saturated_count", *rounded(MEASURES, 4), "blank")


@query("frame_quality_reason", f"WITH {b.PIXELS}, {QUALITY.format(v='v7')} SELECT frame_id, {sql_rounded(SCORES, 4)}, round(least(coverage_score, saturation_score, contrast_score, texture_score), 4) AS quality_score, reason, CASE WHEN reason IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence_cap FROM qr")
def frame_quality_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.quality_reason(r.frame_quality(b.pixels(spark, sf_dir))).select("frame_id", *rounded([*SCORES, "quality_score"], 4), "reason", "confidence_cap")


@query("decode_and_mask", """
    WITH raw AS (SELECT vec_id AS frame_id, unnest(range(0, len(embedding))) AS pos, embedding FROM embeddings),
    d AS (SELECT frame_id, CAST(pos // 8 AS INTEGER) AS row, CAST(pos % 8 AS INTEGER) AS col, CAST(floor(embedding[pos + 1] * 100) AS INTEGER) AS raw, CAST((frame_id + pos) % 4 AS INTEGER) AS dqf FROM raw)
    SELECT frame_id, row, col, raw IS NULL OR raw = -3 OR raw < -40 OR raw > 40 OR dqf > 1 AS invalid, CASE WHEN NOT (raw = -3 OR raw < -40 OR raw > 40 OR dqf > 1) THEN CAST(raw * 0.5::DOUBLE + 200.0::DOUBLE AS FLOAT) END AS value FROM d
""")  # fmt: skip
def decode_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.pixels(spark, sf_dir).selectExpr("frame_id", "row", "col", "cast(floor(cast(raw AS float) * 100.0F) AS int) AS raw", "cast((frame_id + row * 8 + col) % 4 AS int) AS dqf")
    return r.decode(p, 0.5, 200.0, -3, (-40, 40)).select("frame_id", "row", "col", "invalid", "value")


@query("physical_clip_counts", f"""
    WITH {b.PIXELS} SELECT frame_id, count(*) FILTER (NOT invalid AND v7 < 285) AS low_count, count(*) FILTER (NOT invalid AND v7 > 300) AS high_count,
        min(CASE WHEN NOT invalid THEN least(greatest(v7, 285::FLOAT), 300::FLOAT) END) AS minimum, max(CASE WHEN NOT invalid THEN least(greatest(v7, 285::FLOAT), 300::FLOAT) END) AS maximum, count(*) FILTER (invalid) AS invalid_count
    FROM px GROUP BY frame_id
""")  # fmt: skip
def physical_clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = r.physical_clip(b.pixels(spark, sf_dir), p=r.checks.Tile(physical_minimum=285.0, physical_maximum=300.0))
    return p.groupBy("frame_id").agg(F.count_if("low_clip").alias("low_count"), F.count_if("high_clip").alias("high_count"), F.min("clipped").alias("minimum"), F.max("clipped").alias("maximum"), F.count_if("invalid").alias("invalid_count"))


RANGE = """
    rg AS (SELECT frame_id, greatest(quantile_cont(v7::DOUBLE, 0.02) FILTER (NOT invalid), 180.0) AS lo, least(quantile_cont(v7::DOUBLE, 0.98) FILTER (NOT invalid), 400.0) AS hi FROM px GROUP BY frame_id),
    dr AS (SELECT frame_id, CASE WHEN coalesce(hi > lo, false) THEN lo ELSE 180.0 END::DOUBLE AS lower, CASE WHEN coalesce(hi > lo, false) THEN hi ELSE 400.0 END::DOUBLE AS upper FROM rg)
"""


def _clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.physical_clip(b.pixels(spark, sf_dir)).withColumn("clipped", F.col("clipped").cast("double"))


@query("display_quantile_range", f"""
    WITH {b.PIXELS}, cl AS (SELECT * REPLACE (least(greatest(v7, 180::FLOAT), 400::FLOAT) AS v7) FROM px), {RANGE.replace('FROM px', 'FROM cl')} SELECT frame_id, round(lower, 4) AS lower, round(upper, 4) AS upper FROM dr
""")  # fmt: skip
def display_quantile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.display_range(_clipped(spark, sf_dir)).select("frame_id", *rounded(["lower", "upper"], 4))


@query("display_uint8_histogram", f"""
    WITH {b.PIXELS}, cl AS (SELECT * REPLACE (least(greatest(v7, 180::FLOAT), 400::FLOAT) AS v7) FROM px), {RANGE.replace('FROM px', 'FROM cl')},
    ds AS (SELECT coalesce(CASE WHEN NOT invalid THEN CAST(round_even(least(greatest((v7::DOUBLE - lower) / (upper - lower), 0.0), 1.0) * 255.0, 0) AS INTEGER) END, 0) AS display FROM cl JOIN dr USING (frame_id))
    SELECT display, count(*) AS pixels FROM ds GROUP BY display
""")  # fmt: skip
def display_uint8_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clipped(spark, sf_dir)
    return c.join(r.display_range(c), "frame_id").select(r.display_scale(F.col("clipped"), F.col("lower"), F.col("upper")).alias("display")).groupBy("display").agg(F.count("*").alias("pixels"))


@query("band_difference_mask", f"WITH {b.PIXELS} SELECT frame_id, count(*) FILTER (NOT invalid) AS valid_count, count(*) FILTER (NOT invalid AND v7 - v14 > 25) AS hot_count, round(max(CASE WHEN NOT invalid THEN (v7 - v14)::DOUBLE END), 3) AS greatest_difference FROM px GROUP BY frame_id")
def band_difference_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.pixels(spark, sf_dir).withColumn("d", r.difference(F.col("v7"), F.col("v14"), ~F.col("invalid")))
    return p.groupBy("frame_id").agg(F.count_if(~F.col("invalid")).alias("valid_count"), F.count_if(r.threshold(F.col("d"), 25.0)).alias("hot_count"), F.round(F.max(F.col("d").cast("double")), 3).alias("greatest_difference"))


#: m(frame_id, row, col, contrast, d, raw, opened, morph): masks by joins on offsets
MASKS = """
    k5(o, w) AS (VALUES (-2, 0.0625::DOUBLE), (-1, 0.25::DOUBLE), (0, 0.375::DOUBLE), (1, 0.25::DOUBLE), (2, 0.0625::DOUBLE)),
    plus(dr, dc) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)),
    st AS (SELECT a.frame_id, a.row, a.col, r.w * c.w AS w, greatest(0, least(7, a.row + r.o)) AS sr, greatest(0, least(7, a.col + c.o)) AS sc FROM px a, k5 r, k5 c WHERE NOT a.invalid),
    bl AS (SELECT st.frame_id, st.row, st.col, sum(CASE WHEN NOT s.invalid THEN st.w * s.v7 ELSE 0 END) / sum(CASE WHEN NOT s.invalid THEN st.w ELSE 0 END) AS mean
        FROM st JOIN px s ON s.frame_id = st.frame_id AND s.row = st.sr AND s.col = st.sc GROUP BY ALL),
    m0 AS (SELECT px.frame_id, px.row, px.col, px.invalid, px.v7 - bl.mean AS contrast, CASE WHEN NOT px.invalid THEN (px.v7 - px.v14)::DOUBLE END AS d,
        coalesce(px.v7 - bl.mean > 2.0, false) AS local, coalesce(NOT px.invalid AND px.v7 - px.v14 > 25, false) AS band FROM px LEFT JOIN bl USING (frame_id, row, col)),
    m1 AS (SELECT *, local AND band AS raw FROM m0),
    e1 AS (SELECT a.frame_id, a.row, a.col, bool_and(coalesce(s.raw, true)) AS x FROM m1 a CROSS JOIN plus p LEFT JOIN m1 s ON s.frame_id = a.frame_id AND s.row = a.row + p.dr AND s.col = a.col + p.dc GROUP BY ALL),
    e2 AS (SELECT a.frame_id, a.row, a.col, bool_or(coalesce(s.x, false)) AS x FROM e1 a CROSS JOIN plus p LEFT JOIN e1 s ON s.frame_id = a.frame_id AND s.row = a.row + p.dr AND s.col = a.col + p.dc GROUP BY ALL),
    e3 AS (SELECT a.frame_id, a.row, a.col, bool_or(coalesce(s.x, false)) AS x FROM e2 a CROSS JOIN plus p LEFT JOIN e2 s ON s.frame_id = a.frame_id AND s.row = a.row + p.dr AND s.col = a.col + p.dc GROUP BY ALL),
    e4 AS (SELECT a.frame_id, a.row, a.col, bool_and(coalesce(s.x, true)) AS x FROM e3 a CROSS JOIN plus p LEFT JOIN e3 s ON s.frame_id = a.frame_id AND s.row = a.row + p.dr AND s.col = a.col + p.dc GROUP BY ALL),
    m AS (SELECT m1.*, e4.x AND NOT m1.invalid AS morph FROM m1 JOIN e4 USING (frame_id, row, col))
"""


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.anomaly_pixels(r.anomaly_tiles(b.pixels(spark, sf_dir)))


@query("local_contrast_mask", f"WITH {b.PIXELS}, {MASKS} SELECT frame_id, count(*) FILTER (local) AS local_count, count(*) FILTER (local AND band) AS raw_count, round(max(contrast), 3) AS greatest_contrast FROM m GROUP BY frame_id")
def local_contrast_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir).groupBy("frame_id").agg(F.count_if("local").alias("local_count"), F.count_if("raw").alias("raw_count"), F.round(F.max("contrast"), 3).alias("greatest_contrast"))


@query("morphology_open_close", f"WITH {b.PIXELS}, {MASKS} SELECT frame_id, row, col FROM m WHERE morph")
def morphology_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir).where("morphology").select("frame_id", "row", "col")


@query("tile_resize_4x4", f"""
    WITH {b.PIXELS} SELECT frame_id, CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, CASE WHEN count(*) FILTER (NOT invalid) / 4.0 + 1e-6 >= 0.5 THEN round(avg(v7::DOUBLE) FILTER (NOT invalid), 3) END AS value FROM px GROUP BY ALL
""")  # fmt: skip
def tile_resize_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.resized(r.anomaly_tiles(b.pixels(spark, sf_dir)), "v7", (4, 4)).select("frame_id", "row", "col", F.round("value", 3).alias("value"))


#: cp(frame_id, root, row, col): 8-connected components of the morphology mask; ungated
COMPONENTS = """
    mk AS (SELECT frame_id, row * 8 + col AS cell, row, col, contrast, d FROM m WHERE morph),
    reach(frame_id, cell, root) AS (
        SELECT frame_id, cell, cell FROM mk
        UNION
        SELECT s.frame_id, s.cell, reach.root FROM reach JOIN mk t ON t.frame_id = reach.frame_id AND t.cell = reach.cell
            JOIN mk s ON s.frame_id = t.frame_id AND abs(s.row - t.row) <= 1 AND abs(s.col - t.col) <= 1
    ),
    cp AS (SELECT mk.frame_id, min(reach.root) AS root, mk.row, mk.col, any_value(mk.contrast) AS contrast, any_value(mk.d) AS d FROM mk JOIN reach USING (frame_id, cell) GROUP BY mk.frame_id, mk.row, mk.col),
    cs AS (
        SELECT frame_id, CAST(count(*) AS INTEGER) AS area, min(col) AS box_x, min(row) AS box_y, CAST(max(col) - min(col) + 1 AS INTEGER) AS box_width, CAST(max(row) - min(row) + 1 AS INTEGER) AS box_height,
            avg(col) AS centroid_x, avg(row) AS centroid_y, least(min(col), min(row), 7 - max(col), 7 - max(row)) AS edge_distance,
            avg(contrast) AS mean_contrast, max(contrast) AS max_contrast, avg(d) AS mean_difference, max(d) AS max_difference, root
        FROM cp GROUP BY frame_id, root
    )
"""
STATS = ["mean_contrast", "max_contrast", "mean_difference", "max_difference", "centroid_x", "centroid_y", "edge_proximity"]
BOX = "frame_id, area, box_x, box_y, box_width, box_height, edge_distance"


@query("component_stats", f"WITH RECURSIVE {b.PIXELS}, {MASKS}, {COMPONENTS} SELECT {BOX}, {sql_rounded(STATS[:6], 3)}, round(1.0 - least(edge_distance / 4.0, 1.0), 3)::DOUBLE AS edge_proximity, edge_distance = 0 AS touches_edge, area >= 4 AND edge_distance >= 1 AS kept FROM cs")
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.anomaly_components(r.anomaly_tiles(b.pixels(spark, sf_dir)), SMALL).select(*BOX.split(", "), *rounded(STATS, 3), "touches_edge", "kept")


@query("anomaly_candidates", f"WITH RECURSIVE {b.PIXELS}, {MASKS}, {COMPONENTS}, {QUALITY.format(v='v7')} SELECT frame_id, count(cs.area) AS region_count, CAST(coalesce(sum(cs.area), 0) AS BIGINT) AS candidate_pixel_count, any_value(qr.reason) AS reason FROM qr LEFT JOIN (SELECT * FROM cs WHERE area >= 4 AND edge_distance >= 1) cs USING (frame_id) WHERE qr.reason IS NULL GROUP BY frame_id UNION ALL SELECT frame_id, 0, 0, reason FROM qr WHERE reason IS NOT NULL")
def anomaly_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and pixels of every frame after the filter and the quality gate (the other band is never poor here: it has the same mask and no damage)."""
    p = b.pixels(spark, sf_dir)
    reasons = r.quality_reason(r.frame_quality(p)).select("frame_id", "reason")
    found = r.anomaly_components(r.anomaly_tiles(p), SMALL).where("kept").groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("area").alias("pixels"))
    usable = F.col("reason").isNull()
    return reasons.join(found, "frame_id", "left").select("frame_id", F.when(usable, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("region_count"), F.when(usable, F.coalesce("pixels", F.lit(0))).otherwise(0).cast("long").alias("candidate_pixel_count"), "reason")


@query("nearest_pixel", f"""
    WITH {b.PIXELS}, g AS (SELECT frame_id, row, col, 30 + row * 0.01::DOUBLE AS lat, -120 + col * 0.01::DOUBLE AS lon FROM px WHERE NOT invalid),
    n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY pow(lat - (30.035 + (frame_id % 5) * 0.004), 2) + pow(lon - (-119.962), 2), row, col) AS k FROM g)
    SELECT frame_id, row, col, round(lat, 6) AS lat, round(lon, 6) AS lon FROM n WHERE k = 1
""")  # fmt: skip
def nearest_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = b.pixels(spark, sf_dir).where("NOT invalid").selectExpr("frame_id", "row", "col", "30 + row * 0.01D AS lat", "-120 + col * 0.01D AS lon")
    return r.nearest_pixel(g, F.expr("30.035D + (frame_id % 5) * 0.004D"), F.lit(-119.962)).select("frame_id", "row", "col", *rounded(["lat", "lon"]))


@query("slice_components", f"""
    WITH RECURSIVE {b.PIXELS}, hot AS (SELECT * EXCLUDE (raw), NOT invalid AND v7 > 320 AS raw FROM px), {MASKS[MASKS.index('plus(dr'):MASKS.index('st AS')]}
    {MASKS[MASKS.index('e1 AS'):MASKS.index('m AS (SELECT m1')].replace('FROM m1', 'FROM hot').replace('JOIN m1', 'JOIN hot')}
    mk AS (SELECT frame_id, e4.row * 8 + e4.col AS cell, row, col, v7 FROM e4 JOIN px USING (frame_id, row, col) WHERE e4.x),
    reach(frame_id, cell, root) AS (SELECT frame_id, cell, cell FROM mk UNION SELECT s.frame_id, s.cell, reach.root FROM reach JOIN mk t ON t.frame_id = reach.frame_id AND t.cell = reach.cell JOIN mk s ON s.frame_id = t.frame_id AND abs(s.row - t.row) <= 1 AND abs(s.col - t.col) <= 1),
    cp AS (SELECT mk.frame_id, min(reach.root) AS root, mk.row, mk.col, any_value(mk.v7) AS v7 FROM mk JOIN reach USING (frame_id, cell) GROUP BY mk.frame_id, mk.row, mk.col)
    SELECT frame_id, CAST(count(*) AS INTEGER) AS area, min(col) AS box_x, min(row) AS box_y, round(max(v7)::DOUBLE, 3) AS max_v7 FROM cp GROUP BY frame_id, root
""")  # fmt: skip
def slice_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.slice_components(r.anomaly_tiles(b.pixels(spark, sf_dir)), 320.0).select("frame_id", "area", "box_x", "box_y", F.round("max_v7", 3).alias("max_v7"))


@query("contours")
def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.contour_rows(r.anomaly_tiles(b.pixels(spark, sf_dir)), SMALL)


@query("equalized_display")
def equalized_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clipped(spark, sf_dir)
    shown = c.join(r.display_range(c), "frame_id").withColumn("display", r.display_scale(F.col("clipped"), F.col("lower"), F.col("upper"))).withColumn("ok", ~F.col("invalid"))
    return r.equalized_display(r.tiles(shown, ["display", "ok"], ["frame_id"]))


@query("overlay_range", f"""
    WITH {b.PIXELS}, o AS (SELECT frame_id, quantile_cont(v7::DOUBLE, 0.02) FILTER (NOT invalid) AS a, quantile_cont(v7::DOUBLE, 0.98) FILTER (NOT invalid) AS b, min(v7) FILTER (NOT invalid) AS c, max(v7) FILTER (NOT invalid) AS d FROM px GROUP BY frame_id)
    SELECT frame_id, round(CASE WHEN b > a THEN a WHEN d > c THEN c::DOUBLE END, 4) AS lower, round(CASE WHEN b > a THEN b WHEN d > c THEN d::DOUBLE END, 4) AS upper FROM o
""")  # fmt: skip
def overlay_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.pixels(spark, sf_dir).withColumn("v", F.when(~F.col("invalid"), F.col("v7").cast("double")))
    return r.overlay_range(p, "v").select("frame_id", *rounded(["lower", "upper"], 4))


@query("pixel_window_crop", f"WITH {b.PIXELS} SELECT frame_id, count(*) AS pixels, round(avg(v7::DOUBLE), 3) AS mean FROM px WHERE row >= 2 AND row < 6 AND col >= 1 AND col < 7 AND NOT invalid GROUP BY frame_id")
def pixel_window_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.crop(b.pixels(spark, sf_dir), 2, 6, 1, 7).where("NOT invalid").groupBy("frame_id").agg(F.count("*").alias("pixels"), F.round(F.avg(F.col("v7").cast("double")), 3).alias("mean"))
