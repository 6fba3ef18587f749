"""The operators' inputs, made of the driver tables; each in Spark and, under SQL, as DuckDB says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8 x 8 pixels: frame_id, case_id, row, col, raw (the value), invalid, v7 and v14 (float)."""
    t = table(spark, sf_dir, "embeddings")
    p = t.select(F.col("vec_id").alias("frame_id"), F.col("label").cast("long").alias("case_id"), F.posexplode("embedding").alias("pos", "raw"))
    return p.selectExpr("frame_id", "case_id", "pos", "pos div 8 AS row_l", "pos % 8 AS col", "raw").selectExpr("frame_id", "case_id", "cast(row_l AS int) AS row", "cast(col AS int) AS col", "raw", *_planes("row_l"))


def _planes(row: str) -> list[str]:
    block = f"({row} BETWEEN 1 + case_id % 4 AND 3 + case_id % 4 AND col BETWEEN 1 + case_id % 3 AND 3 + case_id % 3 AND frame_id % 3 <> 0)"
    return [
        f"((frame_id * 31 + pos * 17) % 23 = 0 OR (frame_id % 17 = 1 AND {row} <= 3)) AS invalid",
        f"cast(CASE WHEN frame_id % 17 = 2 THEN 0.0D WHEN frame_id % 17 = 4 THEN 300.0D WHEN frame_id % 17 = 3 AND {row} = 0 THEN 350.0D ELSE 290.0D + 60.0D * cast(raw AS double) + (CASE WHEN {block} THEN 40.0D ELSE 0.0D END) END AS float) AS v7",
        "cast(280.0D + 20.0D * cast(raw AS double) AS float) AS v14",
    ]


def _duck(expressions: list[str]) -> str:
    return ", ".join(expressions).replace("0D", "0::DOUBLE")


#: px(frame_id, case_id, pos, row, col, raw, invalid, v7, v14)
PIXELS = f"""
    px0 AS (SELECT vec_id AS frame_id, CAST(label AS BIGINT) AS case_id, embedding, unnest(range(0, len(embedding))) AS pos FROM embeddings),
    px1 AS (SELECT frame_id, case_id, pos, pos // 8 AS row_l, pos % 8 AS col, embedding[pos + 1] AS raw FROM px0),
    px AS (SELECT frame_id, case_id, pos, CAST(row_l AS INTEGER) AS row, CAST(col AS INTEGER) AS col, raw, {_duck(_planes("row_l"))} FROM px1)
"""


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point detections as a CSV reader gives them, all text: event_id and the columns of the format."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id",
        "cast(cast((30000000 + (user_id % 40) * 500000 + ((event_id * 7919) % 400) * 100) AS decimal(18, 0)) / 1000000 AS decimal(12, 6)) AS lat",
        "cast(cast((-130000000 + (user_id div 40) * 500000 + ((event_id * 104729) % 400) * 100) AS decimal(18, 0)) / 1000000 AS decimal(12, 6)) AS lon",
        "date_format(ts, 'yyyy-MM-dd') AS acq_date", "cast(hour(ts) * 100 + minute(ts) AS string) AS acq_time",
        "CASE event_id % 5 WHEN 0 THEN 'l' WHEN 1 THEN 'Nominal' WHEN 2 THEN 'H' WHEN 3 THEN '55.50' ELSE '80' END AS confidence",
        "cast(cast(300 + value / 10 AS decimal(12, 4)) AS string) AS brightness", "CASE WHEN event_id % 2 = 0 THEN 'viirs' ELSE 'Modis' END AS instrument",
    ).selectExpr("event_id", "user_id", "cast(lat AS string) AS latitude", "cast(lon AS string) AS longitude", "acq_date", "acq_time", "confidence", "brightness", "instrument")


RAW_DETECTIONS = """
    rd AS (
        SELECT event_id, user_id,
            CAST(CAST((30000000 + (user_id % 40) * 500000 + ((event_id * 7919) % 400) * 100) / 1000000 AS DECIMAL(12, 6)) AS VARCHAR) AS latitude,
            CAST(CAST((-130000000 + (user_id // 40) * 500000 + ((event_id * 104729) % 400) * 100) / 1000000 AS DECIMAL(12, 6)) AS VARCHAR) AS longitude,
            strftime(ts, '%Y-%m-%d') AS acq_date, CAST(hour(ts) * 100 + minute(ts) AS VARCHAR) AS acq_time,
            CASE event_id % 5 WHEN 0 THEN 'l' WHEN 1 THEN 'Nominal' WHEN 2 THEN 'H' WHEN 3 THEN '55.50' ELSE '80' END AS confidence,
            CAST(CAST(300 + value / 10 AS DECIMAL(12, 4)) AS VARCHAR) AS brightness, CASE WHEN event_id % 2 = 0 THEN 'viirs' ELSE 'Modis' END AS instrument
        FROM events
    )
"""

#: det(event_id, user_id, acquired_at, latitude, longitude, confidence, brightness_kelvin, instrument)
DETECTIONS = RAW_DETECTIONS + """,
    det AS (
        SELECT event_id, user_id,
            strptime(acq_date || ' ' || lpad(acq_time, 4, '0'), '%Y-%m-%d %H%M') AS acquired_at,
            CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude,
            CASE lower(confidence) WHEN 'l' THEN 'low' WHEN 'low' THEN 'low' WHEN 'n' THEN 'nominal' WHEN 'nominal' THEN 'nominal' WHEN 'h' THEN 'high' WHEN 'high' THEN 'high'
                ELSE regexp_replace(regexp_replace(CAST(CAST(confidence AS DECIMAL(12, 3)) AS VARCHAR), '0+$', ''), '\\.$', '') END AS confidence,
            CAST(round(CAST(brightness AS DECIMAL(12, 4)), 3) AS DOUBLE) AS brightness_kelvin, upper(instrument) AS instrument
        FROM rd
    )
"""


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three modes of scored cases: split, case_id, label, mode, prediction (or null), resources, group keys."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    modes = "inline(array(named_struct('m', 0, 'mode', 'one_shot'), named_struct('m', 1, 'mode', 'fixed_bundle'), named_struct('m', 2, 'mode', 'adaptive')))"
    return rows.selectExpr("doc_id", "quality", "toxic", "n_chars", "source", "lang", modes).selectExpr(*SCORE_COLUMNS)


SCORE_COLUMNS = [
    "CASE WHEN doc_id % 5 < 3 THEN 'test' ELSE 'stress' END AS split", "doc_id AS case_id", "CASE WHEN quality = 1 THEN 'positive' ELSE 'control' END AS label", "mode",
    "CASE WHEN (doc_id * 37 + toxic + m * 11) % 4 = 0 THEN NULL WHEN (doc_id * 37 + toxic + m * 11) % 4 = 3 THEN 'control' ELSE 'positive' END AS prediction",
    "cast(1 + (doc_id + m) % 3 + m AS bigint) AS observation_count", "cast(n_chars * (m + 1) AS bigint) AS selected_source_bytes", "cast(n_chars * m AS bigint) AS downloaded_bytes",
    "cast((doc_id * 13 + m * 7) % 1000 AS double) / 8.0 AS latency_milliseconds", "cast((doc_id + m) % 7 = 0 AS int) AS error_count", "source", "lang",
]

#: sr(the columns of score_rows)
SCORE_ROWS = "sr AS (SELECT " + ", ".join(SCORE_COLUMNS).replace("cast((doc_id + m) % 7 = 0 AS int)", "CAST((doc_id + m) % 7 = 0 AS INTEGER)") + " FROM labels JOIN documents USING (doc_id) CROSS JOIN (VALUES (0, 'one_shot'), (1, 'fixed_bundle'), (2, 'adaptive')) AS modes(m, mode))"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation windows: window_id, anchor_at, latitude, longitude, view_zenith_degrees, usable_fraction."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS window_id", "cast(o_orderdate AS timestamp) AS anchor_at", *WINDOW_COLUMNS)


WINDOW_COLUMNS = [
    "cast(30 + (o_custkey % 40) * 0.5 + 0.05 AS double) AS latitude", "cast(-130 + (o_custkey % 50) * 0.5 + 0.05 AS double) AS longitude",
    "cast((o_orderkey * 7) % 90 AS double) AS view_zenith_degrees", "cast(((o_orderkey * 13) % 101) AS double) / 100 AS usable_fraction",
]
WINDOWS = "win AS (SELECT o_orderkey AS window_id, o_orderdate AS anchor_at, " + ", ".join(WINDOW_COLUMNS) + " FROM orders)"


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections near windows: detection_id, acquired_at, latitude, longitude."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS detection_id", "cast(l_shipdate AS timestamp) AS acquired_at", *SHIPPED_COLUMNS)


SHIPPED_COLUMNS = ["cast(30 + (l_partkey % 40) * 0.5 + (l_suppkey % 7) * 0.03 AS double) AS latitude", "cast(-130 + (l_partkey % 50) * 0.5 + (l_suppkey % 5) * 0.03 AS double) AS longitude"]
SHIPPED = "shp AS (SELECT l_orderkey * 8 + l_linenumber AS detection_id, l_shipdate AS acquired_at, " + ", ".join(SHIPPED_COLUMNS) + " FROM lineitem)"


SEQUENCE = "turn + 1 + CASE WHEN conv_id % 9 = 4 AND turn > 0 THEN 1 ELSE 0 END"


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions: trace_id, sequence, to_state; some traces have a gap."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS trace_id", f"{SEQUENCE} AS sequence", "role AS to_state", "length(text) AS size")


JOURNAL = f"jr AS (SELECT conv_id AS trace_id, {SEQUENCE} AS sequence, role AS to_state, length(text) AS size FROM conversations)"
