"""Streaming front ends: detections to events by session windows, frames to tracks, journals to tables, a detection feed with late data."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from thermal_lake.functions import checks, geo
from thermal_lake.operators import track
from thermal_lake.shipping import ship


def detections(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A file feed of Parquet detections."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def events(feed: DataFrame, gap: str = "60 minutes", late: str = "2 hours", at: str = "acquired_at") -> DataFrame:
    """Events as sessions of each 2-degree cell: the streaming approximation of single linkage (a session never leaves its cell).

    Rows later than the watermark are dropped by Spark; in append mode a session is out once the watermark passes its end.
    """
    cell = geo.region_cell(F.col("latitude"), F.col("longitude"))
    s = feed.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), cell.alias("cell"))
    return s.agg(F.count("*").alias("detections"), F.min(at).alias("start_time"), F.max(at).alias("end_time"), F.max("brightness_kelvin").alias("brightest")).select("cell", "start_time", "end_time", "detections", "brightest")


def hourly(feed: DataFrame, late: str = "2 hours", at: str = "acquired_at", slide: str | None = None) -> DataFrame:
    """Counts by hour (sliding, if slide is given) and instrument, with late data up to the watermark."""
    window = F.window(at, "1 hour", slide) if slide else F.window(at, "1 hour")
    return feed.withWatermark(at, late).groupBy(window.alias("w"), "instrument").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "instrument", "n")


def unique(feed: DataFrame, keys: list[str], late: str = "2 hours", at: str = "acquired_at") -> DataFrame:
    """Exact duplicates removed as long as the watermark allows."""
    return feed.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


MATCHES = "case_id long, step int, label int, track_id int, is_new boolean"


def follow_regions(feed: DataFrame, p: checks.Persistence = checks.Persistence()) -> DataFrame:  # noqa: B008
    """Each frame's regions with their track, as frames arrive: (case_id, step, missing, regions as an array of label, area, lat, lon, cells). The state of a case is its last frame; frames of a case have to arrive in order."""
    ship(feed.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, following, last = state.get if state.exists else (None, 1, -1)
        known = None if text is None else {int(k): v for k, v in json.loads(text).items()}
        rows = []
        for frame in sorted((r for b in batches for r in b.to_dict("records")), key=lambda r: r["step"]):
            if frame["missing"]:
                known = None
                continue
            now: dict[int, dict] = {}
            regions = {int(r["label"]): {k: r[k] for k in ("area", "lat", "lon")} | {"cells": [int(c) for c in r["cells"]]} for r in frame["regions"]}
            if known:
                frames = [{k: v | {"cells": frozenset(v["cells"]), "temperature": 0.0} for k, v in part.items()} for part in (known, regions)]
                _, matches = track.follow(frames, p)
                for m in matches:
                    now[m["later"]] = regions[m["later"]] | {"track": known[m["earlier"]]["track"]}
                    rows.append((key[0], frame["step"], m["later"], known[m["earlier"]]["track"], False))
            for label in sorted(regions):
                if label not in now:
                    now[label] = regions[label] | {"track": following}
                    rows.append((key[0], frame["step"], label, following, True))
                    following += 1
            known, last = now, frame["step"]
        state.update((None if known is None else json.dumps(known), following, int(last)))
        yield pd.DataFrame(rows, columns=["case_id", "step", "label", "track_id", "is_new"])

    return feed.groupBy("case_id").applyInPandasWithState(step, MATCHES, "before string, following int, last int", "append", GroupStateTimeout.NoTimeout)


def journal_table(feed: DataFrame, table: str, checkpoint: str):
    """A query that appends a feed of transitions to a table; a batch that runs twice adds nothing twice."""
    from thermal_lake.sources import journal

    return feed.writeStream.foreachBatch(lambda batch, _: journal.append(batch, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
