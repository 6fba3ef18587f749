"""Joins in space and time: as-of, within a distance, anti, one to one."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from thermal_lake.functions import calendar, geo
from thermal_lake.operators import graph
from thermal_lake.shipping import ship

HOUR = 3_600_000_000


def nearest_scans(requests: DataFrame, scans: DataFrame, request: str, at: str, channel: str, maximum_micros: int, scan_at: str = "scan_start", key: str = "object_key") -> DataFrame:
    """Each request's scan of its channel nearest in time, by (distance, start, key), within maximum_micros; or a missing_reason.

    Candidates are the scans of the hours that the time, give or take the maximum, touches. Requests and scans of a (channel, hour) stand in one order of time, so that a request's neighbours in it are the nearest before and after and
    no pair is made; candidate_count is of all candidates there. Keys are looked up for what was found.
    """
    asked = requests.select(F.col(request).alias("_request"), F.col(at).alias("_at"), F.col(channel).alias("_channel"), F.explode(calendar.hour_prefixes(F.col(at), maximum_micros // 1_000_000)).alias("_hour"))
    there = scans.select(F.col(channel).alias("_channel"), F.col(scan_at).alias("_at"), F.col(key).alias("_key")).where("_channel IS NOT NULL AND _at IS NOT NULL")
    starts = there.groupBy("_channel", "_at").agg(F.count("*").alias("_n"))
    line = asked.select("_channel", "_hour", "_at", F.lit(1).alias("_asks"), "_request", F.lit(None).cast("long").alias("_n"))
    line = line.unionByName(starts.select("_channel", F.date_trunc("hour", "_at").alias("_hour"), "_at", F.lit(0).alias("_asks"), F.lit(None).cast(requests.schema[request].dataType).alias("_request"), "_n"))
    hour = Window.partitionBy("_channel", "_hour")
    so_far = lambda order: F.last(F.when(F.col("_asks") == 0, F.col("_at")), ignorenulls=True).over(hour.orderBy(order, "_asks").rowsBetween(Window.unboundedPreceding, 0))
    line = line.withColumn("_n", F.sum("_n").over(hour)).withColumn("_before", so_far(F.asc("_at"))).withColumn("_after", so_far(F.desc("_at"))).where("_asks = 1 AND _n IS NOT NULL")
    since, until = calendar.seconds_between(F.col("_before"), F.col("_at")), calendar.seconds_between(F.col("_after"), F.col("_at"))
    nearest = F.when(F.col("_after").isNull() | (since <= until), F.col("_before")).otherwise(F.col("_after"))
    best = line.groupBy("_request").agg(F.min(F.struct(calendar.seconds_between(nearest, F.col("_at")).alias("d"), nearest.alias("at"), F.col("_channel").alias("channel"))).alias("b"), F.sum("_n").alias("candidate_count"))
    keys = there.groupBy(F.col("_channel").alias("_c"), F.col("_at").alias("_start")).agg(F.min(F.struct("_key")).alias("_first"))
    near = F.col("b.d") <= maximum_micros
    out = requests.select(request).join(best, F.col(request) == F.col("_request"), "left")
    out = out.withColumn("_near", F.when(near, F.col("b.at"))).join(keys, (F.col("b.channel") == F.col("_c")) & (F.col("_near") == F.col("_start")), "left")
    return out.select(
        request, F.col("_near").alias("scan_start"), F.when(near, F.col("_first._key")).alias("object_key"), F.when(near, F.col("b.d")).alias("offset_micros"),
        F.when(F.col("b").isNull(), "no_matching_objects").when(~near, "outside_maximum_offset").alias("missing_reason"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
    )


def near_cells(df: DataFrame, lat: Column, lon: Column, km: float, names: tuple[str, str, str], around: bool) -> DataFrame:
    """df with its sphere cell; around: one row for each of the 27 cells around it."""
    cells = geo.sphere_cells(lat, lon, km)
    df = df.withColumns(dict(zip(names, cells, strict=True)))
    if around:
        for n in names:
            df = df.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    return df


def within(left: DataFrame, right: DataFrame, km: float, micros: int, how: str, condition: Column, left_span: tuple[str, str], right_at: str, key: str = "") -> DataFrame:
    """left joined to right (how: inner, or left_anti by left's key) within a distance and a time: an equi-join on cells and time buckets, then the exact condition.

    left has _lat, _lon and a time span; right has lat, lon and right_at. Each left row covers the buckets that its span, widened by micros, touches; each right row the cells around its own.
    """
    size = max(1, micros)
    bucket = lambda c: F.floor(F.unix_micros(c) / size)
    names = ("_x", "_y", "_z")
    reach = near_cells(left, F.col("_lat"), F.col("_lon"), km, names, True).withColumn("_t", F.explode(F.sequence(F.floor((F.unix_micros(left_span[0]) - micros) / size), F.floor((F.unix_micros(left_span[1]) + micros) / size))))
    there = near_cells(right, F.col("lat"), F.col("lon"), km, ("_rx", "_ry", "_rz"), False).withColumn("_rt", bucket(F.col(right_at)))
    met = (F.col("_x") == F.col("_rx")) & (F.col("_y") == F.col("_ry")) & (F.col("_z") == F.col("_rz")) & (F.col("_t") == F.col("_rt")) & condition
    if how == "inner":
        pairs = reach.join(there, met)
        return pairs.drop(*names, "_t", "_rx", "_ry", "_rz", "_rt")
    hit = reach.join(there, met, "left_semi").select(key).distinct()
    return left.join(hit, key, "left_anti")


def positive_candidates(events: DataFrame, windows: DataFrame, km: float = 25.0, micros: int = 90 * 60_000_000) -> DataFrame:
    """All (event, window) pairs near in time and space: event_id, window_id, start_time, distance_micros, distance_km.

    Places are paired first, each once however many rows it has; events and windows then meet on the window's place and a time bucket.
    """
    e = events.selectExpr("event_id", "start_time", "end_time", "latitude AS _lat", "longitude AS _lon")
    w = windows.selectExpr("window_id", "anchor_at", "latitude AS lat", "longitude AS lon")
    places = place_pairs(e.select("_lat", "_lon").distinct(), w.select("lat", "lon").distinct(), km)
    late = calendar.micros_to_interval(F.col("anchor_at"), F.col("start_time"), F.col("end_time"))
    size = max(1, REACHES * micros)
    bucket = lambda c, by: F.floor((F.unix_micros(c) + (by + size // 2)) / size)
    there = e.join(F.broadcast(places) if places.count() <= FEW_PLACES else places, ["_lat", "_lon"]).drop("_lat", "_lon")
    there = there.withColumn("_t", F.explode(F.sequence(bucket("start_time", -micros), bucket("end_time", micros))))
    pairs = there.join(w.withColumn("_t", bucket("anchor_at", 0)), ["lat", "lon", "_t"]).where(late <= micros)
    return pairs.select("event_id", "window_id", "start_time", late.cast("long").alias("distance_micros"), "distance_km")


#: Pairs of places that are broadcast, at most; more meet their events by a shuffle.
FEW_PLACES = 200_000
#: Width of a time bucket, in times that two rows may be apart.
REACHES = 8


def place_pairs(first: DataFrame, second: DataFrame, km: float) -> DataFrame:
    """(_lat, _lon, lat, lon, distance_km) of the places (_lat, _lon) and (lat, lon) within the distance, as a table."""
    names, cells = ("_x", "_y", "_z"), ("_rx", "_ry", "_rz")
    distance = geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    reach = near_cells(first, F.col("_lat"), F.col("_lon"), km, names, True)
    there = near_cells(second, F.col("lat"), F.col("lon"), km, cells, False)
    met = reach.join(there, [F.col(a) == F.col(b) for a, b in zip(names, cells, strict=True)]).withColumn("distance_km", distance).where(F.col("distance_km") <= km)
    return graph.written(met.select("_lat", "_lon", "lat", "lon", "distance_km"), "place-pairs")


def greedy_assignment(pairs: DataFrame) -> DataFrame:
    """Events in (start, id) order each take the nearest window not yet taken. Groups that share no window are independent, so each connected group is one kernel call.

    A group is as large as the chain of shared windows; the kernel holds that group's pairs only.
    """
    ship(pairs.sparkSession)
    nodes = pairs.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("a"), F.concat(F.lit("w"), F.col("window_id").cast("string")).alias("b"))
    roots = graph.components(nodes, "greedy")
    grouped = pairs.withColumn("node", F.concat(F.lit("e"), F.col("event_id").cast("string"))).join(roots, "node").drop("node")

    def take(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["start_time"], r["event_id"], r["distance_micros"], r["distance_km"], r["window_id"]))
        used, done, out = set(), set(), []
        for r in rows:
            if r["event_id"] not in done and r["window_id"] not in used:
                used.add(r["window_id"])
                done.add(r["event_id"])
                out.append(r)
        return pa.table({"event_id": pa.array([r["event_id"] for r in out], table.schema.field("event_id").type), "window_id": pa.array([r["window_id"] for r in out], table.schema.field("window_id").type)})

    kind = lambda c: pairs.schema[c].dataType.simpleString()
    return grouped.groupBy("root").applyInArrow(take, f"event_id {kind('event_id')}, window_id {kind('window_id')}")


def nearest_free(events: DataFrame, windows: DataFrame, km: float = 25.0, micros: int = 90 * 60_000_000) -> DataFrame:
    """greedy_assignment() of positive_candidates(), without making the pairs: (event_id, window_id).

    Places are paired, and connected ones make an area, as do those that one event has at one time. An area's times fall into runs that no event spans. A run is a task's alone, which reads its windows and then its events in (start, id)
    order and holds the windows that are free: those of one place and time are a queue by id. An event id with several starts asks at the first of them; where it gets none, or loses it, it asks at the next one in a further round: a window
    only ever passes to an earlier (start, id), so what was lost stays lost, and a round takes up the runs that are asked again with those who hold their windows. A window id that is taken twice, or an event of one start in several runs
    (ends before starts), has the pairs made after all.
    """
    spark = events.sparkSession
    ship(spark)
    e = events.selectExpr("event_id", "start_time", "end_time", "latitude + 0.0D AS _lat", "longitude + 0.0D AS _lon").dropna()
    w = windows.selectExpr("window_id", "anchor_at", "latitude + 0.0D AS lat", "longitude + 0.0D AS lon").dropna()
    with graph.scratch(spark) as keep:
        near = place_pairs(e.select("_lat", "_lon").distinct(), w.select("lat", "lon").distinct(), km)
        e_places = graph.written(near.select("_lat", "_lon").distinct().withColumn("place", F.monotonically_increasing_id() * 2), "event-places")
        w_places = graph.written(near.select("lat", "lon").distinct().withColumn("there", F.monotonically_increasing_id() * 2 + 1), "window-places")
        pairs = keep(graph.written(near.join(e_places, ["_lat", "_lon"]).join(w_places, ["lat", "lon"]).select("place", "there", "distance_km"), "places-paired"))
        areas = graph.components(pairs.selectExpr("place AS a", "there AS b"), "areas")
        areas = _areas_of_events(e, e_places, areas, pairs.count() <= FEW_PLACES)
        options = pairs.groupBy("place").agg(F.collect_list(F.struct("there", "distance_km")).alias("options"))
        few = pairs.count() <= FEW_PLACES
        some = lambda df: F.broadcast(df) if few else df
        e_places = e_places.join(areas, F.col("place") == F.col("node")).withColumnRenamed("root", "area").drop("node")
        e_places = keep(graph.written(e_places if few else e_places.join(options, "place"), "event-areas"))
        w_places = keep(graph.written(w_places.join(areas, F.col("there") == F.col("node")).withColumnRenamed("root", "area").drop("node"), "window-areas"))
        at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        e = e.join(some(e_places), ["_lat", "_lon"]).drop("_lat", "_lon").withColumns({"start": at("start_time"), "end": at("end_time")}).drop("start_time", "end_time")
        e = e.withColumns({"since": F.least("start", "end") - micros, "until": F.greatest("start", "end") + micros})
        w = w.join(some(w_places), ["lat", "lon"]).select("window_id", "area", "there", at("anchor_at").alias("at"))
        # each event's first window in time, and the runs of such times that no event spans
        line = e.groupBy("area", F.col("since").alias("t")).agg(F.max("until").alias("until")).withColumn("anchor", F.lit(None).cast("long"))
        line = graph.written(line.unionByName(w.select("area", F.col("at").alias("t"), F.lit(None).cast("long").alias("until"), F.col("at").alias("anchor")).distinct()), "area-times")
        later = Window.partitionBy("area").orderBy(F.desc("t"), F.col("anchor").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        firsts = graph.written(line.withColumn("first", F.last("anchor", ignorenulls=True).over(later)).where("anchor IS NULL AND first <= until").select("area", "t", "until", "first"), "area-firsts")
        reaches = firsts.groupBy("area", "first").agg(F.max("until").alias("reach"))
        so_far = Window.partitionBy("area").orderBy("first")
        reaches = line.where("anchor IS NOT NULL").select("area", F.col("anchor").alias("first")).join(reaches, ["area", "first"], "left").withColumn("before", F.max("reach").over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
        fresh = F.col("before").isNull() | (F.col("first") > F.col("before"))
        runs = reaches.withColumn("run", F.last(F.when(fresh, F.col("first")), ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0))).where(~fresh | F.col("reach").isNotNull())
        runs = keep(graph.written(runs.select("area", "first", "run"), "area-runs"))
        times = keep(graph.written(firsts.join(runs, ["area", "first"]).select("area", F.col("t").alias("since"), "first", "run"), "area-starts"))
    held = lambda df: F.broadcast(df) if df.count() <= FEW_PLACES else df
    own = {"event_id": events.schema["event_id"].dataType, "window_id": windows.schema["window_id"].dataType}
    no = lambda kind: F.lit(None).cast(kind)
    listed = [] if few else ["options"]
    known = spark.sparkContext.broadcast({r["place"]: [(o["there"], o["distance_km"]) for o in r["options"]] for r in options.collect()} if few else None)
    with graph.scratch(spark) as keep:
        e = e.join(held(times), ["area", "since"]).where("first <= until")
        turns = Window.partitionBy("event_id").orderBy("start")
        here, before = F.struct("area", "run", "start"), F.lag(F.struct("area", "run", "start")).over(turns)
        e = e.withColumns({"turn": F.dense_rank().over(turns), "more": F.col("start") < F.max("start").over(Window.partitionBy("event_id")), "split": F.coalesce((before["start"] == F.col("start")) & (before != here), F.lit(False))})
        asks = graph.written(e.select("area", "run", "start", "end", "event_id", "place", "turn", "more", "split", *listed), "asks")
        whole = asks.where("split").isEmpty()
        asks = asks.drop("split")
        w = graph.written(w.join(held(runs.withColumnRenamed("first", "at")), ["area", "at"]).select("area", "run", F.col("at").alias("start"), "window_id", F.col("there").alias("place")), "free-windows")
        out = StructType([*asks.schema.fields, StructField("window_id", own["window_id"])])
        parts = int(str(spark.conf.get("spark.sql.shuffle.partitions")))
        arrow, found, touched = to_arrow_schema(out), [], []
        asking, free = asks.where("turn = 1"), w
        while whole:
            rows = free.withColumn("kind", F.lit(0)).unionByName(asking.withColumn("kind", F.lit(1)), allowMissingColumns=True).select("kind", *out.names)
            rows = rows.repartition(parts, "area", "run").sortWithinPartitions("area", "run", "kind", "start", "event_id", "window_id")
            found.append(graph.written(rows.mapInArrow(lambda batches: _take_nearest(batches, known.value, micros, arrow), out), "asked"))
            lost = found[-1].where("window_id IS NULL").select("event_id", (F.col("turn") + 1).alias("turn")).distinct()
            again = graph.written(asks.where("turn > 1").join(lost, ["event_id", "turn"]).select(*asks.columns), "asks-again")
            # a run's windows are held by those whom the last round that took it up gave them
            latest = reduce(DataFrame.unionAll, touched).groupBy("area", "run").agg(F.max("round").alias("round")) if touched else None
            holders = reduce(DataFrame.unionAll, [f.where("window_id IS NOT NULL").withColumn("_round", F.lit(k)) for k, f in enumerate(found)])
            if latest is not None:
                holders = holders.join(held(latest), ["area", "run"], "left").where(F.col("_round") == F.coalesce("round", F.lit(0)))
            holders = holders.select(*out.names)
            if again.isEmpty():
                break
            touched.append(graph.written(again.select("area", "run").distinct().withColumn("round", F.lit(len(found))), "runs-again"))
            at_these = held(touched[-1].select("area", "run"))
            asking = holders.drop("window_id").join(at_these, ["area", "run"], "left_semi").select(*asks.columns).unionByName(again)
            free = w.join(at_these, ["area", "run"], "left_semi")
        taken = keep(graph.written(holders.select("event_id", "window_id").distinct(), "nearest-free")) if whole else None
        whole = whole and all(taken.groupBy(c).count().where("count > 1").isEmpty() for c in own)
    return taken if whole else greedy_assignment(positive_candidates(events, windows, km, micros))


def _areas_of_events(events: DataFrame, places: DataFrame, areas: DataFrame, few: bool) -> DataFrame:
    """areas (node, root), those joined that an event has places in at one start."""
    some = lambda df: F.broadcast(df) if few else df
    while not areas.select("root").distinct().limit(2).count() <= 1:
        at = some(places.join(areas, F.col("place") == F.col("node")).select("_lat", "_lon", "root"))
        spans = events.join(at, ["_lat", "_lon"]).groupBy("event_id", "start_time").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
        spans = graph.written(spans.select("a", "b").distinct(), "areas-spanned")
        if spans.isEmpty():
            break
        linked = graph.components(spans, "areas-linked").withColumnRenamed("node", "old").withColumnRenamed("root", "new")
        areas = graph.written(areas.join(some(linked), F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "areas")
    return areas


def _whole_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches, an event's of one start together."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        key = lambda i: tuple(table.column(c)[i] for c in ("area", "run", "kind", "start", "event_id"))  # noqa: E731, B023
        cut = table.num_rows - 1
        while cut > 0 and key(cut - 1) == key(cut):
            cut -= 1
        held = table.slice(cut)
        if cut > 0:
            yield table.slice(0, cut)
    if held is not None:
        yield held


def _take_nearest(batches: Iterator[pa.RecordBatch], known: dict | None, micros: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The kernel of nearest_free(): rows of runs, each run's windows first, then its events in order. Rows of events come back with the window that they get, and without one if they have a later start to ask at."""
    run, free, levels, at = None, {}, {}, None
    used: set = set()

    def levels_of(start: int, end: int, options: list) -> list:
        """[((late, km), queues)] of an event's place and times, nearest first."""
        near: dict = {}
        low, high = min(start, end) - micros, max(start, end) + micros
        for there, far in options:
            if there not in free:
                continue
            times, queues = free[there]
            for i in range(bisect_left(times, low), bisect_right(times, high)):
                t = times[i]
                late = 0 if start <= t <= end else min(abs(t - start), abs(t - end))
                if late <= micros:
                    near.setdefault((late, far), []).append(queues[i])
        return sorted(near.items(), key=lambda x: x[0])

    def nearest(asked: list) -> object:
        """The window of an event whose rows have these levels."""
        every = asked[0] if len(asked) == 1 else sorted((x for a in asked for x in a), key=lambda x: x[0])
        gone, window = 0, None
        for i, (level, queues) in enumerate(every):
            for q in queues:
                while q and q[-1] in used:
                    q.pop()
            if any(queues):
                more = [every[j][1] for j in range(i + 1, len(every)) if every[j][0] == level] if len(asked) > 1 else []
                best = min((q for qs in (queues, *more) for q in qs if q), key=lambda q: q[-1])
                window = best.pop()
                used.add(window)
                break
            gone = i + 1
        if len(asked) == 1:
            del every[:gone]
        return window

    for table in _whole_events(batches):
        area, r, kind, start, end, event, window, place, later = (table.column(c).to_pylist() for c in ("area", "run", "kind", "start", "end", "event_id", "window_id", "place", "more"))
        listed = table.column("options").to_pylist() if known is None else None
        rows, got, i, n = [], [], 0, table.num_rows
        while i < n:
            if r[i] != run or area[i] != at:
                run, at, free, levels, begun, turned = r[i], area[i], {}, {}, None, False
                used.clear()
            if kind[i] == 0:
                times, queues = free.setdefault(place[i], ([], []))
                if not times or times[-1] != start[i]:
                    times.append(start[i])
                    queues.append([])
                queues[-1].append(window[i])
                i += 1
                continue
            if not turned:
                turned = True
                for _, queues in free.values():
                    for q in queues:
                        q.reverse()
            if start[i] != begun:
                begun, levels = start[i], {}
            j, asked = i, []
            while j < n and event[j] == event[i] and start[j] == begun and r[j] == run and area[j] == at and kind[j] == 1:
                spot = levels.get((end[j], place[j]))
                if spot is None:
                    spot = levels[end[j], place[j]] = levels_of(begun, end[j], [(o["there"], o["distance_km"]) for o in listed[j]] if known is None else known[place[j]])
                if spot:
                    asked.append(spot)
                j += 1
            mine = nearest(asked) if asked else None
            if mine is not None or later[i]:
                rows.extend(range(i, j))
                got.extend([mine] * (j - i))
            i = j
        if rows:
            some = table.take(pa.array(rows, pa.int64()))
            columns = [pa.chunked_array([pa.array(got, f.type)]) if f.name == "window_id" else some.column(f.name).cast(f.type) for f in out]
            yield from pa.table(columns, schema=out).combine_chunks().to_batches()


def without_detections(windows: DataFrame, detections: DataFrame, km: float = 50.0, micros: int = 24 * HOUR) -> DataFrame:
    """Windows without a detection near in time and space.

    Places are paired once each. Of a place's detections the first and the last of each bucket of time are enough: a bucket is as wide as the time allowed, so a window looks at its own bucket, the last one before and the first one after.
    """
    d = detections.selectExpr("acquired_at AS _acquired", "latitude + 0.0D AS lat", "longitude + 0.0D AS lon").dropna()
    w = windows.selectExpr("latitude + 0.0D AS _lat", "longitude + 0.0D AS _lon").dropna().distinct()
    size = max(1, micros)
    with graph.scratch(windows.sparkSession) as keep:
        places = place_pairs(w, d.select("lat", "lon").distinct(), km).drop("distance_km")
        d = d.select("lat", "lon", F.unix_micros(F.col("_acquired").cast("timestamp")).alias("_at")).withColumn("_bucket", F.floor(F.col("_at") / size))
        if places.count() <= FEW_PLACES:
            near = d.join(F.broadcast(places), ["lat", "lon"]).groupBy("_lat", "_lon", "_bucket").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
        else:
            seen = d.groupBy("lat", "lon", "_bucket").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
            near = seen.join(places, ["lat", "lon"]).groupBy("_lat", "_lon", "_bucket").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
        near = keep(graph.written(near, "detections-near"))
    around = near.select("_lat", "_lon", F.col("_bucket").alias("_own"), "_first", "_last", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_step")).withColumn("_bucket", F.col("_own") + F.col("_step"))
    around = around.groupBy("_lat", "_lon", "_bucket").agg(
        F.max(F.when(F.col("_step") == 1, F.col("_last"))).alias("_before"), F.min(F.when(F.col("_step") == -1, F.col("_first"))).alias("_after"), F.max(F.col("_step") == 0).alias("_within"),
    )
    at = F.unix_micros(F.col("anchor_at").cast("timestamp"))
    asked = windows.withColumns({"_lat": F.col("latitude") + F.lit(0.0), "_lon": F.col("longitude") + F.lit(0.0), "_bucket": F.floor(at / size)})
    hit = F.col("_within") | (at - F.col("_before") <= micros) | (F.col("_after") - at <= micros)
    return asked.join(around, ["_lat", "_lon", "_bucket"], "left").where(~F.coalesce(hit, F.lit(False))).select(*windows.columns)


def matching_variables(windows: DataFrame) -> DataFrame:
    lon = F.col("longitude")
    return windows.withColumns({
        "season": calendar.season(F.col("anchor_at")), "region_cell": geo.region_cell(F.col("latitude"), lon), "local_hour": calendar.local_hour(F.col("anchor_at"), lon),
        "zenith_bin": F.floor(F.col("view_zenith_degrees") / 10).cast("int"), "usable_bin": (F.col("usable_fraction") * 20).cast("int"),
    })


def match_candidates(positives: DataFrame, controls: DataFrame) -> DataFrame:
    """(positive_id, control_id, season, region_cell) of windows that agree in season and cell and are near in hour, zenith and usable fraction.

    Windows of a (season, cell) meet in bins of zenith and usable fraction as wide as what they may differ by; a positive looks at the bins beside its own too.
    """
    p, c = matching_variables(positives), matching_variables(controls)
    zenith, usable = 10.0, 0.10
    bins = lambda x, width: F.rint(F.col(x) / (width * (1 + 1e-9)))
    a = p.selectExpr("window_id AS positive_id", "season", "region_cell", "local_hour AS ph", "view_zenith_degrees AS pz", "usable_fraction AS pu").withColumns({"_z": bins("pz", zenith), "_u": bins("pu", usable)})
    b = c.selectExpr("window_id AS control_id", "season", "region_cell", "local_hour AS ch", "view_zenith_degrees AS cz", "usable_fraction AS cu").withColumns({"_z": bins("cz", zenith), "_u": bins("cu", usable)})
    for x in ("_z", "_u"):
        a = a.withColumn(x, F.explode(F.array_distinct(F.array(F.col(x) - 1, F.col(x), F.col(x) + 1))))
    near = (geo.circular_hours(F.col("ph"), F.col("ch")) <= 1) & (F.abs(F.col("pz") - F.col("cz")) <= zenith) & (F.abs(F.col("pu") - F.col("cu")) <= usable)
    return a.join(b, ["season", "region_cell", "_z", "_u"]).where(near).select("positive_id", "control_id", "season", "region_cell")


def seeded_order(count: int, seed: int, skip: int = 0) -> list[int]:
    """The order that Python's generator shuffles 0..count-1 into; skip: after one shuffle of so many."""
    rng = random.Random(seed)
    if skip:
        rng.shuffle(list(range(skip)))
    order = list(range(count))
    rng.shuffle(order)
    return order


def maximum_matching(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs, as many as possible: augmenting paths inside each independent (season, cell) block, positives with the fewest options first.

    Optional columns positive_rank and control_rank give the order of equals (see seeded_order); ids do without them. Instead of pairs, candidates may be the windows of both sides, as matched_windows() has them.
    """
    ship(candidates.sparkSession)
    if "side" in candidates.columns:
        kind = candidates.schema["id"].dataType
        out = StructType([StructField("positive_id", kind), StructField("control_id", kind)])
        arrow = to_arrow_schema(out)
        return candidates.groupBy("season", "region_cell").applyInArrow(lambda table: _match_block(table, arrow), out)
    ranked = "positive_rank" in candidates.columns

    def match(table: pa.Table) -> pa.Table:
        options: dict = {}
        rank = {}
        for r in table.to_pylist():
            options.setdefault(r["positive_id"], []).append((r["control_rank"] if ranked else r["control_id"], r["control_id"]))
            rank[r["positive_id"]] = r["positive_rank"] if ranked else r["positive_id"]
        order = sorted(options, key=lambda p: (len(options[p]), rank[p]))
        ways = {p: [c for _, c in sorted(v)] for p, v in options.items()}
        taken: dict = {}
        for p in order:
            # depth first, with a stack: positives on the path, and what each has still to try
            path, tries, seen = [p], [iter(ways[p])], set()
            chosen: list = []
            while path:
                c = next((c for c in tries[-1] if c not in seen), None)
                if c is None:
                    path.pop()
                    tries.pop()
                    if chosen:
                        chosen.pop()
                    continue
                seen.add(c)
                chosen.append(c)
                if c not in taken:
                    for q, x in zip(path, chosen, strict=True):
                        taken[x] = q
                    break
                path.append(taken[c])
                tries.append(iter(ways[taken[c]]))
        pairs = sorted((p, c) for c, p in taken.items())
        f = table.schema
        return pa.table({"positive_id": pa.array([p for p, _ in pairs], f.field("positive_id").type), "control_id": pa.array([c for _, c in pairs], f.field("control_id").type)})

    kind = lambda c: candidates.schema[c].dataType.simpleString()
    return candidates.groupBy("season", "region_cell").applyInArrow(match, f"positive_id {kind('positive_id')}, control_id {kind('control_id')}")


def matched_windows(positives: DataFrame, controls: DataFrame) -> DataFrame:
    """maximum_matching() of match_candidates(), without making the pairs: a (season, cell) block's windows go to its task, where those that are alike share their options. Windows whose zenith no other side's window comes near stay out."""
    spark = positives.sparkSession
    ship(spark)
    zenith = "view_zenith_degrees"
    lowest, highest = controls.agg(F.min(zenith)).first()[0], positives.agg(F.max(zenith)).first()[0]
    positives = positives.where(F.col(zenith) >= F.lit(lowest) - 10.001)
    controls = controls.where(F.col(zenith) <= F.lit(highest) + 10.001)
    names = ["season", "region_cell", "local_hour", "view_zenith_degrees", "usable_fraction"]
    side = lambda df, n: matching_variables(df).select(*names, F.col("window_id").alias("id"), F.lit(n).alias("side")).dropna()
    rows = side(positives, 0).unionAll(side(controls, 1)).repartition(int(str(spark.conf.get("spark.sql.shuffle.partitions"))), "season", "region_cell")
    kind = lambda df: df.schema["window_id"].dataType
    return maximum_matching(rows).select(F.col("positive_id").cast(kind(positives)), F.col("control_id").cast(kind(controls)))


def _match_block(table: pa.Table, out: pa.Schema) -> pa.Table:
    """The kernel of matched_windows(): the augmenting paths of maximum_matching(). A path that fails can't succeed later, nor can one through a control that it met: such controls are dead."""
    one = table.column("side").to_numpy()
    h, z, u = (table.column(c).to_numpy() for c in ("local_hour", "view_zenith_degrees", "usable_fraction"))
    ids = table.column("id").to_pylist()
    kinds, of = np.unique(np.stack((h.astype(float), z, u), axis=1), axis=0, return_inverse=True)
    of = of.reshape(-1)
    mine, theirs = np.flatnonzero(one == 0), np.flatnonzero(one == 1)
    groups: dict = {}
    for i, k in zip(theirs.tolist(), of[theirs].tolist(), strict=True):
        groups.setdefault(k, []).append(ids[i])
    other = np.array(sorted(groups), dtype=np.int64)
    a, sizes = kinds[other], np.array([len(groups[k]) for k in other.tolist()], dtype=np.int64)
    near: dict = {}
    for k in np.unique(of[mine]).tolist():
        hours = np.abs(kinds[k, 0] - a[:, 0])
        near[k] = np.flatnonzero((np.minimum(hours, 24 - hours) <= 1) & (np.abs(kinds[k, 1] - a[:, 1]) <= 10.0) & (np.abs(kinds[k, 2] - a[:, 2]) <= 0.10))
    # controls that anyone could have are bits in the order of ids; what the rows of a positive are like says its options
    met = [groups[other[j]] for j in sorted(set().union(*(n.tolist() for n in near.values())))]
    control = sorted(set().union(*met))
    place = {x: i for i, x in enumerate(control)}
    bits = {id(g): sum(1 << i for i in {place[x] for x in g}) for g in met}
    options = {k: (reduce(or_, (bits[id(groups[other[j]])] for j in n.tolist()), 0), int(sizes[n].sum())) for k, n in near.items()}
    way: dict = {}
    count: Counter = Counter()
    for i, k in zip(mine.tolist(), of[mine].tolist(), strict=True):
        way[ids[i]] = way.get(ids[i], 0) | options[k][0]
        count[ids[i]] += options[k][1]
    owner: list = [None] * (len(control) + 1)
    alive = (1 << len(control)) - 1
    for p in sorted((x for x in way if way[x]), key=lambda x: (count[x], x)):
        path, masks, chosen, unseen, mask = [p], [], [], alive, way[p]
        while True:
            left = mask & unseen
            if left:
                bit = left & -left
                unseen ^= bit
                c = bit.bit_length()
                chosen.append(c)
                q = owner[c]
                if q is None:
                    for q, x in zip(path, chosen, strict=True):
                        owner[x] = q
                    break
                path.append(q)
                masks.append(mask)
                mask = way[q]
            elif masks:
                path.pop()
                chosen.pop()
                mask = masks.pop()
            else:
                alive = unseen
                break
    pairs = sorted((p, control[c - 1]) for c, p in enumerate(owner) if p is not None)
    return pa.table({"positive_id": pa.array([p for p, _ in pairs], out[0].type), "control_id": pa.array([c for _, c in pairs], out[1].type)})


#: Gaps of time after which a cell's points are dealt to another task.
PERIODS = 256


def proximity_edges(points: DataFrame, key: str, at: str, km: float, micros: int) -> DataFrame:
    """Edges (a, b) between points near in time and space, enough of them to link all that are near: not every pair.

    A cell whose diameter is below the distance is split, in each PERIODS gaps of time, into runs whose steps in time stay within the gap; a run's points are linked
    to its least one. Runs that follow each other in a cell, or are of different cells, are linked by their least points if any two of their points are near.
    """
    fine = [F.floor((x + 1.0) * (2.0 / geo.chord(km))) for x in geo.unit_vector(F.col("lat"), F.col("lon"))]
    size = max(1, micros)
    cells = ["_f0", "_f1", "_f2"]
    p = points.select(F.col(key).alias("k"), F.col(at).alias("t"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).withColumns(dict(zip(cells, fine, strict=True)))
    cells = [*cells, "_p"]
    p = p.withColumn("_p", F.floor(F.unix_micros("t") / (PERIODS * size)))
    w = Window.partitionBy(*cells).orderBy("t", "k")
    # the fine cell's diagonal is under the distance only up to sqrt(3)/2 of its chord, so neighbours in time are always near enough
    gap = F.unix_micros("t") - F.unix_micros(F.lag("t").over(w))
    p = p.withColumn("gap", gap).withColumn("run", F.sum(F.when(F.col("gap") <= micros, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")
    p = p.withColumn("head", F.min("k").over(Window.partitionBy(*cells, "run")))
    inside = p.where("k <> head").selectExpr("k AS a", "head AS b")
    left = p.withColumn("_t", F.floor(F.unix_micros("t") / size))
    names = ("_x", "_y", "_z")
    reach = near_cells(left, F.col("lat"), F.col("lon"), km, names, True).withColumn("_b", F.explode(F.array(F.col("_t") - 1, F.col("_t"))))
    other = near_cells(left, F.col("lat"), F.col("lon"), km, ("_rx", "_ry", "_rz"), False).selectExpr("t AS t2", "lat AS lat2", "lon AS lon2", "head AS head2", "_rx", "_ry", "_rz", "_t AS _t2")
    near = (calendar.seconds_between(F.col("t"), F.col("t2")) <= micros) & (geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= km)
    met = reach.join(other, (F.col("_x") == F.col("_rx")) & (F.col("_y") == F.col("_ry")) & (F.col("_z") == F.col("_rz")) & (F.col("_b") == F.col("_t2")) & (F.col("head") != F.col("head2")) & near)
    return inside.unionAll(met.selectExpr("greatest(head, head2) AS a", "least(head, head2) AS b").distinct())


def single_linkage(points: DataFrame, key: str = "detection_id", at: str = "acquired_at", km: float = 10.0, micros: int = HOUR) -> DataFrame:
    """(key, cluster): clusters of points linked by steps within the distance and the gap; cluster is the least key of it."""
    found = graph.components(proximity_edges(points, key, at, km, micros), "linkage")
    return points.select(F.col(key)).join(found, F.col(key) == F.col("node"), "left").select(key, F.coalesce("root", key).alias("cluster"))


def events_of(points: DataFrame, by: str = "cluster") -> DataFrame:
    """Events: start, end, centroid (the longitude's mean is circular), size, and a digest of the detections in order."""
    text = F.concat_ws("|", F.unix_micros("acquired_at"), F.format_string("%.6f", "latitude"), F.format_string("%.6f", "longitude"), "confidence", F.format_string("%.3f", "brightness_kelvin"), "instrument")
    e = points.groupBy(by).agg(
        F.min("acquired_at").alias("start_time"), F.max("acquired_at").alias("end_time"), F.avg("latitude").alias("latitude"), geo.circular_mean_degrees(F.col("longitude")).alias("longitude"),
        F.count("*").alias("detections"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("digest"),
    )
    return e.withColumn("event_id", F.concat(F.lit("event-"), F.date_format("start_time", "yyyyMMdd'T'HHmm'Z'"), F.lit("-"), F.substring("digest", 1, 12)))


def band_pairs(observations: DataFrame, keys: list[str], companion: str = "C14") -> DataFrame:
    """C07 observations with their companion band of the same keys (null: none)."""
    a = observations.where("channel = 'C07'")
    b = observations.where(F.col("channel") == companion).select(*keys, F.col("source_id").alias("companion_source_id"))
    return a.join(b, keys, "left")


def active(points: DataFrame, by: list[str], key: str, at: str, seconds: int) -> DataFrame:
    """key and active: how many points of its group are at most so old when a point comes, itself and its equals included.

    A group is dealt by periods of that length: counts of each second in the period before are carried over, so no task holds more than two periods of a group.
    """
    second = F.unix_seconds(at)
    p = points.select(*by, key, second.alias("_s")).withColumn("_p", F.floor(F.col("_s") / (seconds + 1)))
    counts = p.groupBy(*by, "_p", "_s").agg(F.count("*").alias("_n"))
    both = counts.withColumn("_own", F.lit(True)).unionByName(counts.withColumn("_p", F.col("_p") + 1).withColumn("_own", F.lit(False)))
    window = Window.partitionBy(*by, "_p").orderBy("_s").rangeBetween(-seconds, 0)
    found = both.withColumn("active", F.sum("_n").over(window)).where("_own").select(*by, "_p", "_s", "active")
    return p.join(found, [*by, "_p", "_s"]).select(key, "active")


def resolved(observations: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Observations with their source; `error` says unresolved, or that time or channel disagree."""
    s = sources.select(F.col(key).alias("_k"), F.col("channel").alias("_channel"), F.col("scan_start").alias("_scan"))
    joined = observations.join(s, F.col(key) == F.col("_k"), "left")
    error = F.when(F.col("_k").isNull(), "unresolved source").when(F.col("channel") != F.col("_channel"), "channel").when(F.col("observed_at") != F.col("_scan"), "time")
    return joined.withColumn("error", error).drop("_k", "_channel", "_scan")



def inherited(controls: DataFrame, positives: DataFrame) -> DataFrame:
    """Controls with the event of the positive they are matched to; `error` where there is none."""
    p = positives.select(F.col("case_id").alias("_p"), F.col("event_id"))
    j = controls.join(p, F.col("matched_case_id") == F.col("_p"), "left")
    return j.withColumn("error", F.when(F.col("_p").isNull(), "no positive")).drop("_p")


def membership(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys that aren't in both, or not once in each: key, in_first, in_second; empty if the memberships are equal."""
    a = first.groupBy(key).agg(F.count("*").alias("in_first"))
    b = second.groupBy(key).agg(F.count("*").alias("in_second"))
    both = a.join(b, key, "full").select(key, F.coalesce("in_first", F.lit(0)).alias("in_first"), F.coalesce("in_second", F.lit(0)).alias("in_second"))
    return both.where((F.col("in_first") != 1) | (F.col("in_second") != 1))
