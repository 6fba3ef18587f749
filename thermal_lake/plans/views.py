"""What a reviewer sees, as wide rows: catalog, components, measurements, changes, budget, outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermal_lake.operators import decide


def label(c: Column) -> Column:
    """A code as words."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def number(c: Column, digits: int = 4) -> Column:
    """Up to so many significant digits; a dash for null."""
    return F.when(c.isNull(), "-").otherwise(F.regexp_replace(F.format_string(f"%.{digits}g", c), r"(\.\d*?)0+$", "$1"))


def place(lat: Column, lon: Column) -> Column:
    return F.concat(F.format_string("%.4f", F.abs(lat)), F.when(lat < 0, "S").otherwise("N"), F.lit(", "), F.format_string("%.4f", F.abs(lon)), F.when(lon < 0, "W").otherwise("E"))


def components(found: DataFrame) -> DataFrame:
    box = F.format_string("%d, %d, %d x %d", "box_x", "box_y", "box_width", "box_height")
    return found.select("frame_id", "label", "area", box.alias("box"), number(F.col("mean_contrast")).alias("contrast"), number(F.col("mean_difference")).alias("difference"), "touches_edge")


def measurements(df: DataFrame, columns: dict[str, str], key: str = "frame_id") -> DataFrame:
    """Columns as rows: key, name, value, unit, and why a value is missing."""
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit")) for c, u in columns.items()])
    long = df.select(key, F.explode(rows).alias("m")).select(key, "m.*")
    return long.withColumn("missing_reason", F.when(F.col("value").isNull(), "not measured"))


def budget(df: DataFrame, key: str = "case_id") -> DataFrame:
    """One row for each resource: used, limit, share."""
    rows = F.array(*[F.struct(F.lit(r).alias("resource"), F.col(f"used_{r}").cast("double").alias("used"), F.col(f"max_{r}").cast("double").alias("limit")) for r in ("observations", "bytes", "elapsed_seconds", "retries")])
    long = df.select(key, F.explode(rows).alias("b")).select(key, "b.*")
    return long.withColumn("share", F.round(F.try_divide("used", "limit"), 4))


def changes(snapshots: DataFrame, key: str = "case_id", order: str = "step") -> DataFrame:
    """What changed in a case's evidence from each step to the next."""
    fields = ["component_count", "persistence_count", "persistence_confidence", "reason_codes", "evidence_ids"]
    now = F.struct(*fields)
    before = F.lag(now).over(Window.partitionBy(key).orderBy(order))
    return snapshots.select(key, order, now.alias("now"), before.alias("before")).select(key, order, F.explode(decide.changes(F.col("before"), F.col("now"))).alias("c")).select(key, order, "c.*")


def cases(packets: DataFrame, outcomes: DataFrame, traces: DataFrame) -> DataFrame:
    """One row for each case that has a packet or a trace, by title: outcome, explanation, number of observations, the trace's last state (`no trace` without one)."""
    t = traces.select("case_id", F.col("to_state").alias("last_state"), F.col("sequence").alias("transitions"))
    o = outcomes.select("case_id", label(F.col("outcome")).alias("outcome"), "explanation", F.col("outcome_confidence").alias("confidence"))
    p = packets.select("case_id", F.size("observations").alias("observations"))
    c = p.join(o, "case_id", "left").join(t, "case_id", "full")
    return c.withColumns({"last_state": F.coalesce("last_state", F.lit("no trace")), "title": F.concat(F.lit("Case "), F.col("case_id").cast("string"))}).orderBy(F.lower("title"), "case_id")


def latest_error(transitions: DataFrame) -> DataFrame:
    """The last refused action of each case and what may be done about it."""
    return transitions.where("error IS NOT NULL").groupBy("case_id").agg(F.max_by("error", "sequence").alias("error")).withColumn("recovery", decide.recovery(F.col("error")))


def outline(contours: DataFrame, height: int, width: int, out_height: int = 112, out_width: int = 160) -> DataFrame:
    """Cells of a small preview that a contour's lines cross: frame_id, y, x."""
    scale = min(out_height / height, out_width / width)
    fit = F.transform("points", lambda p: F.struct(F.floor(p["x"] * scale).cast("int").alias("x"), F.floor(p["y"] * scale).cast("int").alias("y")))
    c = contours.select("frame_id", fit.alias("p"))
    lines = F.zip_with("p", F.concat(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    s = c.select("frame_id", F.explode(lines).alias("l"))
    n = F.greatest(F.abs(F.col("l.b.x") - F.col("l.a.x")), F.abs(F.col("l.b.y") - F.col("l.a.y")), F.lit(1))
    step = lambda axis: F.round(F.col(f"l.a.{axis}") + (F.col(f"l.b.{axis}") - F.col(f"l.a.{axis}")) * F.col("i") / n).cast("int")
    return s.withColumn("i", F.explode(F.sequence(F.lit(0), n))).select("frame_id", step("y").alias("y"), step("x").alias("x")).distinct()
