"""Point detections: strict CSV scan, normalisation, deduplication, audit."""

from __future__ import annotations

import hashlib
import io
import itertools
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thermal_lake.shipping import ship

#: The columns of the format (one of the last two), and the aliases of a confidence.
REQUIRED = ("latitude", "longitude", "acq_date", "acq_time", "confidence", "instrument")
BRIGHTNESS = ("brightness", "bright_ti4")
CONFIDENCE = {"l": "low", "low": "low", "n": "nominal", "nominal": "nominal", "h": "high", "high": "high"}
INSTRUMENT = r"^[A-Za-z0-9][A-Za-z0-9 ._-]*\z"
#: Lines that a header may take (it may be quoted), at most.
HEADER_LINES = 50
KEY = ("acquired_at", "latitude", "longitude", "confidence", "brightness_kelvin", "instrument")


def normalized_header(columns: list[str], source: str = "") -> dict[str, str]:
    """Column names, trimmed and in lower case, to what they are called in the file; an empty, repeated or missing one raises."""
    names: dict[str, str] = {}
    for c in columns:
        name = c.strip().lower()
        if not name:
            raise ValueError(f"{source}: a column has no name")
        if name in names:
            raise ValueError(f"{source}: column {name} is repeated")
        names[name] = c
    if missing := [c for c in REQUIRED if c not in names]:
        raise ValueError(f"{source}: columns are missing: {', '.join(missing)}")
    if not any(c in names for c in BRIGHTNESS):
        raise ValueError(f"{source}: one of {' or '.join(BRIGHTNESS)} is needed")
    return names


RAW_SCHEMA = ", ".join(f"{c} string" for c in (*REQUIRED, *BRIGHTNESS)) + ", source_file string, source_sha256 string, row_number long, is_blank boolean"


def read_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All rows of CSV files as trimmed text (empty: null) with source_file, its SHA-256, row_number (the header is row 1; lines without anything aren't rows) and is_blank.

    Quoted fields may hold commas and line breaks; extra columns are left out. A header that normalized_header() refuses, and a path given twice, raise. A file is read by one task and has to fit a binary row (2 GB).
    """
    if not paths:
        raise ValueError("a path is needed")
    seen: set[str] = set()
    for path in paths:
        qualified = spark._jvm.org.apache.hadoop.fs.Path(path)
        real = qualified.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(qualified).toString()
        if real in seen:
            raise ValueError(f"{path} was given twice")
        seen.add(real)
        lines = [r[0] for r in spark.read.text(path).take(HEADER_LINES)]
        normalized_header(next(_rows("\n".join(lines).removeprefix("\ufeff")), []), path)
    ship(spark)
    out = to_arrow_schema(StructType.fromDDL(RAW_SCHEMA))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = unquote(path)
                digest = hashlib.sha256(content).hexdigest()
                rows = _rows(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", newline=""))
                names = {n: i for i, n in enumerate(c.strip().lower() for c in next(rows))}
                numbered = enumerate(rows, 2)
                while part := list(itertools.islice(numbered, 10_000)):
                    cell = lambda row, c, names=names: (row[names[c]].strip() or None) if c in names and names[c] < len(row) else None
                    found = [{c: cell(row, c) for c in (*REQUIRED, *BRIGHTNESS)} | {"source_file": source, "source_sha256": digest, "row_number": n, "is_blank": not any(x.strip() for x in row[: len(names)])} for n, row in part]
                    yield pa.RecordBatch.from_pylist(found, schema=out)

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(parse, RAW_SCHEMA)


def source_audit(raw: DataFrame) -> DataFrame:
    """(source_file, source_sha256, row_count) of the files that were read; blank rows don't count."""
    return raw.groupBy("source_file", "source_sha256").agg(F.count_if(~F.col("is_blank")).alias("row_count"))


def _rows(lines) -> Iterator[list[str]]:
    """Rows of a CSV text or stream, without empty lines."""
    import csv

    return (r for r in csv.reader(io.StringIO(lines, newline="") if isinstance(lines, str) else lines) if r)


def _decimal(c: Column) -> Column:
    return c.try_cast("decimal(38,18)")


def _rounded(c: Column, digits: int) -> Column:
    """Half up, as a double without a negative zero."""
    return F.round(c, digits).cast("double") + F.lit(0.0)


def normalized(raw: DataFrame, keep: tuple[str, ...] = (), longitudes: tuple[float, float] | None = (-180, 180)) -> DataFrame:
    """Rows of text to detections; `error` names what is wrong with a row (null: nothing), and then its values may be null. source_file and row_number stay if raw has them. longitudes: their range (None: any number)."""
    keep = (*keep, *(c for c in PLACE if c in raw.columns and c not in keep))
    date = F.when(F.col("acq_date").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp("acq_date", F.lit("yyyy-M-d")))
    digits = F.col("acq_time").rlike(r"^[0-9]{1,4}$")
    padded = F.lpad("acq_time", 4, "0")
    hour, minute = F.when(digits, F.substring(padded, 1, 2).cast("int")), F.when(digits, F.substring(padded, 3, 2).cast("int"))
    lat, lon = _decimal(F.col("latitude")), _decimal(F.col("longitude"))
    bright = _decimal(F.coalesce(F.col("brightness"), F.col("bright_ti4")) if "bright_ti4" in raw.columns else F.col("brightness"))
    aliases = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    number = _decimal(F.col("confidence"))
    plain = F.regexp_replace(F.regexp_replace(F.round(number, 3).cast("decimal(12,3)").cast("string"), "0+$", ""), r"\.$", "")
    alias = F.try_element_at(aliases, F.lower("confidence"))
    checks = [
        (date.isNull(), "acq_date"), (hour.isNull() | (hour > 23) | (minute > 59), "acq_time"), (lat.isNull() | ~lat.between(-90, 90), "latitude"), (lon.isNull() | ~lon.between(*(longitudes or (-180, 180))), "longitude"),
        (bright.isNull() | (bright <= 0) | (bright > 2000), "brightness"), (F.col("confidence").isNull() | (alias.isNull() & (number.isNull() | ~number.between(0, 100))), "confidence"),
        (~F.coalesce(F.col("instrument").rlike(INSTRUMENT), F.lit(False)), "instrument"),
    ]
    if longitudes is None:
        checks = [(lon.isNull() if name == "longitude" else bad, name) for bad, name in checks]
    error = F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in checks])
    when = F.timestamp_micros(F.unix_micros(date) + (hour * 60 + minute).cast("long") * 60_000_000)
    return raw.select(
        *keep, when.alias("acquired_at"), _rounded(lat, 6).alias("latitude"), _rounded(lon, 6).alias("longitude"), F.coalesce(alias, F.when(number.isNotNull(), plain)).alias("confidence"),
        _rounded(bright, 3).alias("brightness_kelvin"), F.upper("instrument").alias("instrument"), error.alias("error"),
    )


PLACE = ("source_file", "row_number")


def strict(detections: DataFrame) -> DataFrame:
    """Detections; the first bad row that a task meets raises, naming its file and row if they are known."""
    place = [x for c in PLACE if c in detections.columns for x in (F.col(c).cast("string"), F.lit(":"))]
    return detections.withColumn("acquired_at", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad detection: "), *place, F.col("error"))).cast("timestamp")).otherwise(F.col("acquired_at"))).drop("error")


def distinct(detections: DataFrame) -> DataFrame:
    """Exact duplicates removed, over the six values of a detection."""
    return detections.select(*KEY).distinct()


def audit(raw: DataFrame, detections: DataFrame) -> DataFrame:
    """One row of counts: rows, blanks, unique detections, duplicates, time range, and maps of instruments and confidences in order."""
    rows = raw.agg(F.count("*").alias("source_rows"), F.count_if(F.col("is_blank") if "is_blank" in raw.columns else F.lit(False)).alias("blank_rows"))
    unique = distinct(detections)
    counter = lambda c: unique.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(c), F.col("n"))))).alias(f"{c}s"))
    span = unique.agg(F.count("*").alias("unique_detections"), F.min("acquired_at").alias("first_at"), F.max("acquired_at").alias("last_at"))
    return rows.crossJoin(span).crossJoin(counter("instrument")).crossJoin(counter("confidence")).withColumn("duplicates", F.col("source_rows") - F.col("blank_rows") - F.col("unique_detections"))
