"""Object catalogs: keys with embedded scan times, paged listings, snapshots, requests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermal_lake.functions import calendar

#: Fixed values of the product: its name in keys, and the pattern of a key.
PRODUCT, SATELLITE = "ABI-L2-CMIPF", "G18"
KEY = rf"^{PRODUCT}/(\d{{4}})/(\d{{3}})/(\d{{2}})/OR_{PRODUCT}-M\d(C\d{{2}})_{SATELLITE}_s(\d{{14}})_e(\d{{14}})_c\d{{14}}\.nc\z"
CHANNELS = ("C07", "C14")


def object_key(start: Column, channel: Column, scan_seconds: int = 570, made_seconds: int = 600) -> Column:
    """The key of a scan that starts then; tenths of a second are 0."""
    stamp = lambda t: F.concat(F.date_format(t, "yyyyDDDHHmmss"), F.lit("0"))
    later = lambda s: start + F.expr(f"interval {s} seconds")
    return F.concat(F.lit(f"{PRODUCT}/"), F.date_format(start, "yyyy/DDD/HH"), F.lit(f"/OR_{PRODUCT}-M6"), channel, F.lit(f"_{SATELLITE}_s"), stamp(start), F.lit("_e"), stamp(later(scan_seconds)), F.lit("_c"), stamp(later(made_seconds)), F.lit(".nc"))


def parsed(objects: DataFrame, key: str = "object_key") -> DataFrame:
    """objects with channel, scan_start, scan_end and error (null: a proper key of a supported channel)."""
    # inline() of one struct computes a step once: filters above (a join's null checks) don't copy the patterns into themselves
    once = lambda df, columns: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    parts = {f"_p{i}": F.regexp_extract(key, KEY, i) for i in range(1, 7)}
    found = once(once(objects, parts), {"_start": calendar.day_of_year_stamp(F.col("_p5")), "_end": calendar.day_of_year_stamp(F.col("_p6"))})
    agrees = F.concat_ws("/", "_p1", "_p2", "_p3") == F.date_format("_start", "yyyy/DDD/HH")
    error = (
        F.when(~F.coalesce(F.col("_p4") != "", F.lit(False)), "not a key of the product").when(~F.col("_p4").isin(*CHANNELS), "unsupported channel").when(F.col("_start").isNull() | F.col("_end").isNull(), "not a time")
        .when(F.col("_end") < F.col("_start"), "ends before it starts").when(~agrees, "path and scan disagree")
    )
    found, good = found.withColumn("error", error), F.col("error").isNull()
    return found.withColumns({"channel": F.when(good, F.col("_p4")), "scan_start": F.when(good, F.col("_start")), "scan_end": F.when(good, F.col("_end"))}).drop(*parts, "_start", "_end")


def reference_error(c: DataFrame, bucket: str) -> DataFrame:
    """parsed objects with reference_error: bucket, size, channel, and that an object isn't found before its scan ends."""
    return c.withColumn("reference_error", F.coalesce("error", F.when(F.col("bucket") != bucket, "bucket").when(F.col("size_bytes") <= 0, "size").when(F.col("discovered_at") < F.col("scan_end"), "discovered before the scan ended")))


def listing(fetch: Callable[[str | None], str], spark: SparkSession) -> DataFrame:
    """All pages of an XML listing (object_key, size_bytes), keys once and in order. fetch(token) gives a page; a token that comes twice raises."""
    import xml.etree.ElementTree as ET

    rows, token, seen = {}, None, set()
    while True:
        root = ET.fromstring(fetch(token))  # noqa: S314
        name = lambda e: e.tag.rpartition("}")[2]
        for e in root:
            if name(e) == "Contents":
                fields = {name(x): x.text for x in e}
                rows[fields["Key"]] = int(fields["Size"])
        top = {name(e): e.text for e in root}
        if top.get("IsTruncated", "false").lower() != "true":
            break
        token = top.get("NextContinuationToken")
        if not token or token in seen:
            raise ValueError("a truncated page without a new token")
        seen.add(token)
    return spark.createDataFrame(sorted(rows.items()), "object_key string, size_bytes long")


class Snapshots:
    """Catalog snapshots by bucket and prefix, as Parquet under hashed names; a snapshot of another bucket or prefix, or with other columns, raises."""

    COLUMNS = ("bucket", "prefix", "discovered_at", "object_key", "size_bytes")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, bucket: str, prefix: str) -> str:
        return f"{self.root}/{hashlib.sha256(f'{bucket}\0{prefix}'.encode()).hexdigest()}.parquet"

    def exists(self, bucket: str, prefix: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(bucket, prefix))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def store(self, objects: DataFrame, bucket: str, prefix: str, discovered_at) -> None:
        objects.select(F.lit(bucket).alias("bucket"), F.lit(prefix).alias("prefix"), F.lit(discovered_at).cast("timestamp").alias("discovered_at"), "object_key", "size_bytes").write.mode("overwrite").parquet(self.path(bucket, prefix))

    def load(self, bucket: str, prefix: str) -> DataFrame | None:
        if not self.exists(bucket, prefix):
            return None
        found = self.spark.read.parquet(self.path(bucket, prefix))
        if tuple(found.columns) != self.COLUMNS:
            raise ValueError("a snapshot with other columns")
        if found.where((F.col("bucket") != bucket) | (F.col("prefix") != prefix) | ~F.startswith("object_key", F.lit(prefix))).limit(1).count():
            raise ValueError("a snapshot of another prefix")
        return found


def source_requests(cases: DataFrame, base_url: str) -> DataFrame:
    """One row for each source of each case: case_id, source_id, url (each part of the key percent-encoded), size_bytes, sha256."""
    s = cases.select("case_id", F.explode("sources").alias("s"))
    encoded = F.array_join(F.transform(F.split("s.object_key", "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")
    return s.select("case_id", F.col("s.source_id").alias("source_id"), F.concat(F.lit(base_url.rstrip("/") + "/"), encoded).alias("url"), F.col("s.size_bytes").alias("size_bytes"), F.col("s.sha256").alias("sha256"))
