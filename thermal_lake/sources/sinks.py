"""Sinks: content-addressed packets with a completion row, refusal of silent changes, and reports in pairs."""

from __future__ import annotations

import hashlib
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermal_lake.operators.records import canonical


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free digest of their content: sums of two hashes of each row."""
    c = sorted(df.columns)
    row = F.to_json(F.struct(*c))
    n, a, b = df.select(F.xxhash64(row).cast("decimal(38,0)").alias("a"), F.hash(row).cast("decimal(38,0)").alias("b")).agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return n, hashlib.sha256(f"{c}|{n}|{a}|{b}".encode()).hexdigest()


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """Writes df unless the table is there: the same content is left alone, other content raises (or is replaced, if overwrite)."""
    spark = df.sparkSession
    if exists(spark, path):
        if fingerprint(spark.read.parquet(path)) == fingerprint(df):
            return "unchanged"
        if not overwrite:
            raise FileExistsError(f"{path} holds something else")
    df.write.mode("overwrite").parquet(path)
    return "written"


class Packets:
    """Evidence packets under root/case_id=/content_hash=, each complete once its row is in the ledger."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, packets: DataFrame) -> DataFrame:
        """Writes the packets (case_id, content_hash, payload) that aren't complete yet, then their ledger rows (idempotent: a crash between the two leaves rows that the next run rewrites)."""
        body = packets.withColumn("payload_sha256", F.sha2("payload", 256))
        done = self.ledger()
        fresh = body.join(done.select("case_id", "content_hash"), ["case_id", "content_hash"], "left_anti")
        staged = f"{self.root}/.stage-{uuid.uuid4().hex}"
        fresh.write.parquet(staged)
        ready = self.spark.read.schema(fresh.schema).parquet(staged)
        ready.write.mode("append").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(f"{self.root}/packets")
        ready.select("case_id", "content_hash", "payload_sha256", F.length("payload").cast("long").alias("size")).write.mode("append").parquet(f"{self.root}/ledger")
        fs, p = _fs(self.spark, staged)
        fs.delete(p, True)
        return self.ledger()

    def ledger(self) -> DataFrame:
        shape = "case_id string, content_hash string, payload_sha256 string, size long"
        if not exists(self.spark, f"{self.root}/ledger"):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(f"{self.root}/ledger")

    def packets(self) -> DataFrame:
        """Complete packets only."""
        found = self.spark.read.schema("content_hash string, payload string, payload_sha256 string, case_id string").parquet(f"{self.root}/packets")
        return found.dropDuplicates(["case_id", "content_hash"]).join(self.ledger().select("case_id", "content_hash"), ["case_id", "content_hash"], "left_semi")

    def corrupt(self) -> DataFrame:
        """Ledger rows whose packet is gone or hashes to something else."""
        found = self.packets().select("case_id", "content_hash", F.sha2("payload", 256).alias("now"))
        return self.ledger().join(found, ["case_id", "content_hash"], "left").where(~F.col("now").eqNullSafe(F.col("payload_sha256")))


def write_text(path: str | Path, data: str, overwrite: bool = False) -> str:
    """A small report: the same bytes are left alone, others raise unless overwrite; published by a rename."""
    path, raw = Path(path), data.encode()
    if path.exists():
        if path.read_bytes() == raw:
            return "unchanged"
        if not overwrite:
            raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    part.write_bytes(raw)
    part.replace(path)
    return "written"


def write_pair(folder: str | Path, first_name: str, first: dict, second_name: str, second: dict, overwrite: bool = False) -> tuple[str, str]:
    """Two canonical JSON files, the second with the first's hash; neither is written if either would be refused."""
    body = canonical(first, newline=True)
    audit = canonical(second | {f"{Path(first_name).stem}_sha256": hashlib.sha256(body.encode()).hexdigest()}, newline=True)
    for name, data in ((first_name, body), (second_name, audit)):
        p = Path(folder) / name
        if p.exists() and p.read_bytes() != data.encode() and not overwrite:
            raise FileExistsError(p)
    return write_text(Path(folder) / first_name, body, overwrite), write_text(Path(folder) / second_name, audit, overwrite)


def pinned(root: str | Path, names: list[str]) -> str:
    """One hash of the files named, by name and content."""
    h = hashlib.sha256()
    for n in sorted(names):
        h.update(n.encode() + b"\0" + hashlib.sha256((Path(root) / n).read_bytes()).digest())
    return h.hexdigest()


def discovered(spark: SparkSession, root: str, name: str = "evidence.json") -> tuple[DataFrame, DataFrame]:
    """Packets found under a folder (path, case_id, raw), one for each case, and what was skipped and why."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    t = files.select("path", F.decode("content", "UTF-8").alias("raw")).withColumn("case_id", F.when(F.try_parse_json("raw").isNotNull(), F.get_json_object("raw", "$.case_id")))
    good = t.where("case_id IS NOT NULL")
    first = good.groupBy("case_id").agg(F.min("path").alias("path"))
    kept = good.join(first, ["case_id", "path"], "left_semi")
    skipped = t.where("case_id IS NULL").select("path", F.lit("unreadable").alias("why")).unionByName(good.join(first, ["case_id", "path"], "left_anti").select("path", F.lit("repeated case").alias("why")))
    return kept, skipped
