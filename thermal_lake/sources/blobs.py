"""Content-addressed blobs: verified fetch with retries, lookup, inspection, and collection of what nothing refers to."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BlobError(Exception):
    """A blob that isn't what it should be."""


class BlobCache:
    """A folder of blobs by SHA-256, and of the cases that refer to them. It is a driver-side utility for thousands of files; tables about it are DataFrames."""

    def __init__(self, root: str | Path, opener: Callable[[str], Iterable[bytes]], attempts: int = 3, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep):
        self.root, self.opener, self.attempts, self.backoff, self.sleep = Path(root), opener, attempts, backoff, sleep
        (self.root / "objects").mkdir(parents=True, exist_ok=True)
        (self.root / "cases").mkdir(exist_ok=True)

    def path(self, sha256: str) -> Path:
        return self.root / "objects" / sha256[:2] / sha256

    def verify(self, sha256: str, size: int) -> Path:
        """The path of a blob; one that is missing, or of another size or content, raises."""
        path = self.path(sha256)
        if not path.exists():
            raise FileNotFoundError(path)
        if path.stat().st_size != size or hashlib.sha256(path.read_bytes()).hexdigest() != sha256:
            raise BlobError(f"{path} isn't what its name says")
        return path

    def fetch(self, case_id: str, url: str, sha256: str, size: int) -> dict:
        """A receipt; the blob is transferred if it isn't there, verified, and published by a rename."""
        began, reused, attempt = time.monotonic(), True, 0
        try:
            path = self.verify(sha256, size)
        except (FileNotFoundError, BlobError):
            reused = False
            for attempt in range(1, self.attempts + 1):
                try:
                    path = self._transfer(url, sha256, size)
                    break
                except (OSError, BlobError):
                    if attempt == self.attempts:
                        raise
                    self.sleep(self.backoff * 2 ** (attempt - 1))
        refs = self.root / "cases" / f"{case_id}.json"
        known = set(json.loads(refs.read_text())) if refs.exists() else set()
        self._publish(refs, json.dumps(sorted(known | {sha256})).encode())
        return {"case_id": case_id, "url": url, "sha256": sha256, "size_bytes": size, "reused": reused, "attempts": attempt, "path": str(path), "seconds": time.monotonic() - began}

    def _transfer(self, url: str, sha256: str, size: int) -> Path:
        data = b"".join(self.opener(url))
        if len(data) != size:
            raise BlobError(f"{url}: {len(data)} bytes instead of {size}")
        if hashlib.sha256(data).hexdigest() != sha256:
            raise BlobError(f"{url}: another SHA-256")
        return self._publish(self.path(sha256), data)

    @staticmethod
    def _publish(path: Path, data: bytes) -> Path:
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.{os.getpid()}.part")
        part.write_bytes(data)
        part.replace(path)
        return path

    def references(self) -> list[tuple[str, str]]:
        return [(p.stem, sha) for p in sorted((self.root / "cases").glob("*.json")) for sha in json.loads(p.read_text())]

    def clean(self, case_id: str) -> list[str]:
        """Forgets a case and removes the blobs that no other case refers to, by digest."""
        (self.root / "cases" / f"{case_id}.json").unlink(missing_ok=True)
        used = {sha for _, sha in self.references()}
        gone = [p for p in sorted((self.root / "objects").glob("*/*")) if not p.name.startswith(".") and p.name not in used]
        for p in gone:
            p.unlink()
        return [p.name for p in gone]

    def receipts(self, spark: SparkSession, requests: list[dict]) -> DataFrame:
        """All requests fetched, as a table."""
        rows = [self.fetch(**r) for r in requests]
        return spark.createDataFrame(rows, "attempts long, case_id string, path string, reused boolean, seconds double, sha256 string, size_bytes long, url string")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, sha256 and size of the blobs under a folder, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def inspection(spark: SparkSession, root: str) -> DataFrame:
    """Number and bytes of blobs, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.agg(F.count("*").alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def unverified(requests: DataFrame, blobs: DataFrame) -> DataFrame:
    """Requests (source_id, sha256, size_bytes) that no blob satisfies, with why."""
    b = blobs.select(F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size")).distinct()
    j = requests.join(b, F.col("sha256") == F.col("_sha"), "left")
    return j.withColumn("error", F.when(F.col("_sha").isNull(), "missing").when(F.col("_size") != F.col("size_bytes"), "size")).where("error IS NOT NULL").drop("_sha", "_size")


def unreferenced(blobs: DataFrame, references: DataFrame) -> DataFrame:
    """Blobs that no case refers to, by digest (so a digest that two sources share stays)."""
    return blobs.join(references.select("sha256").distinct(), "sha256", "left_anti")
