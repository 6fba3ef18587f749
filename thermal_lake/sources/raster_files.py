"""Raster files as a data source: .npz crops everywhere, NetCDF where a reader is installed; both give pixel rows."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIXELS = "frame_id string, row int, col int, raw int, dqf int, x double, y double"


def _npz(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    z = np.load(io.BytesIO(data), allow_pickle=False)
    for name in ("raw", "dqf", "x", "y"):
        if name not in z:
            raise ValueError(f"{name} is missing")
    if z["raw"].shape != z["dqf"].shape or z["raw"].shape != (z["y"].size, z["x"].size):
        raise ValueError("shapes disagree")
    return z["raw"], z["dqf"], z["x"], z["y"]


def _netcdf(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    try:
        import netCDF4
    except ImportError as error:
        raise RuntimeError("no NetCDF reader is installed") from error
    with netCDF4.Dataset("memory", memory=data) as d:
        d.set_auto_maskandscale(False)
        x, y = (d[n][:] * d[n].scale_factor + d[n].add_offset for n in ("x", "y"))
        return d["CMI"][:], d["DQF"][:], x, y


def _rows(name: str, data: bytes) -> pa.RecordBatch:
    raw, dqf, x, y = (_npz if name.endswith(".npz") else _netcdf)(data)
    r, c = (a.ravel() for a in np.indices(raw.shape))
    columns = {"frame_id": pa.array([Path(name).stem] * raw.size), "row": r.astype(np.int32), "col": c.astype(np.int32), "raw": raw.ravel().astype(np.int32), "dqf": dqf.ravel().astype(np.int32), "x": x[c].astype(float), "y": y[r].astype(float)}
    return pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


class RasterSource(DataSource):
    """spark.read.format("thermal_raster").load(folder of .npz or .nc files on a path that the executors see): one task a file."""

    @classmethod
    def name(cls) -> str:
        return "thermal_raster"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path)
        return [_File(str(f)) for f in ([p] if p.is_file() else sorted([*p.glob("*.npz"), *p.glob("*.nc")]))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield _rows(partition.path, Path(partition.path).read_bytes())


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pixel rows of raster files by any path that Spark's readers can open (a store too)."""
    from thermal_lake.shipping import ship

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _rows(name, data)

    return files.mapInArrow(run, PIXELS)


def save_crop(path: str | Path, arrays: dict[str, np.ndarray], metadata: dict) -> str:
    """An .npz crop with its metadata and the checksum of both; the same input gives the same bytes but for the archive's own dates."""
    digest = crop_checksum(arrays, metadata)
    text = json.dumps(metadata | {"checksum": digest}, sort_keys=True)
    with Path(path).open("wb") as f:
        np.savez(f, metadata=np.frombuffer(text.encode(), dtype=np.uint8), **arrays)
    return digest


def load_crop(path: str | Path) -> tuple[dict[str, np.ndarray], dict]:
    """What save_crop wrote; a checksum that doesn't hold raises."""
    z = np.load(path, allow_pickle=False)
    metadata = json.loads(z["metadata"].tobytes())
    arrays = {n: z[n] for n in z.files if n != "metadata"}
    if metadata.pop("checksum") != crop_checksum(arrays, metadata):
        raise ValueError(f"{path} was changed")
    return arrays, metadata


def crop_checksum(arrays: dict[str, np.ndarray], metadata: dict) -> str:
    h = hashlib.sha256(json.dumps(metadata, sort_keys=True).encode())
    for n in sorted(arrays):
        a = np.ascontiguousarray(arrays[n])
        h.update(f"\0{n}\0{a.dtype.str}\0{a.shape}\0".encode() + a.tobytes())
    return h.hexdigest()


def checksums(tiles: DataFrame, planes: list[str], key: str = "frame_id") -> DataFrame:
    """A checksum for each tile row, over its planes in order."""
    return tiles.select(key, F.sha2(F.to_json(F.struct(*sorted(planes))), 256).alias("checksum"))
