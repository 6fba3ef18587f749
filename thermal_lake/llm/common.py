"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from thermal_lake.operators.graph import scratch, written
from thermal_lake.shipping import ship

__all__ = ["bounded", "documents", "filter_arrow", "held_out", "is_small", "least_count", "map_arrow", "numbered", "only_rows", "release", "replace_arrow", "scratch", "ship", "unused", "without", "written"]

#: Rows that a kernel turns into Python objects at once, so that very long texts stay bounded.
SLICE = 512
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_remainder(col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null for a null id)."""
    return F.crc32(col.cast("string")) % n


def held_out(col: Column, n: int, remainder: int = 2) -> Column:
    """Whether a row is held out of learning; a null id never is."""
    return F.coalesce(crc_remainder(col, n) == remainder, F.lit(False))


def bounded(spark: SparkSession) -> None:
    """Holds Arrow batches to SLICE_BYTES in this session (unless they are smaller already), so that very long texts can't make a batch of gigabytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(spark.conf.get(key)).removesuffix("b")) <= SLICE_BYTES:
        spark.conf.set(key, SLICE_BYTES)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    def halves(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows > 1 and batch.nbytes > size:
            yield from halves(batch.slice(0, batch.num_rows // 2))
            yield from halves(batch.slice(batch.num_rows // 2))
        else:
            yield batch

    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield from halves(batch.slice(start, rows))


def release() -> None:
    """Gives what a finished kernel has freed back to the system: a worker outlives its task, and shares its executor's memory with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def map_arrow(df: DataFrame, schema: str, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], rows: int = SLICE, size: int = SLICE_BYTES) -> DataFrame:
    """df through a kernel that takes small record batches and yields columns as a dict of lists or arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    bounded(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in kernel(slices(batches, rows, size)):
            yield pa.record_batch([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in out], schema=out)

    return df.mapInArrow(releasing(run), schema)


def filter_arrow(df: DataFrame, text_col: str, predicate: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of df, with all their columns, whose text the predicate accepts; predicate() makes it, once for each task."""
    ship(df.sparkSession)
    bounded(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = predicate()
        for batch in slices(batches):
            yield batch.filter(pa.array([accepts(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(releasing(run), df.schema)


def replace_arrow(df: DataFrame, text_col: str, function: Callable[[], Callable[[str], str]], changed: str) -> DataFrame:
    """df with its texts replaced (null stays null) and the boolean column `changed`; function() makes the function, once for each task."""
    ship(df.sparkSession)
    bounded(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = function()
        for batch in slices(batches):
            old = batch.column(at).to_pylist()
            new = [None if t is None else one(t) for t in old]
            columns = [pa.array(new, c.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([a != b for a, b in zip(old, new, strict=True)], pa.bool_())], names=[*batch.schema.names, changed])

    return df.mapInArrow(releasing(run), StructType([*df.schema.fields, StructField(changed, BooleanType())]))


#: Row numbers that one bitmap covers (Spark's bitmap functions fix it), and bitmaps (of 4 KB) that are broadcast at most.
BITMAP_BITS, BITMAPS = 15, 8192


def only_rows(df: DataFrame, row: str, ids: DataFrame, keep: bool) -> DataFrame:
    """The rows of df whose number `row` is among ids' (keep), or isn't (not keep); exact, and df isn't shuffled.

    The numbers become bitmaps, which are counted and broadcast. Beyond BITMAPS of them df is joined by a shuffle. What returns reads, besides df, one table that is written here: its attribute `_reads`.
    """
    bucket, bitmap = unused(df, "_bucket"), unused(df, "_bitmap")
    bits = ids.select(F.shiftright(row, BITMAP_BITS).alias(bucket), F.col(row).bitwiseAND((1 << BITMAP_BITS) - 1).alias(row)).groupBy(bucket).agg(F.bitmap_construct_agg(row).alias(bitmap))
    reads = written(bits, "row-bitmaps")
    if is_small(reads, BITMAPS):
        at = F.col(row).bitwiseAND((1 << BITMAP_BITS) - 1).cast("int")
        byte = F.conv(F.hex(F.substr(bitmap, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        marked = F.coalesce(F.getbit(byte, at.bitwiseAND(7)), F.lit(0)) == int(keep)
        out = df.join(F.broadcast(reads), F.shiftright(row, BITMAP_BITS) == F.col(bucket), "left").where(marked).select(*df.columns)
    else:
        reads = written(ids.select(row).distinct(), "rows-listed")
        out = df.join(reads, row, "left_semi" if keep else "left_anti")
    out._reads = reads
    return out


def numbered(df: DataFrame, row: str) -> DataFrame:
    """df as a written table with a number of each row: whoever reads it finds the same numbers, however it is read."""
    return written(df.withColumn(row, F.monotonically_increasing_id()), "numbered")


def without(df: DataFrame, dropped: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """df without the rows that dropped(df as a written table with a row number, its name) names by that number; df is read once."""
    row = unused(df, "_row_number")
    with scratch(df.sparkSession) as keep:
        rows = keep(numbered(df, row))
        out = only_rows(rows, row, dropped(rows, row).select(row), False)
        keep(out._reads)
    return out.drop(row)


def least_count(counts: DataFrame, most: int) -> int:
    """The count n that at most so many rows reach, from a histogram in steps of an eighth of a doubling; without rows, and where even the greatest counts are of too many, more than any."""
    step = F.floor(F.log2("n") * 8)
    bins = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, total = 1 << 62, 0
    for r in bins:
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    return least


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as keep it from clashing."""
    while name in df.columns:
        name = f"_{name}"
    return name


def is_small(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(most + 1).count() <= most
