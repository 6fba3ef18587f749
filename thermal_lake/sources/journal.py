"""Journals: JSON lines of transitions, tolerant of a torn last line; contiguity, last states, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The keys of a transition.
KEYS = (
    "schema_version", "record_type", "trace_id", "case_id", "sequence", "from_state", "to_state", "event", "selected_observation_ids", "evidence_ids", "budget", "analysis",
    "decision", "pending_action", "last_tool_result", "outcome", "failure_reason",
)
TERMINAL = ("finalize", "abstain", "review", "failure")
ORDER = {"trace_id": "string", "case_id": "string", "sequence": "long", "from_state": "string", "to_state": "string", "event": "string"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of journal files: source_file, offset (a line's start), raw, parsed (null if it isn't an object), torn (it doesn't parse, and is its file's last).

    Files are read whole lines by offset, so one file's lines keep their order on any number of tasks.
    """
    lines = spark.read.option("wholetext", False).text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("offset")).where(F.length("raw") > 0)
    known = lines.withColumn("parsed", F.when(F.try_parse_json("raw").isNotNull() & F.col("raw").startswith("{"), F.from_json("raw", ", ".join(f"{k} {v}" for k, v in ORDER.items()))))
    last = known.groupBy("source_file").agg(F.max("offset").alias("_last"))
    return known.join(last, "source_file").withColumn("torn", F.col("parsed").isNull() & (F.col("offset") == F.col("_last"))).drop("_last")


def problems(lines: DataFrame) -> DataFrame:
    """What is wrong with a journal: a corrupt line that isn't the last, a sequence with a gap, a trace or case that changes, an unknown or missing key."""
    good = lines.where("parsed IS NOT NULL").select("source_file", "offset", "raw", "parsed.*")
    w = Window.partitionBy("source_file").orderBy("offset")
    before = {c: F.lag(c).over(w) for c in ("trace_id", "case_id", "sequence")}
    keys = F.json_object_keys("raw")
    wrong = F.when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS]))) > 0, "unknown key").when(F.size(keys) < len(KEYS), "missing key")
    jump = F.when(before["sequence"].isNotNull(), F.when(before["sequence"] + 1 != F.col("sequence"), "not contiguous").when((before["trace_id"] != F.col("trace_id")) | (before["case_id"] != F.col("case_id")), "another trace"))
    found = good.select("source_file", "offset", F.coalesce(jump, wrong).alias("problem")).where("problem IS NOT NULL")
    return found.unionByName(lines.where("parsed IS NULL AND NOT torn").select("source_file", "offset", F.lit("corrupt line").alias("problem")))


def last_transitions(lines: DataFrame) -> DataFrame:
    """The last complete transition of each file."""
    good = lines.where("parsed IS NOT NULL")
    return good.groupBy("source_file").agg(F.max_by(F.struct("raw", "parsed"), "offset").alias("t")).select("source_file", "t.raw", "t.parsed.*")


def contiguity(transitions: DataFrame) -> DataFrame:
    """Transitions and gaps of each trace; a trace starts at 1."""
    w = Window.partitionBy("trace_id").orderBy("sequence")
    step = transitions.withColumn("p", F.lag("sequence").over(w))
    return step.groupBy("trace_id").agg(F.count("*").alias("transitions"), F.count_if(F.col("sequence") != F.coalesce("p", F.lit(0)) + 1).alias("gaps"))


def last_states(transitions: DataFrame) -> DataFrame:
    """The state of each trace after its last transition: partial maxima, no sort."""
    return transitions.groupBy("trace_id").agg(F.max("sequence").alias("sequence"), F.max_by("to_state", "sequence").alias("to_state"))


def append(transitions: DataFrame, path: str) -> None:
    """Adds the transitions that the table doesn't hold yet, by (trace_id, sequence): the same batch twice changes nothing."""
    spark = transitions.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = transitions.dropDuplicates(["trace_id", "sequence"])
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        fresh = fresh.join(spark.read.parquet(path).select("trace_id", "sequence"), ["trace_id", "sequence"], "left_anti")
    fresh.write.mode("append").parquet(path)


def count_events(spark: SparkSession, path: str) -> DataFrame:
    """Lines and proper, non-null JSON values of JSONL files."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.try_parse_json("value").isNotNull() & (F.trim("value") != "null")).alias("events"))
