"""python -m thermal_lake TASK: queries over the driver tables, and whole pipelines over Parquet tables."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def session(name: str = "thermal_lake") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def evidence(spark: SparkSession, t: Tables, a: argparse.Namespace) -> Tables:
    from thermal_lake.plans import pipelines

    job = pipelines.evidence_job(t["pixels"], t["steps"], companion=t.get("companion"), align=a.align)
    return {"quality": job.quality, "components": job.components, "tracks": job.tracks, "persistence": job.persistence, "outcomes": pipelines.outcomes(job.packets)}


def slices(spark: SparkSession, t: Tables, a: argparse.Namespace) -> Tables:
    from thermal_lake.operators import raster
    from thermal_lake.plans import pipelines

    return {"slice": pipelines.replay_slice(raster.anomaly_tiles(t["pixels"]), a.limit)}


def build(spark: SparkSession, t: Tables, a: argparse.Namespace) -> Tables:
    from thermal_lake.plans import pipelines

    b = pipelines.build_benchmark(t["events"], t["windows"], t["detections"], a.count, a.seed)
    return {"pairs": b.pairs, "cases": b.cases, "audit": b.audit, "problems": pipelines.benchmark_problems(b, t["detections"])}


def freeze(spark: SparkSession, t: Tables, a: argparse.Namespace) -> Tables:
    from thermal_lake.plans import pipelines

    f = pipelines.freeze(t["cases"], a.keys, a.keep, a.dimensions, a.benchmark_sha256)
    return {"cases": f.cases, "blind": f.blind, "labels": f.labels, "leakage": f.leakage, "distribution": f.distribution, "sample": f.sample, "problems": pipelines.frozen_problems(f)}


def baselines(spark: SparkSession, t: Tables, a: argparse.Namespace) -> Tables:
    from thermal_lake.operators import evaluate
    from thermal_lake.plans import evaluation

    rows = evaluation.baselines(t["cases"], t["pixels"])
    return {"results": rows, "summary": evaluate.baseline_summary(rows.withColumn("latency_milliseconds", F.lit(0.0)))}


def frozen_evaluation(spark: SparkSession, t: Tables, a: argparse.Namespace) -> Tables:
    from thermal_lake.operators.records import canonical
    from thermal_lake.plans import evaluation
    from thermal_lake.sources import sinks

    e = evaluation.evaluate_frozen(t["cases"], t["labels"], t["pixels"])
    sinks.write_text(Path(a.report), canonical(e.report, newline=True), a.overwrite)
    return {"rows": e.rows, "tables": e.tables}


def error_analysis(spark: SparkSession, t: Tables, a: argparse.Namespace) -> Tables:
    from thermal_lake.plans import evaluation

    return evaluation.analysis(json.loads(Path(a.report).read_text()), t["rows"], t["tables"], t["traces"])


def agent_loop(spark: SparkSession, t: Tables, a: argparse.Namespace) -> Tables:
    from thermal_lake.operators import decide

    return {"outcomes": decide.run_loop(t["cases"], t["evidence"], a.rounds, t.get("checkpoints"))}


#: Tasks over Parquet tables: what they do, the tables they need, those they may take, and their options.
PIPELINES: dict[str, tuple[Callable[[SparkSession, Tables, argparse.Namespace], Tables], list[str], list[str], dict[str, dict]]] = {
    "evidence": (evidence, ["pixels", "steps"], ["companion"], {"--align": {"action": "store_true"}}),
    "slice": (slices, ["pixels"], [], {"--limit": {"type": float, "default": 320.0}}),
    "benchmark-build": (build, ["events", "windows", "detections"], [], {"--count": {"type": int, "default": 60}, "--seed": {"type": int, "default": 20260101}}),
    "benchmark-freeze": (freeze, ["cases"], [], {"--keys": {"nargs": "+", "required": True}, "--keep": {"nargs": "*", "default": []}, "--dimensions": {"nargs": "+", "default": ["label"]}, "--benchmark-sha256": {"required": True}}),
    "baselines": (baselines, ["cases", "pixels"], [], {}),
    "frozen-evaluation": (frozen_evaluation, ["cases", "labels", "pixels"], [], {"--report": {"required": True}}),
    "error-analysis": (error_analysis, ["rows", "tables", "traces"], [], {"--report": {"required": True}}),
    "agent-loop": (agent_loop, ["cases", "evidence"], ["checkpoints"], {"--rounds": {"type": int, "default": 3}}),
}


def run_pipeline(spark: SparkSession, a: argparse.Namespace) -> int:
    from thermal_lake.sources import sinks

    run, needed, optional, _ = PIPELINES[a.task]
    tables = {n: spark.read.parquet(f"{a.tables}/{n}.parquet") for n in needed}
    tables |= {n: spark.read.parquet(f"{a.tables}/{n}.parquet") for n in optional if sinks.exists(spark, f"{a.tables}/{n}.parquet")}
    for name, df in run(spark, tables, a).items():
        print(name, sinks.write_once(df, f"{a.output}/{name}.parquet", a.overwrite))
    return 0


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    from thermal_lake.operators import relate
    from thermal_lake.sources import detections, sinks

    rows = detections.read_csvs(spark, a.csv).where("NOT is_blank")
    unique = detections.distinct(detections.strict(detections.normalized(rows))).selectExpr("xxhash64(*) AS detection_id", "*")
    events = relate.events_of(unique.join(relate.single_linkage(unique), "detection_id"))
    print(sinks.write_once(events, a.output, a.overwrite))
    return 0


def replay(spark: SparkSession, a: argparse.Namespace) -> int:
    """Prints what is wrong with journal files; 1 if anything is."""
    from thermal_lake.sources import journal

    found = journal.problems(journal.read(spark, a.journal)).collect()
    for r in found:
        print(r["source_file"], r["problem"])
    return int(bool(found))


def cache(a: argparse.Namespace) -> int:
    from thermal_lake.sources import blobs

    store = blobs.BlobCache(a.root, lambda url: ())
    if a.task == "cache-clean-case":
        print("\n".join(store.clean(a.case)))
    else:
        for case, digest in store.references():
            print(case, digest, store.path(digest).exists())
    return 0


def main(arguments: list[str] | None = None) -> int:
    from thermal_lake import catalog

    parser = argparse.ArgumentParser(prog="thermal_lake", description=__doc__)
    sub = parser.add_subparsers(dest="task", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query", choices=sorted(catalog.QUERIES))
        p.add_argument("tables", help="folder of the input tables")
        p.add_argument("--output", help="Parquet table to write; without it rows are shown")
    p = sub.add_parser("ingest")
    p.add_argument("csv", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--overwrite", action="store_true")
    for name, (_, needed, optional, options) in PIPELINES.items():
        p = sub.add_parser(name)
        p.add_argument("tables", help=f"folder of {', '.join(f'{n}.parquet' for n in needed)}" + "".join(f" and, if it is there, {n}.parquet" for n in optional))
        p.add_argument("--output", required=True, help="folder of the tables to write")
        p.add_argument("--overwrite", action="store_true")
        for option, how in options.items():
            p.add_argument(option, **how)
    sub.add_parser("replay").add_argument("journal")
    for name in ("cache-inspect", "cache-clean-case"):
        p = sub.add_parser(name)
        p.add_argument("root")
        if name == "cache-clean-case":
            p.add_argument("case")
    a = parser.parse_args(arguments)
    if a.task == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if a.task.startswith("cache-"):
        return cache(a)
    spark = session()
    if a.task in PIPELINES:
        return run_pipeline(spark, a)
    if a.task in ("ingest", "replay"):
        return {"ingest": ingest, "replay": replay}[a.task](spark, a)
    df = catalog.QUERIES[a.query](spark, a.tables)
    if a.task == "explain":
        df.explain("formatted")
    elif a.output:
        df.write.mode("overwrite").parquet(a.output)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
