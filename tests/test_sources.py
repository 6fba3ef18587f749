import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermal_lake import config
from thermal_lake.operators import records
from thermal_lake.plans import views
from thermal_lake.sources import blobs, catalog, detections, documents, journal, raster_files, sinks

CSV = "latitude, Longitude ,brightness,acq_date,acq_time,confidence,instrument,frp\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_detection_csv(spark, tmp_path):
    rows = "30,-120,300.0005,2025-01-01,5,n,viirs,1\n30.0,-120.00,300.0005,2025-01-01,0005,nominal,VIIRS,2\n , ,,,,,,\n-0.0000001,180,310,2025-01-01,1230,55.50,Modis,3\n"
    path = write(tmp_path / "a.csv", "﻿" + CSV + rows)
    raw = detections.read_csvs(spark, [path])
    assert raw.where("is_blank").count() == 1
    d = detections.normalized(raw.where("NOT is_blank"))
    assert d.where("error IS NOT NULL").count() == 0
    u = detections.distinct(detections.strict(d)).orderBy("acquired_at").collect()
    assert len(u) == 2
    assert (u[0]["confidence"], u[0]["brightness_kelvin"], u[0]["instrument"]) == ("nominal", 300.001, "VIIRS")
    assert (str(u[1]["latitude"]), u[1]["confidence"]) == ("0.0", "55.5")
    a = detections.audit(raw, d).first()
    assert (a["source_rows"], a["blank_rows"], a["unique_detections"], a["duplicates"]) == (4, 1, 2, 1)
    with pytest.raises(ValueError):
        detections.read_csvs(spark, [path, path])


def test_bad_detections(spark, tmp_path):
    raw = detections.read_csvs(spark, [write(tmp_path / "b.csv", CSV + "91,0,300,2025-01-01,0,n,viirs,1\n0,0,300,2025-02-30,0,n,viirs,1\n0,0,300,2025-01-01,2460,n,viirs,1\n0,0,300,2025-01-01,1,odd,viirs,1\n")])
    assert sorted(r["error"] for r in detections.normalized(raw).collect()) == ["acq_date", "acq_time", "confidence", "latitude"]
    with pytest.raises(Exception, match="bad detection"):
        detections.strict(detections.normalized(raw)).collect()
    for header in ("a,a\n", "latitude\n", ",x\n"):
        with pytest.raises(ValueError):
            detections.read_csvs(spark, [write(tmp_path / "c.csv", header)])


def test_quoted_fields_header_rows_and_places(spark, tmp_path):
    first = write(tmp_path / "a.csv", CSV + '30,-120,300,2025-01-01,5,n,"viirs",1\n\n30,-120,300,2025-01-01,5,n,viirs,"two\nlines, quoted"\n' + CSV + "95,-120,300,2025-01-01,5,n,viirs,1\n")
    second = write(tmp_path / "b.csv", CSV.replace(" Longitude ", '"Longi""tude"').replace('"Longi""tude"', '"Longitude"') + "1,2,300,2025-01-01,5,n,viirs,1\n")
    raw = detections.read_csvs(spark, [first, second])
    rows = raw.orderBy("source_file", "row_number").collect()
    assert [(r["source_file"][-5:], r["row_number"], r["latitude"]) for r in rows] == [("a.csv", 2, "30"), ("a.csv", 3, "30"), ("a.csv", 4, "latitude"), ("a.csv", 5, "95"), ("b.csv", 2, "1")]
    digest = lambda p: hashlib.sha256(open(p, "rb").read()).hexdigest()
    assert {(r["source_sha256"], r["row_count"]) for r in detections.source_audit(raw).collect()} == {(digest(first), 4), (digest(second), 1)}
    bad = detections.normalized(raw).where("error IS NOT NULL").orderBy("row_number").collect()
    assert [(r["row_number"], r["error"]) for r in bad] == [(4, "acq_date"), (5, "latitude")]
    with pytest.raises(Exception, match=r"bad detection: .*a\.csv:[45]:"):
        detections.strict(detections.normalized(raw)).collect()


def transition(n, **more):
    return json.dumps({k: None for k in journal.KEYS} | {"trace_id": "t", "case_id": "c", "sequence": n, "to_state": "observe"} | more)


def test_journal(spark, tmp_path):
    good = write(tmp_path / "good.jsonl", transition(1) + "\n" + transition(2, to_state="act") + "\n" + '{"trace_id": "t", "seq')
    lines = journal.read(spark, good)
    assert lines.where("torn").count() == 1
    assert journal.problems(lines).count() == 0
    last = journal.last_transitions(lines).first()
    assert (last["sequence"], last["to_state"]) == (2, "act")
    bad = write(tmp_path / "bad.jsonl", transition(1) + "\nnot json\n" + transition(3) + "\n" + transition(4, extra=1) + "\n")
    assert {r["problem"] for r in journal.problems(journal.read(spark, bad)).collect()} == {"corrupt line", "not contiguous", "unknown key"}
    t = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b")], "trace_id string, sequence long, to_state string")
    table = str(tmp_path / "table")
    journal.append(t.limit(1), table)
    journal.append(t, table)
    journal.append(t, table)
    assert spark.read.parquet(table).count() == 2
    e = journal.count_events(spark, write(tmp_path / "e.jsonl", '{"a": 1}\nnull\n\nx\n')).first()
    assert (e["lines"], e["events"]) == (3, 1)


def test_blob_cache(spark, tmp_path):
    data = {"u": b"hello", "v": b"world"}
    tries = []

    def opener(url):
        tries.append(url)
        if len(tries) == 1:
            raise OSError("cut off")
        yield data[url]

    waits = []
    cache = blobs.BlobCache(tmp_path / "blobs", opener, sleep=waits.append)
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in data.items()}
    r = cache.fetch("one", "u", sha["u"], 5)
    assert (r["reused"], r["attempts"], waits) == (False, 2, [0.5])
    assert cache.fetch("two", "u", sha["u"], 5)["reused"]
    assert cache.receipts(spark, [{"case_id": "one", "url": "v", "sha256": sha["v"], "size": 5}]).count() == 1
    with pytest.raises(blobs.BlobError):
        cache.fetch("one", "v", sha["u"][::-1], 5)
    root = str(tmp_path / "blobs" / "objects")
    assert blobs.inspection(spark, root).first()["objects"] == 2
    found = blobs.scan(spark, root)
    asked = spark.createDataFrame([("a", sha["u"], 5), ("b", sha["u"], 6), ("c", "0" * 64, 1)], "source_id string, sha256 string, size_bytes long")
    assert {r["source_id"]: r["error"] for r in blobs.unverified(asked, found).collect()} == {"b": "size", "c": "missing"}
    refs = spark.createDataFrame(cache.references(), "case_id string, sha256 string")
    assert blobs.unreferenced(found, refs).count() == 0
    assert cache.clean("one") == [sha["v"]]
    assert cache.verify(sha["u"], 5).exists()
    cache.path(sha["u"]).write_bytes(b"xxxxx")
    with pytest.raises(blobs.BlobError):
        cache.verify(sha["u"], 5)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert sinks.write_once(df, path) == "written"
    assert sinks.write_once(df.orderBy(F.desc("k")), path) == "unchanged"
    with pytest.raises(FileExistsError):
        sinks.write_once(df.limit(1), path)
    p = sinks.Packets(spark, str(tmp_path / "packets"))
    body = spark.createDataFrame([("c1", "h1", "{}"), ("c2", "h2", "[]")], "case_id string, content_hash string, payload string")
    assert p.publish(body).count() == 2
    assert p.publish(body).count() == 2
    assert p.packets().count() == 2
    assert p.corrupt().count() == 0
    assert sinks.write_pair(tmp_path, "labels.json", {"b": 1, "a": [1.5]}, "audit.json", {"n": 1}) == ("written", "written")
    audit = json.loads((tmp_path / "audit.json").read_text())
    assert audit["labels_sha256"] == hashlib.sha256((tmp_path / "labels.json").read_bytes()).hexdigest()
    with pytest.raises(FileExistsError):
        sinks.write_pair(tmp_path, "labels.json", {"b": 2}, "audit.json", {"n": 1})
    assert sinks.pinned(tmp_path, ["labels.json", "audit.json"]) == sinks.pinned(tmp_path, ["audit.json", "labels.json"])
    for i, text in enumerate(('{"case_id": "x"}', '{"case_id": "x"}', "oops")):
        (tmp_path / f"e{i}").mkdir()
        (tmp_path / f"e{i}" / "evidence.json").write_text(text)
    kept, skipped = sinks.discovered(spark, str(tmp_path))
    assert kept.count() == 1
    assert {r["why"] for r in skipped.collect()} == {"unreadable", "repeated case"}


def test_raster_files(spark, tmp_path):
    raw = np.arange(6, dtype=np.int16).reshape(2, 3)
    np.savez(tmp_path / "f1.npz", raw=raw, dqf=np.zeros((2, 3), np.uint8), x=np.array([0.0, 0.1, 0.2]), y=np.array([0.1, 0.0]))
    r = raster_files.read(spark, str(tmp_path / "*.npz")).orderBy("row", "col").collect()
    assert [x["raw"] for x in r] == list(range(6))
    assert (r[5]["x"], r[5]["y"]) == (0.2, 0.0)
    spark.dataSource.register(raster_files.RasterSource)
    assert spark.read.format("thermal_raster").load(str(tmp_path)).count() == 6
    digest = raster_files.save_crop(tmp_path / "crop.npz", {"raw": raw}, {"a": 1})
    arrays, meta = raster_files.load_crop(tmp_path / "crop.npz")
    assert raster_files.crop_checksum(arrays, meta) == digest


def test_catalog_listing_and_snapshots(spark, tmp_path):
    page = lambda keys, more: '<R xmlns="x">' + "".join(f"<Contents><Key>{k}</Key><Size>{n}</Size></Contents>" for k, n in keys) + (f"<IsTruncated>true</IsTruncated><NextContinuationToken>{more}</NextContinuationToken>" if more else "") + "</R>"
    pages = {None: page([("p/b", 1), ("p/a", 2)], "t"), "t": page([("p/b", 3)], None)}
    found = catalog.listing(pages.__getitem__, spark)
    assert [tuple(r) for r in found.collect()] == [("p/a", 2), ("p/b", 3)]
    s = catalog.Snapshots(spark, str(tmp_path))
    assert s.load("b", "p/") is None
    s.store(found, "b", "p/", "2025-01-01 00:00:00")
    assert s.load("b", "p/").count() == 2
    with pytest.raises(ValueError):
        catalog.listing(lambda _: page([], "t"), spark)
    c = spark.createDataFrame([("c", [("s", "a b/c+d", 1, "x")])], "case_id string, sources array<struct<source_id: string, object_key: string, size_bytes: long, sha256: string>>")
    assert catalog.source_requests(c, "https://h/").first()["url"] == "https://h/a%20b/c%2Bd"


def test_documents(spark, tmp_path):
    at = lambda m: f"2025-01-01T{12 + m // 60:02d}:{m % 60:02d}:00Z" if m >= 0 else "2025-01-01T11:00:00Z"
    roles = [("baseline", "C07", at(-60)), ("initial", "C07", at(0)), ("later", "C07", at(30)), ("alternate", "C14", at(5))]
    window = lambda i, rs: {"window_id": i, "anchor": {"acquisition_time_utc": at(0), "latitude": 1.0, "longitude": 2.0}, "view_zenith_degrees": 1.0, "usable_fraction": 1.0, "observations": [{"role": r, "channel": c, "observation_time_utc": t, "source_id": "s"} for r, c, t in rs]}
    doc = {"schema_version": 1, "sources": [], "windows": [window("ok", roles), window("few", roles[:3]), window("late", [*roles[:2], ("later", "C07", at(100)), roles[3]])]}
    rows, seen = documents.windows(documents.read(spark, write(tmp_path / "i.json", json.dumps(doc)), "inventory"))
    assert {r["window_id"]: r["problem"] for r in documents.window_problems(rows, seen).collect()} == {"few": "roles", "late": "later"}
    for bad in (doc | {"x": 1}, doc | {"schema_version": 2}):
        with pytest.raises(Exception, match="inventory"):
            documents.read(spark, write(tmp_path / "b.json", json.dumps(bad)), "inventory").collect()


def test_records(spark):
    action = {"schema_version": 1, "record_type": "action", "action_id": "a", "case_id": "c", "action_type": "finalize", "observation_id": None, "evidence_ids": [], "reason": "r"}
    cases = [action, action | {"action_type": "dance"}, action | {"x": 1}, action | {"schema_version": 2}, action | {"observation_id": "o"}, {k: v for k, v in action.items() if k != "reason"}]
    r = records.parse(spark.createDataFrame([(json.dumps(c),) for c in cases], "value string"), "action").collect()
    assert [x["error"] for x in r] == [None, "domain", "unknown key", "version", "domain", "missing key"]
    assert records.parse(spark.createDataFrame([("[1",)], "value string"), "action").first()["error"] == "not an object"
    seal = records.sealed({"a": 1.0, "é": [None]})
    assert records.seal_holds(seal)
    assert not records.seal_holds(seal | {"a": 2.0})
    assert records.canonical({"b": 1e-5, "a": "é"}) == '{"a":"\\u00e9","b":1e-05}'
    h = spark.createDataFrame([('{"b": 1, "a": 2}',), ('{"a":2,"b":1}',), ("x",)], "t string").select(records.content_hash(F.col("t")).alias("h")).collect()
    assert h[0]["h"] == h[1]["h"]
    assert h[2]["h"] is None
    with pytest.raises(ValueError):
        records.content_directory("/x", "../c", "0" * 64)


def test_trace_problems(spark):
    conf = "struct<configuration_id: string, sha256: string>"
    t = spark.createDataFrame([("t", "c", ("k", "s"), ["o1", "o2"], ["s1"], ["e1"], ["a1"], "out")], f"trace_id string, case_id string, configuration {conf}, observation_ids array<string>, source_ids array<string>, evidence_ids array<string>, action_ids array<string>, outcome_id string")
    case = spark.createDataFrame([("c", ["o1"])], "case_id string, allowed_observation_ids array<string>")
    req = spark.createDataFrame([("o1", "c"), ("o2", "d")], "observation_id string, case_id string")
    src = spark.createDataFrame([("s1", "o9")], "source_id string, observation_id string")
    ev = spark.createDataFrame([("e1", "c", "o1", "s1", ("k", "other"))], f"evidence_id string, case_id string, observation_id string, source_id string, configuration {conf}")
    act = spark.createDataFrame([("a1", "c", ["e1", "e2"])], "action_id string, case_id string, evidence_ids array<string>")
    out = spark.createDataFrame([("out", "t", "c", ["e1"], ("k", "s"))], f"outcome_id string, trace_id string, case_id string, evidence_ids array<string>, configuration {conf}")
    got = {r["problem"] for r in records.trace_problems(t, case, req, src, ev, act, out).collect()}
    assert got == {"request of another case", "request not allowed", "source without a request", "evidence of another configuration", "action on unknown evidence"}


def test_settings_and_paths():
    s = config.load({"THERMAL_LAKE_ROOT": "/r", "THERMAL_LAKE_CACHE": "c"})
    assert (s.cache, s.artifacts) == ("/r/c", "/r/artifacts")
    with pytest.raises(ValueError):
        config.load({"THERMAL_LAKE_LOG_LEVEL": "loud"})
    with pytest.raises(PermissionError):
        config.runtime_path("/x/labels/a.json")
    with pytest.raises(PermissionError):
        config.tuning_path("/x/test.json")
    assert config.tuning_path("/x/development.json")


def test_views(spark):
    r = spark.createDataFrame([(12.3456, -1.5, "human_review")], "a double, b double, c string").select(views.number(F.col("a")).alias("n"), views.place(F.col("a"), F.col("b")).alias("p"), views.label(F.col("c")).alias("l")).first()
    assert (r["n"], r["p"], r["l"]) == ("12.35", "12.3456N, 1.5000W", "Human Review")
    c = spark.createDataFrame([(1, [(0, 0), (4, 0), (4, 4)])], "frame_id long, points array<struct<x: int, y: int>>")
    cells = {(r["y"], r["x"]) for r in views.outline(c, 5, 5, 5, 5).collect()}
    assert {(0, 0), (0, 4), (4, 4), (2, 2)} <= cells
