"""Files in and out: frames, metadata, candidates, annotations, analyses, logs, baselines."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from emberlog.operators import frames as fr
from emberlog.sources import images, io


def png(path, rows):
    """Writes an RGB image given as rows of (r, g, b)."""
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("replays")
    for s in ("one", "two"):
        (base / s / "frames").mkdir(parents=True)
        for i in range(3):
            rows = [[(255, 200, 0) if x < 4 + i and y < 2 else (10, 10, 10) for x in range(12)] for y in range(6)]
            png(base / s / "frames" / f"frame_{i:06d}.png", rows)
    (base / "one" / "metadata.json").write_text(json.dumps({"session_name": "One", "fps": 10, "status": "done", "frames_written": 3}, indent=1))
    (base / "two" / "metadata.json").write_text("[1, 2")
    a = base / "one" / "analysis" / "combat-ocr"
    a.mkdir(parents=True)
    hit = {"parsed_value": 5, "first_frame": 4, "last_frame": 4, "occurrences": 1, "best_confidence": 0.9}
    (a / "summary.json").write_text(json.dumps({"candidate_count": 1, "results": [{"frame_name": "frame_000001.png", "raw_text": "12K", "parsed_value": 12000, "confidence": 0.9}], "stable_hits": [hit, {**hit, "frame_index": 7, "timestamp_ms": 70}]}, indent=1))
    return base


def test_frames(spark, root):
    f = io.read_frames(spark, str(root))
    assert sorted((r.session_id, r.frame_index) for r in f.select("session_id", "frame_index").collect()) == [(s, i) for s in ("one", "two") for i in range(3)]
    census = {(r.session_id, r.frame_index): r.text_pixels for r in images.image_census(f).collect()}
    assert census == {(s, i): 2 * (4 + i) for s in ("one", "two") for i in range(3)}
    px = images.text_pixels(f)
    counted = fr.pixel_census(px, ["session_id", "frame_index"])
    assert {(r.session_id, r.frame_index): r.text_pixels for r in counted.collect()} == census
    boxes = fr.components(px, min_pixels=4, min_width=2, min_height=2, keys=["session_id", "frame_index"])
    assert {(r.session_id, r.frame_index): (r.left, r.top, r.right, r.bottom, r.pixel_count) for r in boxes.collect()} == {(s, i): (0, 0, 3 + i, 1, 2 * (4 + i)) for s in ("one", "two") for i in range(3)}
    gate = fr.motion_gate(images.thumbnails(f, 12, 6), threshold=3.0)
    assert {(r.session_id, r.frame_index): r.is_kept for r in gate.collect()} == {(s, i): True for s in ("one", "two") for i in range(3)}


def test_metadata(spark, root):
    sessions = spark.createDataFrame([("one",), ("two",), ("three",)], "session_id string")
    out = {r.session_id: (r.session_name, r.fps) for r in io.read_metadata(spark, str(root), sessions).collect()}
    assert out == {"one": ("One", 10.0), "two": (None, None), "three": (None, None)}


def test_analyses(spark, root):
    a = io.read_analyses(spark, str(root))
    assert [(r.session_id, r.raw_text) for r in io.analysis_readings(a).collect()] == [("one", "12K")]
    assert sorted((r.session_id, r.frame_index, r.timestamp_ms, r.confidence) for r in io.analysis_hits(a).collect()) == [("one", 4, 0, 0.9), ("one", 7, 70, 0.9)]


def test_candidates(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"text": "12K", "frame": 1}, {"text": "x", "frame": 2, "timestamp_ms": 5, "confidence": 0.5}], indent=1))
    assert sorted((r.text, r.timestamp_ms, r.confidence) for r in io.read_candidates(spark, str(tmp_path / "c.json")).collect()) == [("12K", None, 0.0), ("x", 5, 0.5)]


def test_annotations(spark, tmp_path):
    good = {"session_id": "s1", "fps": 30.0, "hits": [{"frame": 1, "value": 5, "x": 1.0, "y": 2.0}, {"frame": 2, "value": 6, "x": 1.0, "y": 2.0, "damage_type": "crit"}]}
    (tmp_path / "benchmark_a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "benchmark_b.json").write_text("{ not json")
    (tmp_path / "other.json").write_text(json.dumps({**good, "session_id": "s2"}))
    ok, bad = io.read_annotations(spark, str(tmp_path))
    assert sorted((r.session_id, r.frame, r.damage_type, r.width, r.notes) for r in io.annotation_hits(ok).collect()) == [("s1", 1, "direct", 0, ""), ("s1", 2, "crit", 0, "")]
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["benchmark_b.json"]


def test_annotation_files_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a", f, 10 * f, 1.0, 2.0) for f in range(20)], "session_id string, frame int, value bigint, x double, y double")
    docs = io.nest_truth(t, part_frames=8)
    assert docs.count() == 3
    io.write_annotations(docs, str(tmp_path / "out"))
    ok, bad = io.read_annotations(spark, str(tmp_path / "out"), pattern="*.json", multi_line=False)
    assert sorted(r.frame for r in io.annotation_hits(ok).collect()) == list(range(20)) and bad.isEmpty()


def test_detection_log(spark, tmp_path):
    log = spark.sql("select 's' as session_id, 1 as frame_index, array(named_struct('text', 'a', 'confidence', 0.1D, 'reasons', array('r1', 'r2'))) as rejected")
    io.write_detection_log(log, str(tmp_path / "log"))
    back = io.read_detection_log(spark, str(tmp_path / "log"), "frame_index int, rejected array<struct<text:string,confidence:double,reasons:array<string>>>, session_id string")
    from emberlog.operators.stats import rejection_reasons

    assert sorted((r.reason, r.n) for r in rejection_reasons(back).collect()) == [("r1", 1), ("r2", 1)]


def test_baselines_replace_only_given_sessions(spark, tmp_path):
    path = str(tmp_path / "base")
    mk = lambda rows: spark.createDataFrame(rows, "session_id string, f1_score double, precision double, recall double, fps double")
    io.save_baselines(mk([("a", 0.5, 0.5, 0.5, 10.0), ("b", 0.6, 0.5, 0.5, 10.0)]), path)
    io.save_baselines(mk([("b", 0.9, 0.5, 0.5, 10.0)]), path)
    assert {r.session_id: r.f1_score for r in io.load_baselines(spark, path).collect()} == {"a": 0.5, "b": 0.9}


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("s", "| s | PASS |")], "session_id string, line string")
    io.write_markdown(rows, str(tmp_path / "md"))
    io.write_report(rows, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "md")).first()[0] == "| s | PASS |"
    assert spark.read.json(str(tmp_path / "json")).first().session_id == "s"


def test_inventory_and_skip(spark):
    frames = spark.createDataFrame([("a", i) for i in range(290)] + [("b", i) for i in range(10)], "session_id string, frame_index int")
    done = spark.createDataFrame([("a",)], "session_id string")
    out = {r.session_id: (r.frames, r.analysed, r.estimated_candidates, r.estimated_hits) for r in io.inventory(frames, done).collect()}
    assert out == {"a": (290, 1, 107, 29), "b": (10, 0, 3, 1), None: (300, 1, 110, 30)}
    assert [r[0] for r in io.unprocessed(frames, done).collect()] == ["b"]
    assert io.unprocessed(frames, done, force=True).count() == 2


def test_bucket_tables_are_replaced_by_key(spark, tmp_path):
    """NULL keys, keys that come and go, several versions; files follow the buckets, not the keys."""
    from emberlog.sources import buckets

    schema = "k string, v long"
    folder = str(tmp_path / "t")
    assert buckets.load_rows(spark, folder, schema).count() == 0
    buckets.replace_rows(spark.createDataFrame([(f"s{i}", i) for i in range(500)] + [(None, -1)], schema), folder, "k")
    buckets.replace_rows(spark.createDataFrame([("s3", 30), ("s3", 31), ("new", 7), (None, -2)], schema), folder, "k")
    buckets.replace_rows(spark.createDataFrame([], schema), folder, "k")
    found = sorted(((r.k, r.v) for r in buckets.load_rows(spark, folder, schema).collect()), key=str)
    assert found == sorted([(f"s{i}", i) for i in range(500) if i != 3] + [("s3", 30), ("s3", 31), ("new", 7), (None, -2)], key=str)
    assert len(list((tmp_path / "t/data/version=1").glob("bucket=*"))) <= 3


def test_detection_log_has_files_by_session_not_by_task(spark, tmp_path):
    log = spark.range(4000, numPartitions=8).selectExpr("id % 5 as session_id", "id as frame_index", "array(named_struct('reasons', array('r'))) as rejected")
    io.write_detection_log(log, str(tmp_path / "log"))
    assert [len(list(tmp_path.glob(f"log/session_id={s}/*.json"))) for s in range(5)] == [1] * 5
    back = io.read_detection_log(spark, str(tmp_path / "log"), log.schema)
    assert sorted(r.frame_index for r in back.collect()) == list(range(4000))
