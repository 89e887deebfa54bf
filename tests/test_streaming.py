"""Streaming twins over several micro-batches, with a late row."""

import json
import os

from pyspark.sql import functions as F

from emberlog.streaming import live


def write(folder, name, rows):
    cols = ["session_id", "frame_index", "timestamp_ms", "ordinal", "parsed_value", "confidence", "center_x", "center_y", "started_at_ms"]
    path = folder / name
    path.write_text("\n".join(json.dumps(dict(zip(cols, r))) for r in rows))
    # Files are taken in order of modification time.
    stamp = 1_700_000_000 + int(name.split(".")[0]) * 10
    os.utime(path, (stamp, stamp))


def source(spark, folder):
    return live.with_event_time(live.read_hits(spark, str(folder), files_per_batch=1), late="1 minute")


def test_unique_hits_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for f in range(3):
        write(src, f"{f}.json", [(1, f, f * 33, f, 1200, 0.9, 5.0, 5.0), (2, f, f * 33, 10 + f, 700 + 100 * f, 0.9, 5.0, 5.0)])
    live.run_unique(source(spark, src), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = live.finish_unique(spark, str(tmp_path / "out"))
    assert sorted((r.session_id, r.frame_index) for r in out.collect()) == [(1, 0), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_rows_out_of_order_are_judged_in_order(spark, tmp_path):
    """Frames arrive two steps late but above the watermark; only a row below it is lost, and counted."""
    src = tmp_path / "in"
    src.mkdir()
    row = lambda f, o, v: (1, f, f * 10_000, o, v, 0.9, 5.0, 5.0)
    write(src, "0.json", [row(1, 1, 1200), row(2, 2, 900)])
    write(src, "1.json", [row(0, 0, 1200), row(3, 3, 900)])
    write(src, "2.json", [row(30, 30, 700)])
    write(src, "3.json", [row(31, 31, 800), row(1, 99, 5000)])
    folder = str(tmp_path / "out")
    live.run_unique(source(spark, src), folder, str(tmp_path / "ck"), late_ms=60_000)
    kept = sorted((r.frame_index, r.ordinal) for r in live.finish_unique(spark, folder, late_ms=60_000).collect())
    assert kept == [(0, 0), (2, 2), (30, 30), (31, 31)]
    assert spark.read.parquet(f"{folder}/late").agg(F.sum("late")).first()[0] == 1


def test_stats_and_new_files_only(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "0.json", [(1, 0, 0, 0, 1000, 0.9, 0.0, 0.0), (1, 1, 1000, 1, 2000, 0.9, 0.0, 0.0)])

    def run():
        t = live.run_to_table(live.session_stats(source(spark, src)), str(tmp_path / "out"), str(tmp_path / "ck"), mode="update")
        return t.orderBy(F.desc("hit_count")).first()

    first = run()
    assert (first.total_damage, first.peak_hit, first.rolling_damage) == (3000, 2000, 3000)
    write(src, "1.json", [(1, 2, 7001, 2, 500, 0.9, 0.0, 0.0)])
    second = run()
    assert (second.total_damage, second.hit_count, second.last_hit, second.rolling_damage, second.rolling_dps) == (3500, 3, 500, 500, 100.0)


def test_late_rows_are_dropped(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda ms, o, v: (1, o, ms, o, v, 0.9, 0.0, 0.0)
    write(src, "0.json", [row(500, 0, 10), row(1500, 1, 20)])
    write(src, "1.json", [row(600_000, 2, 30)])
    # A watermark reached in one batch makes rows late from the batch after the next.
    write(src, "2.json", [row(620_000, 3, 5)])
    write(src, "3.json", [row(700, 4, 1_000_000), row(1_200_000, 5, 40)])
    assert timeline(spark, src, tmp_path) == {(1, 0): 10, (1, 1000): 20, (1, 600_000): 30, (1, 620_000): 5, (1, 1_200_000): 40}


def timeline(spark, src, tmp_path):
    hits = live.read_hits(spark, str(src), files_per_batch=1)
    out = live.run_to_table(live.dps_timeline(hits, late="1 minute"), str(tmp_path / "out"), str(tmp_path / "ck"), mode="update")
    return {(r.session_id, r.start_ms): r.damage for r in live.latest_buckets(out).collect()}


def test_sessions_with_clocks_of_their_own(spark, tmp_path):
    """A session that starts an hour into another one is neither late nor forgotten."""
    src = tmp_path / "in"
    src.mkdir()
    hour = 3_600_000
    row = lambda s, f, o, v, started: (s, f, f * 33, o, v, 0.9, 5.0, 5.0, started)
    write(src, "0.json", [row(1, 109_090, 0, 900, hour)])
    write(src, "1.json", [row(1, 109_100, 1, 950, hour), row(2, 0, 2, 1200, 2 * hour)])
    write(src, "2.json", [row(2, 1, 3, 1200, 2 * hour), row(3, 3, 4, 800, 2 * hour)])
    write(src, "3.json", [row(3, 33, 5, 700, 2 * hour), row(3, 2, 6, 650, 2 * hour)])
    live.run_unique(source(spark, src), str(tmp_path / "hits"), str(tmp_path / "ck1"), late_ms=60_000)
    found = live.finish_unique(spark, str(tmp_path / "hits"), late_ms=60_000)
    assert sorted((r.session_id, r.frame_index) for r in found.collect()) == [(1, 109_090), (1, 109_100), (2, 0), (3, 2), (3, 3), (3, 33)]
    late = spark.read.parquet(str(tmp_path / "hits/late"))
    assert late.agg(F.sum("late")).first()[0] == 0  # a frame behind its session, but above the watermark
    assert timeline(spark, src, tmp_path) == {(1, 3_599_000): 900, (1, 3_600_000): 950, (2, 0): 2400, (3, 0): 1450, (3, 1000): 700}


def test_statistics_expire_keep_a_log_and_null_sessions(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    hour = 3_600_000
    row = lambda s, o, ms, v: (s, o, ms, o, v, 0.9, 0.0, 0.0)
    write(src, "0.json", [row(1, 0, 0, 100), row(None, 1, 5, 7), row(None, 2, 6, 500)])
    write(src, "1.json", [row(2, 10 + i, 2 * hour + i, i) for i in range(60)])
    write(src, "2.json", [row(2, 80, 2 * hour + 60_000, 5)])
    write(src, "3.json", [row(1, 90, 2 * hour + 120_000, 30)])
    stats = live.session_stats(source(spark, src), idle_ms=hour)
    table = live.run_to_table(stats, str(tmp_path / "out"), str(tmp_path / "ck"), mode="update")
    rows = {(r.session_id, r.epoch): r for r in table.collect()}
    first = {s: r for (s, e), r in rows.items() if e == 0}
    assert (first[None].total_damage, first[None].peak_hit, first[None].hit_count) == (507, 500, 2)
    assert [x.parsed_value for x in first[None].log] == [7, 500]
    last = {s: r for (s, e), r in sorted(rows.items(), key=lambda x: x[0][1])}
    assert (last[2].hit_count, len(last[2].log), last[2].log[0].parsed_value, last[2].log[-1].parsed_value) == (61, 50, 11, 5)
    assert (last[1].hit_count, last[1].total_damage) == (1, 30)  # the first state of session 1 was gone


def test_kills_wait_for_late_cues_and_later_damage(spark, tmp_path):
    schema = "session_id bigint, frame int, timestamp_ms bigint, ordinal bigint, value bigint, center_x double, center_y double"
    cue_schema = "session_id bigint, cue_type string, frame int, timestamp_ms bigint, center_x double, center_y double, ordinal bigint"
    d = lambda f, o, v, x: (1, f, f * 33, o, v, x, 0.0)
    c = lambda f, o, x, kind="xp_orb": (1, kind, f, f * 33, x, 0.0, o)
    steps = [
        ([d(0, 0, 50, 0.0), d(2, 1, 70, 3.0), d(2, 2, 500, 900.0)], []),
        ([d(9, 3, 10, 4.0), d(200, 4, 5, 0.0)], [c(5, 5, 0.0), c(20, 6, 910.0, "sparkle")]),  # the cue of frame 5 is void: damage of frame 9 follows
        ([d(400, 7, 5, 0.0)], [c(30, 8, 10.0, "gold_drop"), c(400, 9, 5000.0)]),
        ([(2, 9999, 9_999_999, 10, 1, 0.0, 0.0)], [(2, "xp_orb", 9999, 9_999_999, 0.0, 0.0, 11)]),
    ]
    for n, (damage, cues) in enumerate(steps):
        spark.createDataFrame(damage, schema).coalesce(1).write.parquet(f"{tmp_path}/d/{n}")
        spark.createDataFrame(cues, cue_schema).coalesce(1).write.parquet(f"{tmp_path}/c/{n}")
        streams = [live.with_event_time(spark.readStream.schema(s).parquet(f"{tmp_path}/{name}/*"), late="10 seconds") for name, s in (("d", schema), ("c", cue_schema))]
        table = live.run_to_table(live.kill_events(*streams, idle_ms=60_000), f"{tmp_path}/out", f"{tmp_path}/ck")
    found = sorted((r.enemy_id, r.frame_index, r.total_damage, r.hits, r.cue_type) for r in table.collect())
    assert found == [(0, 30, 130, 3, "gold_drop"), (2, 20, 500, 1, "sparkle")]


def test_summaries_of_many_sessions_at_once():
    """A buffer of 20,000 sessions is one reduction; the rows are those of a pass over each session."""
    import random
    import time
    from collections import defaultdict

    import pyarrow as pa

    rng = random.Random(3)
    rows = [(rng.choice([None, s % 20_000, 0]), rng.randrange(90), rng.randrange(5), n, rng.randrange(1, 9), rng.randrange(99)) for n, s in enumerate(range(60_000))]
    names = ["session_id", "timestamp_ms", "frame_index", "ordinal", "parsed_value", "_event"]
    batches = [pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*rows[at : at + 10_000]))}) for at in range(0, len(rows), 10_000)]
    began = time.time()
    found = {r["session_id"]: r for r in live._summaries(batches, "session_id", 40, 3).to_pylist()}
    assert time.time() - began < 5
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(r)
    assert found.keys() == want.keys()
    for sid, own in want.items():
        r, last = found[sid], max(own, key=lambda x: (x[1], x[3]))
        assert (r["total"], r["hits"], r["peak"], r["newest"]) == (sum(x[4] for x in own), len(own), max(x[4] for x in own), max(x[5] for x in own))
        assert (r["last_ms"], r["last_ordinal"], r["last_value"]) == (last[1], last[3], last[4])
        assert [tuple(x.values()) for x in r["log"]] == [x[1:5] for x in sorted(own, key=lambda x: x[1:4])[-3:]]
        recent = defaultdict(int)
        for x in own:
            if x[1] >= last[1] - 40:
                recent[x[1]] += x[4]
        assert [(x["timestamp_ms"], x["damage"]) for x in r["window"]] == sorted(recent.items())
