"""Greedy operators against sequential passes of our own, cut into very short pieces."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import matching as mt, sequence as sq

SEEDS = range(10)


def merge(a, b):
    big, gap = max(a, b), abs(a - b)
    return a == b or (gap <= 5 if big < 1000 else gap / big <= (0.03 if big >= 1_000_000 else 0.015))


def readings(seed, n=120):
    r = random.Random(seed)
    out, f = [], 0
    for i in range(n):
        f += r.choice([0, 0, 1, 1, 2, 4, 9])
        out.append((seed, f, i, r.choice([500, 503, 905, 907, 2000, 2020, 8_000_000, 8_100_000]), round(r.uniform(0.5, 1.0), 2), float(r.randrange(0, 200, 10)), float(r.randrange(0, 200, 10))))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = [x for s in SEEDS for x in readings(s)]
    return spark.createDataFrame(rows, "session_id int, frame_index int, ordinal bigint, parsed_value bigint, confidence double, center_x double, center_y double")


def greedy(rows, fits, update):
    """id per row: the first live entry that fits, else a new one."""
    live, out = [], {}
    for s, f, o, v, c, x, y in rows:
        for e in live:
            if fits(e, f, v, x, y):
                update(e, f, v, c, x, y)
                out[o] = e["id"]
                break
        else:
            live.append({"id": o, "f": f, "v": v, "c": c, "x": x, "y": y})
            out[o] = o
    return out


def move(e, f, v, c, x, y):
    e.update(f=f, v=v, c=c, x=x, y=y)


def best(e, f, v, c, x, y):
    e["f"] = f
    if c > e["c"]:
        e.update(v=v, c=c, x=x, y=y)


def ids(df, name):
    out = {}
    for r in df.collect():
        out.setdefault(r.session_id, {})[r.ordinal] = r[name]
    return out


def dist(e, x, y):
    return math.hypot(x - e["x"], y - e["y"])


@pytest.mark.parametrize("span", [12, 16384])
def test_stable(data, span):
    got = ids(sq.stable_ids(data, span=span), "assigned")
    for s in SEEDS:
        rows = sorted((r for r in readings(s) if r[4] >= 0.6), key=lambda r: (r[1], -r[4], r[2]))
        want = greedy(rows, lambda e, f, v, x, y: merge(e["v"], v) and f - e["f"] <= 3 and abs(x - e["x"]) <= 70 and abs(y - e["y"]) <= 70, best)
        assert got[s] == want


@pytest.mark.parametrize("span", [9, 16384])
def test_tracks(data, span):
    got = ids(sq.vote_tracks(data, span=span), "track_id")
    for s in SEEDS:
        want = greedy(readings(s), lambda e, f, v, x, y: f - e["f"] <= 5 and dist(e, x, y) <= 70 and abs(v - e["v"]) / e["v"] <= 0.05, move)
        assert got[s] == want


@pytest.mark.parametrize("span", [70, 16384])
def test_enemies(data, span):
    d = data.select("session_id", F.col("frame_index").alias("frame"), (F.col("frame_index") * 33).cast("bigint").alias("timestamp_ms"), "ordinal", F.col("parsed_value").alias("value"), "center_x", "center_y")
    got = ids(sq.enemy_ids(d, span=span), "enemy_id")
    for s in SEEDS:
        assert got[s] == greedy(readings(s), lambda e, f, v, x, y: f - e["f"] < 60 and dist(e, x, y) < 100, move)


@pytest.mark.parametrize("span", [5, 16384])
def test_live_unique(data, span):
    kept = {}
    for r in sq.live_unique(data, span=span).collect():
        kept.setdefault(r.session_id, set()).add(r.ordinal)
    for s in SEEDS:
        want = greedy(readings(s), lambda e, f, v, x, y: f - e["f"] <= 1 and merge(e["v"], v) and abs(x - e["x"]) <= 45 and abs(y - e["y"]) <= 45, lambda *a: None)
        assert kept[s] == {o for o, i in want.items() if o == i}


def match(dets, truths):
    taken, out = set(), {}
    for s, f, o, v, c, x, y in dets:
        near = [(math.hypot(x - tx, y - ty), to) for to, tf, tv, tx, ty in truths if to not in taken and abs(f - tf) <= 3 and abs(v - tv) / tv <= 0.1 and math.hypot(x - tx, y - ty) <= 70]
        out[o] = min(near)[1] if near else None
        if near:
            taken.add(min(near)[1])
    return out


@pytest.mark.parametrize("span", [14, 16384])
def test_match(spark, data, span):
    truths = {s: [(o, f + o % 3 - 1, v, x + o % 20, y) for _, f, o, v, c, x, y in readings(s) if o % 2 == 0] for s in SEEDS}
    t = spark.createDataFrame([(s, *row) for s in SEEDS for row in truths[s]], "session_id int, ordinal bigint, frame int, value bigint, x double, y double")
    d = data.select("session_id", F.col("frame_index").alias("frame"), F.col("parsed_value").alias("value"), "center_x", "center_y", "ordinal")
    got = ids(mt.match_truth(d, t, span=span), "truth_ordinal")
    for s in SEEDS:
        assert got[s] == match(readings(s), truths[s])


@pytest.mark.parametrize("span", [4, 7, 8192])
@pytest.mark.parametrize("window", [1, 2, 5])
def test_spaced_keep(spark, data, span, window):
    out = {}
    for r in sq.spaced_keep(data, ["session_id", "parsed_value"], "frame_index", window, span).collect():
        out.setdefault((r.session_id, r.parsed_value), set()).add(r.frame_index)
    want = {}
    for s in SEEDS:
        for r in readings(s):
            k = want.setdefault((s, r[3]), [])
            if not k or r[1] - k[-1] > window:
                k.append(r[1])
    assert out == {k: set(v) for k, v in want.items()}


def test_small_cases(spark):
    schema = "session_id int, frame_index int, ordinal bigint, parsed_value bigint, confidence double, center_x double, center_y double"
    two = spark.createDataFrame([(1, 1, 1, 905, 0.7, 10.0, 10.0), (1, 2, 2, 907, 0.9, 12.0, 10.0), (2, 1, 3, 8_000_000, 0.8, 0.0, 0.0), (2, 1, 4, 9_000_000, 0.8, 0.0, 0.0)], schema)
    got = sorted((r.session_id, r.parsed_value, r.occurrences, r.first_frame, r.last_frame) for r in sq.stable_hits(two).collect())
    assert got == [(1, 907, 2, 1, 2), (2, 8_000_000, 1, 1, 1), (2, 9_000_000, 1, 1, 1)]
    seen = spark.createDataFrame([(1, f, f, 1200, 0.9, 5.0, 5.0) for f in range(3)], schema)
    assert sorted(r.frame_index for r in sq.live_unique(seen).collect()) == [0, 2]
    t = spark.createDataFrame([(1, 10, 1, 100, 0.0, 0.0)], "session_id int, frame int, ordinal bigint, value bigint, x double, y double")
    d = spark.createDataFrame([(1, 10, 1, 100, 1.0, 0.0), (1, 10, 2, 100, 0.0, 0.0)], "session_id int, frame int, ordinal bigint, value bigint, center_x double, center_y double")
    assert ids(mt.match_truth(d, t), "truth_ordinal") == {1: {1: 1, 2: None}}


def test_lines(spark):
    boxes = [(1, 1, 1, 10, 10, 20, 40), (1, 1, 2, 24, 12, 34, 40), (1, 1, 3, 300, 11, 320, 40), (1, 1, 4, 12, 200, 30, 230)]
    df = spark.createDataFrame([(*b, 100) for b in boxes], "session_id int, frame_index int, ordinal bigint, left int, top int, right int, bottom int, pixel_count int")
    out = {r.line_id: (r.left, r.right, r.member_count, r.pixel_count) for r in sq.group_lines(df).collect()}
    assert out == {1: (10, 34, 2, 200), 3: (300, 320, 1, 100), 4: (12, 30, 1, 100)}


def test_crowded_session_is_cut(spark, data):
    """A low row target per piece shortens the pieces; the answer stays the same."""
    from emberlog.operators.chained import _piece_spans, chained_scan
    from emberlog.operators.sequence import _Nearby

    spans, whole = _piece_spans(data, ["session_id"], "frame_index", 5, 16384, 20)
    assert whole is False and spans.agg(F.max("_span")).first()[0] < 100
    fields = ["ordinal", "frame_index", "parsed_value", "confidence", "center_x", "center_y"]
    cut = chained_scan(data, ["session_id"], "frame_index", ["ordinal"], fields, 5, _Nearby("track", 70.0), rows_per_piece=20)
    assert ids(cut, "assigned") == ids(sq.vote_tracks(data), "track_id")


def test_nulls_are_treated_alike_whatever_the_span(spark):
    """A NULL session is a session; a row without a frame is kept but joins no chain."""
    r = random.Random(11)
    rows = [(None if i % 4 == 0 else i % 3, None if i % 17 == 0 else r.randrange(150), i, 1200, 0.9, float(r.randrange(100)), 5.0) for i in range(200)]
    frame = spark.createDataFrame(rows, "session_id int, frame_index int, ordinal bigint, parsed_value bigint, confidence double, center_x double, center_y double")
    found = [sorted(((x.ordinal, x.track_id) for x in sq.vote_tracks(frame, window=3, span=span).collect()), key=lambda p: p[0]) for span in (16384, 12)]
    assert len(found[0]) == 200 and found[0] == found[1]
    assert all((track is None) == (ordinal % 17 == 0) for ordinal, track in found[0])


@pytest.mark.parametrize("pieces", [20, 200, 2000])
def test_an_enemy_that_outlives_all_pieces(spark, monkeypatch, pieces):
    """One enemy hit in every frame beside short-lived ones: rounds grow with the logarithm of the pieces."""
    from emberlog.operators import chained

    written = []
    cut = chained.cut_lineage
    monkeypatch.setattr(chained, "cut_lineage", lambda df: written.append(1) or cut(df))
    frames = pieces * 8
    hits = spark.range(frames).select(F.lit(1).alias("session_id"), F.col("id").cast("int").alias("frame"), (F.col("id") * 2).alias("ordinal"), F.lit(10.0).alias("center_x"))
    others = spark.range(0, frames, 50).select(F.lit(1).alias("session_id"), F.col("id").cast("int").alias("frame"), (F.col("id") * 2 + 1).alias("ordinal"), (F.col("id") + 1000.0).alias("center_x"))
    rows = hits.unionByName(others).withColumns({"value": F.lit(5).cast("bigint"), "center_y": F.lit(0.0)})
    found = sq.enemy_ids(rows, window=7, span=8)
    n, one, least = found.agg(F.count("*"), F.count_if(F.col("enemy_id") == 0), F.min(F.col("enemy_id") == F.when(F.col("ordinal") % 2 == 0, 0).otherwise(F.col("ordinal")))).first()
    assert n == frames + -(-frames // 50) and one == frames and least
    scans_and_tables = 2 + 3 * 2 + 1  # rows, first scan and states, two rounds of three tables
    assert len(written) <= scans_and_tables + math.log2(pieces) + 3


def test_few_pieces_are_scanned_again(spark, monkeypatch):
    """State goes from piece to piece inside a task, so only runs cut between two tasks are scanned again; ids are those of whole sessions."""
    from emberlog.operators import chained

    written, cut = [], chained.cut_lineage

    def counting(df):
        out = cut(df)
        if {chained.REF, chained.SLOT} <= set(out.columns):  # scans and states; rows of scans have no slot
            written.append(out.filter((F.col(chained.SLOT) < 0) & F.col(chained.ASSIGNED).isNotNull()).count())
        return out

    monkeypatch.setattr(chained, "cut_lineage", counting)
    r = random.Random(5)
    rows = [(s, f, s * 1000 + f, 7, float(r.randrange(0, 300, 10)), float(r.randrange(0, 300, 10))) for s in range(60) for f in range(200)]
    hits = spark.createDataFrame(rows, "session_id int, frame int, ordinal bigint, value bigint, center_x double, center_y double")
    whole = {x.ordinal: x.enemy_id for x in sq.enemy_ids(hits, window=10).collect()}
    assert not written
    pieces = {x.ordinal: x.enemy_id for x in sq.enemy_ids(hits, window=10, span=10).collect()}
    assert pieces == whole and len(pieces) == len(rows)
    scans = [n for n in written if n]
    assert scans[0] == len(rows) and sum(scans[1:]) < len(rows) // 4


def test_rows_of_a_scan_are_shuffled_and_written_once(spark, monkeypatch):
    """Of long frames cut into short pieces, the rows of frames cut between two tasks alone are written or shuffled again."""
    from emberlog.operators import chained

    written, cut = [], chained.cut_lineage

    def counting(df):
        out = cut(df)
        if chained.SLOT in out.columns:
            shuffles = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")
            written.append((out.filter(F.col(chained.SLOT) < 0).count(), shuffles))
        return out

    monkeypatch.setattr(chained, "cut_lineage", counting)
    r = random.Random(7)
    rows = []
    for i in range(6000):
        left, top = r.randrange(0, 300), r.randrange(0, 120)
        rows.append((i // 640, i // 10, i, left, top, left + r.randrange(20, 110), top + r.randrange(12, 72), r.randrange(40, 2000)))
    boxes = spark.createDataFrame(rows, "session_id int, frame_index int, ordinal bigint, left int, top int, right int, bottom int, pixel_count int")
    whole = {(x.frame_index, x.line_id): tuple(x) for x in sq.group_lines(boxes, max_h=40).collect()}
    assert not written
    found = sq.group_lines(boxes, max_h=40, span=24)
    assert {(x.frame_index, x.line_id): tuple(x) for x in found.collect()} == whole
    assert sum(n for n, _ in written) < len(rows) * 1.2
    assert [shuffles for n, shuffles in written if n >= len(rows)] == [0]  # one range partitioning


def test_a_frame_of_a_hundred_thousand_points(spark):
    """Pairs in reach only: without cells the frames' points would make ten thousand million."""
    n = 100_000
    points = spark.range(n).select(F.lit(1).alias("session_id"), (F.col("id") % 2).cast("int").alias("frame_index"), F.col("id").alias("ordinal"))
    place = lambda seed: (F.pmod(F.xxhash64(F.lit(seed), "ordinal"), F.lit(20_000))).cast("double")
    rows = points.withColumns({"center_x": place(1), "center_y": place(2)})
    found = mt.temporal_support(rows, reach=80.0).toPandas().set_index("ordinal")
    import numpy as np

    a, b = (found[found.frame_index == f] for f in (0, 1))
    for r in a.iloc[:: len(a) // 20].itertuples():
        d = np.hypot(b.center_x - r.center_x, b.center_y - r.center_y)
        assert abs(r.support - (1 - d[d <= 80] / 160).sum()) < 1e-9


@pytest.mark.parametrize("name", ["c8_group_lines", "c8_group_lines_short_pieces"])
def test_boxes_of_one_ordinal_are_boxes_of_their_own(spark, tmp_path, name):
    """Two boxes of a frame share order, line number and price, and so the ordinal; each is in one line, which is its own."""
    import __spark_entry__ as entry
    from tests.oracle_check import compare, connect

    rows = [(1, 10, 5, 2, 10.0, 99.5), (1, 40, 5, 2, 20.0, 99.5), (1, 12, 5, 3, 5.0, 7.0), (1, 10, 5, 4, 1.0, 7.5), (2, 10, 5, 2, 10.0, 99.5), (2, 10, 5, 2, 10.0, 99.5)]
    table = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double")
    table.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    out = entry.queries()[name](spark, str(tmp_path))
    found = out.collect()
    assert sum(r.member_count for r in found) == 6 and sum(r.pixel_count for r in found) == 40 * 56
    assert sorted(r.line_id for r in found if r.frame_index == 1).count(10 * 10**8 + 9950) == 2
    ok, note = compare(out, con, entry.oracle_sql()[name])
    assert ok, note


def test_best_lines_look_boxes_up_by_ordinal(spark, tmp_path):
    """Two boxes of one ordinal apart, two in one line, and two that open lines: each counts for the lines of both, as in the SQL."""
    import __spark_entry__ as entry
    from tests.oracle_check import compare, connect

    rows = [
        (1, 10, 5, 2, 10.0, 99.5), (1, 28, 5, 2, 20.0, 99.5), (1, 12, 5, 3, 5.0, 7.0), (1, 29, 5, 4, 30.0, 7.5),  # apart, each beside another box
        (2, 10, 5, 2, 10.0, 99.5), (2, 12, 6, 2, 20.0, 99.5), (3, 10, 5, 2, 40.0, 99.5), (4, 10, 5, 2, 10.0, 1.0), (4, 12, 5, 2, 20.0, 2.0),
        (5, 90, 10, 1, 30.0, 5.0), (5, 95, 10, 1, 31.0, 5.0), (5, 90, 10, 1, 30.0, 5.0),
    ]
    table = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double")
    table.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    out = entry.queries()["c9_best_lines"](spark, str(tmp_path))
    ok, note = compare(out, con, entry.oracle_sql()["c9_best_lines"])
    assert ok, note
    assert "TYPES" not in note, note


def test_suffix_hints_listed_and_in_cells(spark):
    """Frames below and above the crowd limit, lines without a frame and lines that share an ordinal; listed hints take one shuffle."""
    rng = random.Random(5)
    rows = []
    for n in range(600):
        left, top = rng.randrange(900), rng.randrange(90)
        rows.append((1, rng.choice([1, 1, 2, 3, 4, None]), n - n % 50 // 49, left, top, left + rng.randrange(10, 240), top + rng.randrange(10, 140), rng.choice(["K", "m", "B", "12", "7.5", "x", None])))
    df = spark.createDataFrame(rows, "session_id int, frame_index int, ordinal bigint, left int, top int, right int, bottom int, text string")
    want = []
    for s, f, o, left, top, right, bottom, text in rows:
        best = []
        for a in rows:
            if text in ("12", "7.5") and f is not None and a[1] == f and a[2] == o and a[7] in ("12", "7.5"):
                for b in rows:
                    gap, tall = b[3] - a[5] - 1, max(a[6] - a[4], b[6] - b[4]) + 1
                    if b[1] == f and b[7] in ("K", "m", "B") and b[5] - b[3] < 200 and b[6] - b[4] < 120 and 0 <= gap <= 120 and abs((a[4] + a[6]) / 2 - (b[4] + b[6]) / 2) <= tall * 0.55:
                        best.append((gap, b[2], b[7].upper()))
        want.append((f, o, left, None if text is None else text.upper() + (min(best)[2] if best else "")))
    for crowd in (1, 40, 10_000):
        out = mt.suffix_hints(df, crowd=crowd).select("frame_index", "ordinal", "left", "completed")
        assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
