"""Order-dependent operators and joins (K, J, W6-W7, C8, C10 rows).

The comparison SQL of a greedy operator folds the ordered rows of a session with
``list_reduce``; it is quadratic per session, which the comparison scale allows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import matching as mt, sequence as sq, stats as st
from emberlog.plans import adapters as ad
from emberlog.plans.catalog_stats import DAY, HOUR, RATES_SQL
from emberlog.plans.catalog_text import BATCH_READY_SQL, LINE_SCORE_SQL
from emberlog.functions import geometry as geo
from emberlog.plans.registry import ORACLE, query

_ENTRY = "STRUCT(id BIGINT, f BIGINT, v BIGINT, c DOUBLE, x DOUBLE, y DOUBLE)"


def fold_sql(source: str, order: str, cond: str, update: str) -> str:
    """Relation (session_id, ordinal, assigned): first live entry with ``cond`` takes the row."""
    empty = f"{{'st': CAST([] AS {_ENTRY}[]), 'r': CAST(NULL AS {_ENTRY}), 'o': CAST([] AS BIGINT[])}}"
    row = f"{{'st': CAST([] AS {_ENTRY}[]), 'r': CAST({{'id': ordinal, 'f': f, 'v': v, 'c': c, 'x': x, 'y': y}} AS {_ENTRY}), 'o': CAST([] AS BIGINT[])}}"
    return f"""(SELECT session_id, unnest(ids) AS ordinal, unnest(z.o) AS assigned FROM (
      SELECT session_id, ids, list_reduce(list_prepend({empty}, l), lambda a, n: list_transform(
        [coalesce(list_position(list_transform(a.st, lambda e: {cond}), true), 0)], lambda i: CASE WHEN i = 0
          THEN {{'st': list_append(a.st, n.r), 'r': n.r, 'o': list_append(a.o, n.r.id)}}
          ELSE {{'st': list_transform(a.st, lambda e, j: CASE WHEN j = i THEN {update} ELSE e END), 'r': n.r, 'o': list_append(a.o, a.st[i].id)}} END)[1]) AS z
      FROM (SELECT session_id, list({row} ORDER BY {order}) AS l, list(ordinal ORDER BY {order}) AS ids FROM {source} GROUP BY 1)))"""


_HIT_ROWS = "(SELECT session_id, ordinal, CAST(frame_index AS BIGINT) AS f, parsed_value AS v, confidence AS c, center_x AS x, center_y AS y FROM hits{where})"
_MERGE = """(n.r.v = e.v OR (greatest(n.r.v, e.v) < 1000 AND abs(n.r.v - e.v) <= 5) OR (greatest(n.r.v, e.v) >= 1000000 AND abs(n.r.v - e.v) / greatest(n.r.v, e.v) <= 0.03e0)
    OR (greatest(n.r.v, e.v) BETWEEN 1000 AND 999999 AND abs(n.r.v - e.v) / greatest(n.r.v, e.v) <= 0.015e0))"""
_MOVE = "{'id': e.id, 'f': n.r.f, 'v': n.r.v, 'c': n.r.c, 'x': n.r.x, 'y': n.r.y}"
_BEST = "{'id': e.id, 'f': n.r.f, 'v': CASE WHEN n.r.c > e.c THEN n.r.v ELSE e.v END, 'c': greatest(n.r.c, e.c), 'x': CASE WHEN n.r.c > e.c THEN n.r.x ELSE e.x END, 'y': CASE WHEN n.r.c > e.c THEN n.r.y ELSE e.y END}"
STABLE_IDS = fold_sql(_HIT_ROWS.format(where=" WHERE confidence >= 0.6e0"), "f, -c, ordinal", f"{_MERGE} AND n.r.f - e.f <= 3 AND abs(n.r.x - e.x) <= 70 AND abs(n.r.y - e.y) <= 70", _BEST)
LIVE_IDS = fold_sql(_HIT_ROWS.format(where=""), "f, ordinal", f"{_MERGE} AND n.r.f - e.f <= 1 AND abs(n.r.x - e.x) <= 45 AND abs(n.r.y - e.y) <= 45", "e")
_TRACK_COND = "n.r.f - e.f <= 5 AND sqrt((n.r.x - e.x) ** 2 + (n.r.y - e.y) ** 2) <= 70 AND (e.v <= 0 OR abs(n.r.v - e.v) / e.v <= 0.05e0)"
TRACK_IDS = fold_sql(_HIT_ROWS.format(where=""), "f, ordinal", _TRACK_COND, _MOVE)
ENEMY_IDS = fold_sql(
    "(SELECT session_id, ordinal, CAST(frame AS BIGINT) AS f, value AS v, 0e0 AS c, center_x AS x, center_y AS y FROM damage)", "f, ordinal",
    "n.r.f - e.f < 60 AND sqrt((n.r.x - e.x) ** 2 + (n.r.y - e.y) ** 2) < 100", _MOVE,
)


@query(
    "k1_dedupe_values",
    """WITH RECURSIVE d AS (SELECT DISTINCT session_id, parsed_value AS value, frame_index AS frame FROM hits),
       k AS (SELECT session_id, value, min(frame) AS frame FROM d GROUP BY 1, 2 UNION ALL
       SELECT k.session_id, k.value, min(d.frame) FROM k JOIN d ON d.session_id = k.session_id AND d.value = k.value AND d.frame > k.frame + 2 GROUP BY 1, 2) SELECT * FROM k""",
    ["hits"],
)
def _(spark, sf):
    events = ad.hits(spark, sf).select("session_id", F.col("parsed_value").alias("value"), F.col("frame_index").alias("frame"))
    out = sq.dedupe_values(events, window=2)
    return out.withColumn("frame", F.col("frame").cast("int"))


def stable(spark, sf):
    return sq.stable_hits(ad.hits(spark, sf))


STABLE_SQL = f"""(SELECT session_id, assigned AS hit_id, arg_max(parsed_value, (confidence, -frame_index, -ordinal)) AS parsed_value, max(confidence) AS confidence,
    arg_max(center_x, (confidence, -frame_index, -ordinal)) AS center_x, arg_max(center_y, (confidence, -frame_index, -ordinal)) AS center_y,
    arg_min(timestamp_ms, (frame_index, -confidence, ordinal)) AS timestamp_ms, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS occurrences
    FROM hits JOIN {STABLE_IDS} USING (session_id, ordinal) GROUP BY 1, 2)"""


@query("k2_stable_hits", f"SELECT *, first_frame AS frame_index FROM {STABLE_SQL}", ["hits"])
def _(spark, sf):
    return stable(spark, sf)


@query(
    "a27_dedupe_summary",
    f"SELECT session_id, count(*) AS stable_hit_count, count(*) FILTER (occurrences > 1) AS repeated_hit_count, max(occurrences) AS max_occurrences FROM {STABLE_SQL} GROUP BY 1",
    ["hits"],
)
def _(spark, sf):
    return sq.dedupe_summary(stable(spark, sf))


@query("k3_live_unique", f"SELECT h.session_id, ordinal, frame_index, parsed_value FROM hits h JOIN {LIVE_IDS} USING (session_id, ordinal) WHERE assigned = ordinal", ["hits"])
def _(spark, sf):
    return sq.live_unique(ad.hits(spark, sf)).select("session_id", "ordinal", "frame_index", "parsed_value")


def tracked(spark, sf):
    return sq.vote_tracks(ad.hits(spark, sf))


@query("k4_vote_tracks", f"SELECT session_id, ordinal, assigned AS track_id FROM {TRACK_IDS}", ["hits"])
def _(spark, sf):
    return tracked(spark, sf).select("session_id", "ordinal", "track_id")


_VOTING_SQL = f"""WITH v AS (SELECT h.session_id, h.ordinal, frame_index, parsed_value, confidence, center_x, center_y, assigned AS track_id FROM hits h JOIN {TRACK_IDS} t ON t.session_id = h.session_id AND t.ordinal = h.ordinal),
    f AS (SELECT DISTINCT session_id, frame_index FROM v),
    s AS (SELECT f.session_id, f.frame_index, v.track_id, count(*) AS vote_count, arg_max({{'p': v.parsed_value, 'c': v.confidence, 'x': v.center_x, 'y': v.center_y, 'f': v.frame_index}}, (v.confidence, -v.frame_index, -v.ordinal)) AS b
      FROM f JOIN v ON v.session_id = f.session_id AND v.frame_index BETWEEN f.frame_index - 5 AND f.frame_index GROUP BY 1, 2, 3),
    t AS (SELECT s.session_id, s.frame_index, s.track_id, count(*) AS total_votes FROM s JOIN v ON v.session_id = s.session_id AND v.track_id = s.track_id AND v.frame_index <= s.frame_index GROUP BY 1, 2, 3)
    SELECT session_id, frame_index, track_id, b.f AS vote_frame, b.p AS parsed_value, b.x AS center_x, b.y AS center_y, vote_count, total_votes,
    round(CASE WHEN vote_count >= 2 THEN least(b.c + 0.15e0, 1e0) ELSE b.c END, 6) AS confidence, round(vote_count / total_votes, 6) AS agreement_ratio FROM s JOIN t USING (session_id, frame_index, track_id)"""


@query("k5_voting_hits", _VOTING_SQL, ["hits"])
def _(spark, sf):
    return sq.voting_hits(tracked(spark, sf))


def enemy(spark, sf):
    return sq.enemies(sq.enemy_ids(ad.damage(spark, sf)))


_ENEMY_SQL = f"""(SELECT d.session_id, assigned AS enemy_id, CAST(sum(value) AS BIGINT) AS total_damage, count(*) AS hits, min(frame) AS first_frame, max(frame) AS last_frame,
    arg_max(timestamp_ms, (frame, d.ordinal)) AS last_ms, arg_max(value, (frame, d.ordinal)) AS final_hit, arg_max(center_x, (frame, d.ordinal)) AS x, arg_max(center_y, (frame, d.ordinal)) AS y
    FROM damage d JOIN {ENEMY_IDS} e ON e.session_id = d.session_id AND e.ordinal = d.ordinal GROUP BY 1, 2)"""


@query("k6_enemies", f"SELECT * FROM {_ENEMY_SQL}", ["damage"])
def _(spark, sf):
    return enemy(spark, sf)


KILL_MS = 24 * HOUR
_PAIR_SQL = f"""(SELECT e.session_id, enemy_id, e.total_damage, e.hits, final_hit, x, y, c.cue_type, c.timestamp_ms AS cue_ms, min(c.frame) AS cue_frame, min(c.ordinal) AS cue_ordinal
    FROM {_ENEMY_SQL} e JOIN cues c ON c.session_id = e.session_id AND c.timestamp_ms > last_ms AND c.timestamp_ms <= last_ms + {KILL_MS}
    AND sqrt((c.center_x - x) ** 2 + (c.center_y - y) ** 2) < 50 GROUP BY ALL)"""
_KILL_SQL = f"""(SELECT session_id, enemy_id, cue_ms AS timestamp_ms, cue_frame AS frame_index, total_damage, hits, final_hit, x, y, kill_signal,
    round(CASE WHEN hits >= 3 THEN least(base + 0.05, 1) ELSE base END, 6) AS confidence FROM (SELECT *, CASE WHEN total_damage < 100 THEN 0.5 ELSE 1 END *
      CASE kill_signal WHEN 'xp_orb' THEN 0.95e0 WHEN 'gold_drop' THEN 0.9e0 WHEN 'item_drop' THEN 0.85e0 WHEN 'death_animation' THEN 0.9e0 ELSE 0.6e0 END AS base
    FROM (SELECT *, CASE WHEN cue_type = 'sparkle' THEN 'damage_cessation' ELSE cue_type END AS kill_signal,
      row_number() OVER (PARTITION BY session_id, enemy_id ORDER BY cue_ms, cue_ordinal) AS rn FROM {_PAIR_SQL}) WHERE rn = 1))"""


@query("j8_cue_pairs", f"SELECT session_id, enemy_id, cue_type, cue_ms, cue_ordinal FROM {_PAIR_SQL}", ["damage", "cues"])
def _(spark, sf):
    return sq.cue_pairs(enemy(spark, sf), ad.cues(spark, sf), within_ms=KILL_MS).select("session_id", "enemy_id", "cue_type", "cue_ms", "cue_ordinal")


@query("k7_kills", f"SELECT * FROM {_KILL_SQL}", ["damage", "cues"])
def _(spark, sf):
    return sq.kills(enemy(spark, sf), ad.cues(spark, sf), within_ms=KILL_MS)


@query(
    "a18_kill_statistics",
    f"""SELECT session_id, count(kill_signal) AS total_kills, CAST(coalesce(sum(k.total_damage), 0) AS BIGINT) AS total_damage, coalesce(max(k.total_damage), 0) AS biggest_kill,
        {', '.join(f"count(*) FILTER (kill_signal = '{s}') AS {s}" for s in sq.SIGNAL_CONFIDENCE)},
        coalesce(round(sum(k.total_damage) / count(kill_signal), 6), 0) AS average_damage_per_kill, round(count(kill_signal) / max(minutes), 6) AS kills_per_minute
        FROM (SELECT session_id, CASE WHEN max(timestamp_ms) > min(timestamp_ms) THEN (max(timestamp_ms) - min(timestamp_ms)) / 60000e0 ELSE 1 END AS minutes FROM damage GROUP BY 1) LEFT JOIN {_KILL_SQL} k USING (session_id) GROUP BY 1""",
    ["damage", "cues"],
)
def _(spark, sf):
    return sq.kill_statistics(sq.kills(enemy(spark, sf), ad.cues(spark, sf), within_ms=KILL_MS), ad.damage(spark, sf))


_SPAWN_SQL = """r AS (SELECT session_id, frame_index, arg_min({'x': center_x, 'y': center_y, 'o': ordinal}, ordinal) AS s FROM
    (SELECT *, lag(center_y) OVER (PARTITION BY session_id ORDER BY frame_index, ordinal) AS py FROM hits) WHERE center_y < py GROUP BY 1, 2),
    k AS (SELECT session_id, min(frame_index) AS frame_index FROM r GROUP BY 1 UNION ALL
    SELECT k.session_id, min(r.frame_index) FROM k JOIN r ON r.session_id = k.session_id AND r.frame_index > k.frame_index + 5 GROUP BY 1),
    spawns AS (SELECT session_id, frame_index, s.x AS center_x, s.y AS center_y, s.o AS ordinal FROM r JOIN k USING (session_id, frame_index))"""


@query("w6_spawn_points", f"WITH RECURSIVE {_SPAWN_SQL} SELECT * FROM spawns", ["hits"])
def _(spark, sf):
    return sq.spawn_points(ad.hits(spark, sf))


@query(
    "w7_spawn_region",
    f"""WITH RECURSIVE {_SPAWN_SQL} SELECT n.session_id, CASE WHEN ok THEN greatest(0, x0 - 50) ELSE 288 END::DOUBLE AS "left", CASE WHEN ok THEN greatest(0, y0 - 50) ELSE 54 END::DOUBLE AS top,
        CASE WHEN ok THEN least(1920, x1 + 50) ELSE 1632 END::DOUBLE AS "right", CASE WHEN ok THEN least(1080, y1 + 50) ELSE 540 END::DOUBLE AS bottom FROM
        (SELECT h.session_id, n >= 600 AND x0 IS NOT NULL AS ok, x0, y0, x1, y1 FROM (SELECT session_id, count(*) AS n FROM hits GROUP BY 1) h LEFT JOIN
        (SELECT session_id, min(center_x) AS x0, min(center_y) AS y0, max(center_x) AS x1, max(center_y) AS y1 FROM spawns GROUP BY 1) b USING (session_id)) n""",
    ["hits"],
)
def _(spark, sf):
    h = ad.hits(spark, sf)
    return sq.spawn_region(h, sq.spawn_points(h), least=600)


# --- joins -----------------------------------------------------------------------------------


def lines(spark, sf):
    """Ready lines: hits with a score."""
    return ad.hits(spark, sf).select("session_id", "frame_index", "ordinal", "center_x", "center_y", (F.col("ordinal") % 13).cast("double").alias("score"))


_SUPPORT_SQL = """(SELECT l.session_id, l.frame_index, l.ordinal, l.center_x, l.center_y, (l.ordinal % 13)::DOUBLE AS score, coalesce(sum(1 - d / 80 * 0.5), 0) AS support FROM hits l LEFT JOIN LATERAL
    (SELECT sqrt((o.center_x - l.center_x) ** 2 + (o.center_y - l.center_y) ** 2) AS d FROM hits o WHERE o.session_id = l.session_id AND o.frame_index <> l.frame_index
     AND o.frame_index BETWEEN l.frame_index - 2 AND l.frame_index + 2) o ON d <= 80 GROUP BY ALL)"""


@query("j1_temporal_support", f"SELECT session_id, ordinal, round(support, 6) AS support FROM {_SUPPORT_SQL}", ["hits"])
def _(spark, sf):
    return mt.temporal_support(lines(spark, sf)).select("session_id", "ordinal", F.round("support", 6).alias("support"))


@query(
    "j2_seed_expansion",
    f"""WITH s AS MATERIALIZED {_SUPPORT_SQL}, n AS (SELECT session_id, least(greatest(12, count(*) // 4), 48) AS k FROM s GROUP BY 1),
        seeds AS (SELECT * FROM (SELECT s.*, k, row_number() OVER (PARTITION BY session_id ORDER BY round(score + support * 1.5, 9) DESC, frame_index, ordinal) - 1 AS pos FROM s JOIN n USING (session_id)) WHERE pos < k),
        p AS (SELECT a.session_id, a.pos, a.score AS ss, a.support AS su, a.frame_index AS sf, b.ordinal, b.frame_index, b.score, b.support, sqrt((a.center_x - b.center_x) ** 2 + (a.center_y - b.center_y) ** 2) AS d
          FROM seeds a JOIN s b ON a.session_id = b.session_id AND b.frame_index BETWEEN a.frame_index - 2 AND a.frame_index + 2),
        q AS (SELECT *, row_number() OVER (PARTITION BY session_id, pos, frame_index ORDER BY d, score DESC, ordinal) - 1 AS fr FROM p WHERE d <= 80),
        m AS (SELECT session_id, ordinal, frame_index, score, round(max(ss * 2 + su * 1.5 + score + support - abs(frame_index - sf) * 0.75 - d / 80 - fr * 0.25 - pos * 0.05), 6) AS selection_rank FROM q WHERE fr < 2 GROUP BY ALL)
        SELECT session_id, ordinal, frame_index, selection_rank, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY selection_rank DESC, frame_index, score DESC, ordinal) AS rn FROM m) WHERE rn <= 50""",
    ["hits"],
)
def _(spark, sf):
    return mt.seed_expansion(mt.temporal_support(lines(spark, sf))).select("session_id", "ordinal", "frame_index", "selection_rank", "rank")


_TRUTH_ENTRY = "STRUCT(id BIGINT, f BIGINT, v BIGINT, x DOUBLE, y DOUBLE)"


def match_sql(det: str, tru: str, keys: str, frames: int) -> str:
    """Relation (keys, ordinal, truth_ordinal) folding detections over the unmatched truths of a key."""
    none = f"CAST(NULL AS {_TRUTH_ENTRY})"
    return f"""(SELECT {keys}, unnest(ids) AS ordinal, unnest(z.o) AS truth_ordinal FROM (
      SELECT {keys}, ids, list_reduce(list_prepend({{'st': coalesce(t.tl, CAST([] AS {_TRUTH_ENTRY}[])), 'r': {none}, 'o': CAST([] AS BIGINT[])}}, l), lambda a, n: list_transform(
        [list_sort(list_transform(list_filter(a.st, lambda e: abs(n.r.f - e.f) <= {frames} AND (CASE WHEN e.v = 0 THEN n.r.v = 0 ELSE abs(n.r.v - e.v) / e.v <= 0.1e0 END)
            AND sqrt((n.r.x - e.x) ** 2 + (n.r.y - e.y) ** 2) <= 70), lambda e: {{'d': sqrt((n.r.x - e.x) ** 2 + (n.r.y - e.y) ** 2), 'id': e.id}}))[1].id],
        lambda i: {{'st': CASE WHEN i IS NULL THEN a.st ELSE list_filter(a.st, lambda e: e.id <> i) END, 'r': n.r, 'o': list_append(a.o, i)}})[1]) AS z
      FROM (SELECT {keys}, list({{'st': CAST([] AS {_TRUTH_ENTRY}[]), 'r': CAST({{'id': ordinal, 'f': frame, 'v': value, 'x': center_x, 'y': center_y}} AS {_TRUTH_ENTRY}), 'o': CAST([] AS BIGINT[])}} ORDER BY frame, ordinal) AS l,
        list(ordinal ORDER BY frame, ordinal) AS ids FROM {det} GROUP BY ALL) d
      LEFT JOIN (SELECT {keys}, list(CAST({{'id': ordinal, 'f': frame, 'v': value, 'x': x, 'y': y}} AS {_TRUTH_ENTRY}) ORDER BY ordinal) AS tl FROM {tru} GROUP BY ALL) t USING ({keys})))"""


def counts_sql(matched: str, tru: str, keys: str) -> str:
    return f"""(SELECT {keys}, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n, 0) - coalesce(tp, 0) AS fn FROM
        (SELECT {keys}, count(truth_ordinal) AS tp, count(*) - count(truth_ordinal) AS fp FROM {matched} GROUP BY ALL) FULL JOIN
        (SELECT {keys}, count(*) AS n FROM {tru} GROUP BY ALL) USING ({keys}))"""


ACC_SQL = "round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS accuracy"
MATCH_SQL = match_sql("detections", "truth", "session_id", 3)


@query("j3_match_truth", f"SELECT session_id, ordinal, truth_ordinal FROM {MATCH_SQL}", ["detections", "truth"])
def _(spark, sf):
    return mt.match_truth(ad.detections(spark, sf), ad.truth(spark, sf)).select("session_id", "ordinal", "truth_ordinal")


@query(
    "j3_candidate_pairs",
    """SELECT d.session_id, d.ordinal, count(*) AS candidates FROM detections d JOIN truth t ON d.session_id = t.session_id AND abs(d.frame - t.frame) <= 3
       AND abs(d.value - t.value) / t.value <= 0.1 AND sqrt((d.center_x - t.x) ** 2 + (d.center_y - t.y) ** 2) <= 70 GROUP BY ALL""",
    ["detections", "truth"],
)
def _(spark, sf):
    from emberlog.functions.scoring import within_share
    from emberlog.operators.places import by_cell
    from emberlog.operators.timeline import near_frames

    d = ad.detections(spark, sf)
    t = ad.truth(spark, sf).groupBy("session_id", F.col("frame").alias("tf"), F.col("value").alias("tv"), "x", "y").agg(F.count("*").alias("copies"))
    d, near, cells = by_cell(d, near_frames(t, "tf", 3, "frame"), ["session_id", "frame"], ["center_x", "center_y"], ["x", "y"], 70)
    pairs = d.join(near, ["session_id", "frame", *cells]).filter(
        within_share(F.col("value"), F.col("tv"), 0.1) & (F.hypot(F.col("center_x") - F.col("x"), F.col("center_y") - F.col("y")) <= 70)
    )
    return pairs.groupBy("session_id", "ordinal").agg(F.sum("copies").alias("candidates"))


_FRAME_TRUTH = "(SELECT session_id, CAST(frame AS BIGINT) AS frame, value, x, y, ordinal FROM truth)"
_FRAME_DET = "(SELECT session_id, CAST(frame AS BIGINT) AS frame, value, center_x, center_y, ordinal FROM detections)"


@query(
    "a12_frame_metrics",
    f"SELECT session_id, frame, tp, fp, fn, {RATES_SQL}, {ACC_SQL} FROM {counts_sql(match_sql(_FRAME_DET, _FRAME_TRUTH, 'session_id, frame', 0), _FRAME_TRUTH, 'session_id, frame')}",
    ["detections", "truth"],
)
def _(spark, sf):
    return mt.frame_metrics(ad.detections(spark, sf), ad.truth(spark, sf))


_RANGE_CASE = "CASE WHEN value < 1000 THEN 'tiny (<1k)' WHEN value < 10000 THEN 'small (1k-10k)' WHEN value < 100000 THEN 'medium (10k-100k)' WHEN value < 1000000 THEN 'large (100k-1M)' ELSE 'huge (>1M)' END"
_RANGE_TRUTH = f"(SELECT *, {_RANGE_CASE} AS value_range FROM truth)"
_RANGE_DET = "(SELECT *, unnest(['tiny (<1k)', 'small (1k-10k)', 'medium (10k-100k)', 'large (100k-1M)', 'huge (>1M)']) AS value_range FROM detections)"


@query(
    "a13_range_metrics",
    f"SELECT session_id, value_range, tp, fp, fn, {RATES_SQL}, {ACC_SQL} FROM {counts_sql(match_sql(_RANGE_DET, _RANGE_TRUTH, 'session_id, value_range', 3), _RANGE_TRUTH, 'session_id, value_range')}",
    ["detections", "truth"],
)
def _(spark, sf):
    return mt.range_metrics(ad.detections(spark, sf), ad.truth(spark, sf))


@query(
    "j4_label_by_truth",
    """SELECT session_id, ordinal, CASE WHEN EXISTS (SELECT 1 FROM truth t WHERE t.session_id = d.session_id AND abs(t.frame - d.frame) <= 3
       AND (t.value <= 0 OR abs(d.value - t.value) / t.value <= 0.1) AND sqrt((d.center_x - t.x) ** 2 + (d.center_y - t.y) ** 2) <= 70) THEN 1 ELSE 0 END AS label FROM detections d""",
    ["detections", "truth"],
)
def _(spark, sf):
    return mt.label_by_truth(ad.detections(spark, sf), ad.truth(spark, sf)).select("session_id", "ordinal", "label")


@query(
    "j5_truth_near",
    """SELECT f.session_id, f.frame, t.frame AS truth_frame, t.ordinal, t.value FROM (SELECT DISTINCT session_id, frame FROM detections WHERE value >= 5000) f
       JOIN truth t ON t.session_id = f.session_id AND abs(t.frame - f.frame) <= 2""",
    ["detections", "truth"],
)
def _(spark, sf):
    asked = ad.detections(spark, sf).filter("value >= 5000")
    return mt.truth_near(asked, ad.truth(spark, sf), 2).select("session_id", "frame", "truth_frame", "ordinal", "value")


@query(
    "j7_missed_frames",
    """SELECT session_id, frame_index, timestamp_ms, 0.5::DOUBLE AS prediction_confidence, 'motion_without_detection' AS reason FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM
       (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index DESC, timestamp_ms DESC) AS rn FROM (SELECT DISTINCT session_id, frame_index, timestamp_ms FROM hits)) WHERE rn <= 30)
       WHERE n >= 10 AND (session_id, frame_index) NOT IN (SELECT (session_id, frame_index) FROM hits WHERE parsed_value >= 2000)""",
    ["hits"],
)
def _(spark, sf):
    h = ad.hits(spark, sf)
    return mt.missed_frames(h, h.filter("parsed_value >= 2000"))


def text_lines(spark, sf):
    li = ad.boxes(spark, sf)
    return li.withColumn("text", F.expr("case ordinal % 4 when 0 then 'K' when 1 then 'm' else cast(ordinal % 1000 + 10 as string) end"))


@query(
    "c10_suffix_hints",
    """WITH t AS (SELECT *, CASE ordinal % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'M' ELSE CAST(ordinal % 1000 + 10 AS VARCHAR) END AS n FROM boxes),
       h AS (SELECT a.session_id, a.frame_index, a.ordinal, a.n, b.n AS hint, row_number() OVER (PARTITION BY a.session_id, a.frame_index, a.ordinal ORDER BY b."left" - a."right" - 1, b.ordinal) AS rn
         FROM t a JOIN t b ON a.frame_index = b.frame_index AND a.session_id = b.session_id WHERE a.ordinal % 4 > 1 AND b.ordinal % 4 < 2 AND b."left" > a."right" AND b.width <= 200 AND b.height <= 120
         AND b."left" - a."right" - 1 <= 120 AND abs((a.top + a.bottom) / 2 - (b.top + b.bottom) / 2) <= greatest(a.height, b.height) * 0.55e0)
       SELECT t.session_id, t.frame_index, t.ordinal, t.n || coalesce(h.hint, '') AS completed FROM t LEFT JOIN h ON h.ordinal = t.ordinal AND h.session_id = t.session_id AND h.frame_index = t.frame_index AND rn = 1""",
    ["boxes"],
)
def _(spark, sf):
    return mt.suffix_hints(text_lines(spark, sf)).select("session_id", "frame_index", "ordinal", "completed")


_GROUP = "STRUCT(id BIGINT, l INTEGER, t INTEGER, r INTEGER, b INTEGER, m BIGINT, w BIGINT, h BIGINT)"
_NEWGROUP = f"CAST({{'id': n.r.id, 'l': n.r.l, 't': n.r.t, 'r': n.r.r, 'b': n.r.b, 'm': 1, 'w': n.r.r - n.r.l + 1, 'h': n.r.b - n.r.t + 1}} AS {_GROUP})"
_GAP = "greatest(n.r.l - e.r - 1, e.l - n.r.r - 1, 0)"
_BW, _BH, _MID, _GMID = "(n.r.r - n.r.l + 1)", "(n.r.b - n.r.t + 1)", "((n.r.t + n.r.b) / 2)", "((e.t + e.b) / 2)"
_PUNCT = f"({_BW} <= 40 AND {_BH} <= 60 AND {_BH} <= e.h / e.m * 0.8e0 AND {_GAP} <= 30 AND {_MID} >= e.t + (e.b - e.t + 1) / 2)"
_SUFFIX = f"({_BW} <= 100 AND {_BH} <= 120 AND {_GAP} <= 40 AND abs({_MID} - {_GMID}) <= greatest(e.h / e.m, {_BH}) * 0.4e0)"
_ACCEPT = f"""e.m < 15 AND n.r.l >= e.l - 6 AND greatest(e.r, n.r.r) - least(e.l, n.r.l) + 1 <= 380 AND greatest(e.b, n.r.b) - least(e.t, n.r.t) + 1 <= 130
    AND ({_GAP} <= greatest(CAST(trunc(e.w / e.m * 3) AS INTEGER), 15) OR {_PUNCT} OR {_SUFFIX})
    AND (greatest(least(n.r.b, e.b) - greatest(n.r.t, e.t) + 1, 0) / greatest(least({_BH}, e.b - e.t + 1), 1) >= 0.15e0 OR abs({_MID} - {_GMID}) <= greatest(e.h / e.m, {_BH}) * 0.7e0 OR {_PUNCT})"""
_JOINED = "{'id': e.id, 'l': least(e.l, n.r.l), 't': least(e.t, n.r.t), 'r': greatest(e.r, n.r.r), 'b': greatest(e.b, n.r.b), 'm': e.m + 1, 'w': e.w + n.r.r - n.r.l + 1, 'h': e.h + n.r.b - n.r.t + 1}"
_LINE_IDS = f"""(SELECT session_id, frame_index, unnest(ids) AS ordinal, unnest(z.o) AS line_id FROM (SELECT session_id, frame_index, ids, list_reduce(list_prepend(
      {{'st': CAST([] AS {_GROUP}[]), 'r': CAST(NULL AS {_GROUP}), 'o': CAST([] AS BIGINT[])}}, l), lambda a, n: list_transform(
        [coalesce(list_sort(list_filter(list_transform(a.st, lambda e, j: CASE WHEN {_ACCEPT} THEN {{'g': {_GAP}, 'j': j}} END), lambda q: q IS NOT NULL))[1].j, 0)], lambda i: CASE WHEN i = 0
          THEN {{'st': list_append(a.st, {_NEWGROUP}), 'r': n.r, 'o': list_append(a.o, n.r.id)}}
          ELSE {{'st': list_transform(a.st, lambda e, j: CASE WHEN j = i THEN CAST({_JOINED} AS {_GROUP}) ELSE e END), 'r': n.r, 'o': list_append(a.o, a.st[i].id)}} END)[1]) AS z
      FROM (SELECT session_id, frame_index, list({{'st': CAST([] AS {_GROUP}[]), 'r': CAST({{'id': ordinal, 'l': "left", 't': top, 'r': "right", 'b': bottom, 'm': 1, 'w': 0, 'h': 0}} AS {_GROUP}), 'o': CAST([] AS BIGINT[])}} ORDER BY top, "left", ordinal) AS l,
        list(ordinal ORDER BY top, "left", ordinal) AS ids FROM boxes GROUP BY 1, 2)))"""
LINES_SQL = f"""(SELECT *, "right" - "left" + 1 AS width, bottom - top + 1 AS height FROM (SELECT b.session_id, b.frame_index, line_id, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom,
    CAST(sum(pixel_count) AS BIGINT) AS pixel_count, count(*) AS member_count FROM boxes b JOIN {_LINE_IDS} i ON i.session_id = b.session_id AND i.frame_index = b.frame_index AND i.ordinal = b.ordinal GROUP BY 1, 2, 3))"""


# The same fold, with every box in exactly one line even where boxes share an ordinal: the order is total but for equal boxes, lines
# are known by their place in the list, and the boxes come out of the fold instead of being looked up by ordinal.
_BOX_ORDER = 'ORDER BY top, "left", ordinal, "right", bottom, pixel_count'
_EACH_BOX = (
    _LINE_IDS.replace('ORDER BY top, "left", ordinal', _BOX_ORDER)
    .replace("unnest(ids) AS ordinal, unnest(z.o) AS line_id", "unnest(ids) AS box, unnest(z.o) AS line, generate_subscripts(ids, 1) AS place")
    .replace("list(ordinal ORDER", """list({'ordinal': ordinal, 'left': "left", 'top': top, 'right': "right", 'bottom': bottom, 'pixel_count': pixel_count} ORDER""")
    .replace("list_append(a.o, n.r.id)", "list_append(a.o, len(a.st) + 1)").replace("list_append(a.o, a.st[i].id)", "list_append(a.o, i)")
)
BOX_LINES_SQL = f"""(SELECT * EXCLUDE (line), "right" - "left" + 1 AS width, bottom - top + 1 AS height FROM (SELECT session_id, frame_index, line, arg_min(box.ordinal, place) AS line_id, min(box."left") AS "left", min(box.top) AS top,
    max(box."right") AS "right", max(box.bottom) AS bottom, CAST(sum(box.pixel_count) AS BIGINT) AS pixel_count, count(*) AS member_count FROM {_EACH_BOX} GROUP BY 1, 2, 3))"""


@query("c8_group_lines", f"SELECT * FROM {BOX_LINES_SQL}", ["boxes"])
def _(spark, sf):
    return sq.group_lines(ad.boxes(spark, sf))


# --- long sessions -------------------------------------------------------------------------
# The same operators with pieces of a day (or as short as the look-back allows), so that every session is cut
# many times and live entries are handed from piece to piece.

SHORT = 24


@query("k2_stable_hits_short_pieces", ORACLE["k2_stable_hits"])
def _(spark, sf):
    return sq.stable_hits(ad.hits(spark, sf), span=SHORT)


@query("k3_live_unique_short_pieces", ORACLE["k3_live_unique"])
def _(spark, sf):
    return sq.live_unique(ad.hits(spark, sf), span=SHORT).select("session_id", "ordinal", "frame_index", "parsed_value")


@query("k4_vote_tracks_short_pieces", ORACLE["k4_vote_tracks"])
def _(spark, sf):
    return sq.vote_tracks(ad.hits(spark, sf), span=SHORT).select("session_id", "ordinal", "track_id")


@query("k6_enemies_short_pieces", ORACLE["k6_enemies"])
def _(spark, sf):
    return sq.enemies(sq.enemy_ids(ad.damage(spark, sf), span=SHORT))


@query("j3_match_truth_short_pieces", ORACLE["j3_match_truth"])
def _(spark, sf):
    return mt.match_truth(ad.detections(spark, sf), ad.truth(spark, sf), span=SHORT).select("session_id", "ordinal", "truth_ordinal")


@query("a12_frame_metrics_short_pieces", ORACLE["a12_frame_metrics"])
def _(spark, sf):
    return mt.frame_metrics(ad.detections(spark, sf), ad.truth(spark, sf), span=SHORT)


FLAT = 40


@query("c8_group_lines_short_pieces", f"SELECT * FROM {BOX_LINES_SQL.replace(' + 1 <= 130', f' + 1 <= {FLAT}')}", ["boxes"])
def _(spark, sf):
    return sq.group_lines(ad.boxes(spark, sf), max_h=FLAT, span=SHORT)


# --- crowded frames ------------------------------------------------------------------------
# The distance joins with every frame of more than one point cut into cells.


@query("j1_temporal_support_in_cells", ORACLE["j1_temporal_support"])
def _(spark, sf):
    return mt.temporal_support(ad.hits(spark, sf), crowd=1).select("session_id", "ordinal", F.round("support", 6).alias("support"))


@query("j4_label_by_truth_in_cells", ORACLE["j4_label_by_truth"])
def _(spark, sf):
    return mt.label_by_truth(ad.detections(spark, sf), ad.truth(spark, sf), crowd=1).select("session_id", "ordinal", "label")


@query("j8_cue_pairs_in_cells", ORACLE["j8_cue_pairs"])
def _(spark, sf):
    return sq.cue_pairs(enemy(spark, sf), ad.cues(spark, sf), within_ms=KILL_MS, crowd=1).select("session_id", "enemy_id", "cue_type", "cue_ms", "cue_ordinal")


@query("c10_suffix_hints_in_cells", ORACLE["c10_suffix_hints"])
def _(spark, sf):
    return mt.suffix_hints(text_lines(spark, sf), crowd=1).select("session_id", "frame_index", "ordinal", "completed")
