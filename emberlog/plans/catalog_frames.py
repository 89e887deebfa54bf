"""Frame- and box-level jobs (C rows, S14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions import geometry as geo
from emberlog.operators import frames as fr, sequence as sq
from emberlog.plans import adapters as ad
from emberlog.plans.catalog_sequence import LINES_SQL
from emberlog.plans.catalog_stats import motion
from emberlog.plans.catalog_text import BATCH_READY_SQL, LINE_SCORE_SQL, LIVE_READY_SQL, READINGS_SQL, TOKEN_READY_SQL, TOKEN_SCORE_SQL, scored_readings
from emberlog.plans.registry import query

SIZE = 60 * 40
HSV_SQL = """(SELECT frame_index, x, y, CASE WHEN h < 0 THEN h + 180 ELSE h END AS h, s, v FROM (SELECT *, CAST(round_even(deg / 2, 0) AS INTEGER) AS h,
    CASE WHEN v = 0 THEN 0 ELSE CAST(round_even(d / v * 255, 0) AS INTEGER) END AS s FROM (SELECT *, CASE WHEN d = 0 THEN 0e0 WHEN v = r THEN (g - b) / d * 60
    WHEN v = g THEN (b - r) / d * 60 + 120 ELSE (r - g) / d * 60 + 240 END AS deg FROM (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM pixels))))"""


def _range_sql(r) -> str:
    return "(" + " AND ".join(f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in zip("hsv", r[:3])) + ")"


CENSUS_SQL = " OR ".join(_range_sql(r) for r in fr.CENSUS_RANGES)


@query("c1_pixel_census", f"SELECT frame_index, count(*) FILTER ({CENSUS_SQL}) AS text_pixels, count(*) AS pixels FROM {HSV_SQL} GROUP BY 1", ["pixels"])
def _(spark, sf):
    return fr.pixel_census(ad.pixels(spark, sf))


_MASKS_SQL = "(" + " UNION ALL ".join(
    f"SELECT frame_index, {i} AS o, '{c}' AS colour, {r[3]}e0 AS prior, count(*) FILTER ({_range_sql(r)}) AS pixel_count FROM {HSV_SQL} GROUP BY 1"
    for i, (c, r) in enumerate(fr.COLOUR_RANGES.items())
) + ")"
_CONF_SQL = f"""(SELECT *, prior * CASE WHEN pixel_count = 0 THEN 0 WHEN fill BETWEEN 0.01e0 AND 0.1e0 THEN 1 WHEN fill < 0.01e0 THEN fill / 0.01e0
    ELSE greatest(0.1e0, 1 - (fill - 0.1e0) / 0.9e0) END AS confidence FROM (SELECT *, pixel_count / {SIZE} AS fill FROM {_MASKS_SQL}))"""


@query("c2_colour_masks", f"SELECT frame_index, colour, pixel_count, round(confidence, 6) AS confidence FROM {_CONF_SQL}", ["pixels"])
def _(spark, sf):
    return fr.colour_masks(ad.pixels(spark, sf), SIZE).select("frame_index", "colour", "pixel_count", F.round("confidence", 6).alias("confidence"))


@query(
    "c2_dominant_colour",
    f"""SELECT frame_index, colour, pixel_count, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY round(pixel_count * confidence, 9) DESC, o) AS rn
        FROM {_CONF_SQL} WHERE pixel_count >= 20 AND pixel_count * confidence > 0) WHERE rn = 1""",
    ["pixels"],
)
def _(spark, sf):
    masks = fr.colour_masks(ad.pixels(spark, sf), SIZE)
    return fr.dominant_colour(masks, min_pixels=20).withColumn("confidence", F.round("confidence", 6))


@query(
    "c2_combined_mask",
    f"SELECT frame_index, count(*) FILTER ({' OR '.join(_range_sql(r) for r in fr.COLOUR_RANGES.values())}) AS mask_pixels FROM {HSV_SQL} GROUP BY 1",
    ["pixels"],
)
def _(spark, sf):
    return fr.combined_mask(ad.pixels(spark, sf))


@query(
    "c3_calibrate",
    f"SELECT frame_index, "
    + ", ".join(
        f"greatest(0, CAST(trunc(round(avg({c}) - 2 * stddev_pop({c}), 9)) AS INTEGER)) AS {n}_min, least({t}, CAST(trunc(round(avg({c}) + 2 * stddev_pop({c}), 9)) AS INTEGER)) AS {n}_max"
        for c, n, t in (("h", "hue", 180), ("s", "sat", 255), ("v", "val", 255))
    )
    + f" FROM {HSV_SQL} GROUP BY 1",
    ["pixels"],
)
def _(spark, sf):
    return fr.calibrate(ad.pixels(spark, sf))


_DELTA_SQL = """(SELECT *, list_transform(list_zip(thumb, prev), lambda p: abs(p[1] - p[2])) AS delta FROM
    (SELECT *, lag(thumb) OVER (PARTITION BY session_id ORDER BY frame_index) AS prev FROM thumbs))"""


@query(
    "c4_motion_gate",
    f"""SELECT session_id, frame_index, round(m, 6) AS mean_change, coalesce(m >= 12, true) AS is_kept FROM
        (SELECT session_id, frame_index, CASE WHEN prev IS NOT NULL THEN list_sum(delta) / len(thumb) END AS m FROM {_DELTA_SQL})""",
    ["thumbs"],
)
def _(spark, sf):
    gate = fr.motion_gate(ad.thumbs(spark, sf), threshold=12.0, width=16)
    return gate.select("session_id", "frame_index", F.round("mean_change", 6).alias("mean_change"), "is_kept")


@query(
    "c5_motion_score",
    f"""SELECT session_id, frame_index, round(CASE WHEN prev IS NULL THEN 0 ELSE least(len(list_filter(delta, lambda d: d > 30)) / len(thumb) * 10, 1) END, 6) AS motion_score FROM {_DELTA_SQL}""",
    ["thumbs"],
)
def _(spark, sf):
    return fr.motion(ad.thumbs(spark, sf), cut=30.0, width=16).select("session_id", "frame_index", F.round("motion_score", 6).alias("motion_score"))


def mask(spark, sf):
    p = fr.with_hsv(ad.pixels(spark, sf))
    return p.filter("v >= 110").select("frame_index", "x", "y")


_MASK_SQL = f"(SELECT DISTINCT frame_index, x, y FROM {HSV_SQL} WHERE v >= 110)"
# Blobs by spreading the smallest point number over 4-neighbours until nothing changes.
_BLOB_SQL = f"""m AS MATERIALIZED (SELECT frame_index, x, y, y * 60 + x AS p FROM {_MASK_SQL}),
    g AS MATERIALIZED (SELECT a.frame_index, a.p AS a, b.p AS b FROM m a JOIN m b ON a.frame_index = b.frame_index AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
    reach AS (SELECT frame_index, p AS src, p AS dst FROM m UNION SELECT r.frame_index, r.src, g.b FROM reach r JOIN g ON g.frame_index = r.frame_index AND g.a = r.dst),
    lab AS (SELECT frame_index, dst AS p, min(src) AS label FROM reach GROUP BY 1, 2),
    boxes0 AS (SELECT m.frame_index, min(x) AS "left", min(y) AS top, max(x) AS "right", max(y) AS bottom, count(*) AS pixel_count FROM m JOIN lab USING (frame_index, p) GROUP BY m.frame_index, label),
    blobs AS (SELECT * FROM boxes0 WHERE pixel_count >= 8 AND "right" - "left" + 1 >= 3 AND bottom - top + 1 >= 2)"""
_SIZES = {"min_pixels": 8, "min_width": 3, "min_height": 2}


@query("c6_components", f"WITH RECURSIVE {_BLOB_SQL} SELECT * FROM blobs", ["pixels"])
def _(spark, sf):
    return fr.components(mask(spark, sf), **_SIZES)


@query(
    "c7_split_wide",
    f"""WITH RECURSIVE {_BLOB_SQL}, w AS (SELECT * FROM blobs WHERE "right" - "left" + 1 > floor((bottom - top + 1) * 1.6e0)),
        c AS (SELECT w.*, x, count(*) AS n, min(y) AS y0, max(y) AS y1 FROM w JOIN m ON m.frame_index = w.frame_index AND x BETWEEN "left" AND "right" AND y BETWEEN top AND bottom GROUP BY ALL HAVING count(*) > 1),
        s AS (SELECT frame_index, "left", top, "right", bottom, g, min(x) AS x0, max(x) AS x1, min(y0) AS y0, max(y1) AS y1, CAST(sum(n) AS BIGINT) AS n FROM
          (SELECT *, x - row_number() OVER (PARTITION BY frame_index, "left", top, "right", bottom ORDER BY x) AS g FROM c) GROUP BY 1, 2, 3, 4, 5, 6),
        p AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY frame_index, "left", top, "right", bottom) AS k FROM s) WHERE k > 1 AND n >= 8 AND x1 - x0 + 1 >= 3 AND y1 - y0 + 1 >= 2)
        SELECT frame_index, x0 AS "left", y0 AS top, x1 AS "right", y1 AS bottom, n AS pixel_count FROM p UNION ALL
        SELECT * FROM blobs b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.frame_index = b.frame_index AND p."left" = b."left" AND p.top = b.top AND p."right" = b."right" AND p.bottom = b.bottom)""",
    ["pixels"],
)
def _(spark, sf):
    m = mask(spark, sf)
    return fr.split_wide(m, fr.components(m, **_SIZES), **_SIZES)


@query(
    "c9_best_lines",
    f"""SELECT session_id, frame_index, line_id, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, frame_index ORDER BY score DESC, top, "left", line_id) AS rn
        FROM (SELECT *, {LINE_SCORE_SQL} AS score FROM {LINES_SQL}) WHERE {LIVE_READY_SQL}) WHERE rn <= 8""",
    ["boxes"],
)
def _(spark, sf):
    lines = fr.scored_lines(sq.lines_by_ordinal(ad.boxes(spark, sf)))
    return fr.best_lines(lines).select("session_id", "frame_index", "line_id", "score", "rank")


@query("c11_accepted", f"SELECT session_id, ordinal, val AS parsed_value, round(confidence, 6) AS confidence FROM {READINGS_SQL} WHERE val IS NOT NULL AND confidence >= 0.2e0 AND ok", ["texts"])
def _(spark, sf):
    return fr.accepted(scored_readings(spark, sf)).select("session_id", "ordinal", "parsed_value", F.round("confidence", 6).alias("confidence"))


_SCORED = "(SELECT session_id, frame_index, CAST(sum(center_x) AS BIGINT) AS pixels FROM hits GROUP BY 1, 2)"


def scored_frames(spark, sf):
    return ad.hits(spark, sf).groupBy("session_id", "frame_index").agg(F.sum("center_x").cast("bigint").alias("pixels"))


@query(
    "c12_densest_frames",
    f"SELECT session_id, frame_index, pixels, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pixels DESC, frame_index) AS rn FROM {_SCORED}) WHERE rn <= 12",
    ["hits"],
)
def _(spark, sf):
    return fr.densest_frames(scored_frames(spark, sf))


@query(
    "c13_select_frames",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM {_SCORED}),
        s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pixels DESC, pos) AS rn FROM p) WHERE rn <= least(greatest(round_even(n * 0.12e0, 0), 6), 30))
        SELECT session_id, frame_index, pixels, pos, EXISTS (SELECT 1 FROM s WHERE s.session_id = p.session_id AND s.pos = p.pos) AS is_seed FROM p
        WHERE EXISTS (SELECT 1 FROM s WHERE s.session_id = p.session_id AND abs(s.pos - p.pos) <= 2)""",
    ["hits"],
)
def _(spark, sf):
    return fr.select_frames(scored_frames(spark, sf))


@query(
    "c14_keyframes",
    f"""SELECT session_id, frame_index FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index DESC) AS k FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index DESC) AS rn FROM {_SCORED})
        WHERE rn <= 30 AND frame_index % 3 = 0) WHERE k <= 10""",
    ["hits"],
)
def _(spark, sf):
    return fr.keyframes(scored_frames(spark, sf), last=10).select("session_id", "frame_index")


@query("c14_frame_skip", f"SELECT session_id, frame_index, pixels FROM {_SCORED} WHERE frame_index % 4 = 0", ["hits"])
def _(spark, sf):
    return fr.skip_frames(scored_frames(spark, sf), 3)


@query(
    "c15_ranked_tokens",
    f"SELECT session_id, ordinal, {TOKEN_READY_SQL} AS is_ready, round({TOKEN_SCORE_SQL}, 6) AS score FROM boxes",
    ["boxes"],
)
def _(spark, sf):
    w, h, p = (F.col(c) for c in ("width", "height", "pixel_count"))
    b = ad.boxes(spark, sf).withColumns({"score": geo.token_score(w, h, p), "is_ready": geo.token_ready(w, h, p)})
    return fr.ranked(b).select("session_id", "ordinal", "is_ready", F.round("score", 6).alias("score"))


@query(
    "c15_ready_summary",
    f"SELECT session_id, count(*) AS candidates, count(*) FILTER (is_ready) AS ready, max(score) AS best_score FROM (SELECT session_id, {LINE_SCORE_SQL} AS score, {BATCH_READY_SQL} AS is_ready FROM boxes) GROUP BY 1",
    ["boxes"],
)
def _(spark, sf):
    return fr.ready_summary(fr.scored_lines(ad.boxes(spark, sf), gate="batch"))


@query(
    "s14_recent_frames",
    f"SELECT session_id, frame_index, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index DESC) AS rn FROM {_SCORED}) WHERE rn <= 40",
    ["hits"],
)
def _(spark, sf):
    return fr.recent_frames(scored_frames(spark, sf), 40).select("session_id", "frame_index", "rank")
