"""Projections: text and geometry expressions (P rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions import geometry as geo, scoring as sc, text as tx
from emberlog.operators.stats import token_kinds
from emberlog.plans import adapters as ad
from emberlog.plans.registry import query
from emberlog.session import cut_lineage


def text_sql(source: str, col: str) -> str:
    """SQL relation adding s (compact), n (normalised), val (parsed) and ok (plausible) to ``source``."""
    return f"""(SELECT *, CASE WHEN s = '' THEN false
        WHEN regexp_matches(s, '{tx.COMMA_SUFFIXED}') THEN true
        WHEN NOT regexp_matches(s, '\\p{{L}}$') AND regexp_matches(s, '{tx.SHORT_TAIL}') THEN false
        WHEN val IS NULL OR val <= 0 THEN false
        WHEN regexp_matches(n, '\\p{{L}}$') THEN regexp_matches(n, '{tx.SUFFIXED}')
        ELSE regexp_matches(n, '{tx.PLAIN}') END AS ok
      FROM (SELECT *, CASE WHEN regexp_matches(n, '{tx.DAMAGE}') THEN TRY_CAST(trunc(
          TRY_CAST(regexp_extract(n, '^([0-9.]+)', 1) AS DOUBLE) *
          CASE upper(right(n, 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1e0 END) AS BIGINT) END AS val
      FROM (SELECT *, CASE WHEN suf <> '' AND regexp_matches(body, '{tx.SHORT_TAIL}') THEN replace(body, ',', '.')
          ELSE replace(body, ',', '') END || upper(suf) AS n
      FROM (SELECT *, CASE WHEN regexp_matches(s, '\\p{{L}}$') THEN left(s, length(s) - 1) ELSE s END AS body,
          CASE WHEN regexp_matches(s, '\\p{{L}}$') THEN right(s, 1) ELSE '' END AS suf
      FROM (SELECT *, replace(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'), ' ', '') AS s FROM {source})))))"""


KIND_SQL = rf"""CASE WHEN st = '' THEN 'unknown' WHEN contains(lower(st), 'gold') THEN 'gold'
    WHEN regexp_matches(st, '{tx.DAMAGE}') THEN 'damage' WHEN regexp_matches(st, '\p{{L}}') THEN 'item' ELSE 'unknown' END"""
TOKENS_SQL = r"(SELECT lang, unnest(regexp_split_to_array(text, '\s+')) AS text FROM documents)"
STRIP_SQL = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    "p1_clean_text",
    rf"SELECT ordinal, text, regexp_replace(translate(text, 'OoS', '005'), '{tx.NOISE}', '', 'g') AS cleaned FROM texts",
    ["texts"],
)
def _(spark, sf):
    return ad.texts(spark, sf).select("ordinal", "text", tx.clean_text(F.col("text")).alias("cleaned"))


@query("p2_normalize", f"SELECT ordinal, text, n AS normalized FROM {text_sql('texts', 'text')}", ["texts"])
def _(spark, sf):
    return ad.texts(spark, sf).select("ordinal", "text", tx.normalize(F.col("text")).alias("normalized"))


@query("p3_parse_value", f"SELECT ordinal, text, val AS parsed_value FROM {text_sql('texts', 'text')}", ["texts"])
def _(spark, sf):
    return ad.texts(spark, sf).select("ordinal", "text", tx.parse_value(F.col("text")).alias("parsed_value"))


@query("p4_plausible", f"SELECT ordinal, text, ok AS plausible FROM {text_sql('texts', 'text')}", ["texts"])
def _(spark, sf):
    return tx.read_texts(ad.texts(spark, sf)).select("ordinal", "text", F.col("is_plausible").alias("plausible"))


@query(
    "p5_classify",
    f"""SELECT ordinal, text, {KIND_SQL} AS kind, CASE WHEN {KIND_SQL} = 'damage' THEN val END AS parsed_damage
        FROM (SELECT *, {STRIP_SQL} AS st FROM {text_sql('texts', 'text')})""",
    ["texts"],
)
def _(spark, sf):
    kind = tx.classify(F.col("text"))
    return ad.texts(spark, sf).select(
        "ordinal", "text", kind.alias("kind"), F.when(kind == "damage", tx.parse_value(F.col("text"))).alias("parsed_damage")
    )


@query(
    "p5_classify_documents",
    rf"""SELECT lang, kind, count(*) AS tokens, CAST(coalesce(sum(CASE WHEN kind = 'damage' THEN val END), 0) AS BIGINT) AS damage
        FROM (SELECT lang, val, {KIND_SQL} AS kind FROM (SELECT *, {STRIP_SQL} AS st FROM {text_sql(
            TOKENS_SQL, 'text')})) GROUP BY ALL""",
)
def _(spark, sf):
    """``damage`` is a bigint as in the SQL, whose sum fails beyond; there it is the exact decimal instead."""
    kinds = cut_lineage(token_kinds(ad.table(spark, sf, "documents"), ["lang"]))  # a row per language and kind
    fits = kinds.filter(F.col("damage") > F.lit(2**63 - 1)).isEmpty()
    return kinds.withColumn("damage", F.col("damage").cast("bigint")) if fits else kinds


@query(
    "p6_loose_text",
    rf"""SELECT ordinal, text, coalesce(regexp_matches(text, '{tx.LOOSE_PLAUSIBLE}'), false) AS loose_plausible,
        CASE WHEN regexp_matches(body, '{tx.LOOSE_NUMBER}') THEN TRY_CAST(trunc(TRY_CAST(trim(body) AS DOUBLE) *
          CASE WHEN body = u THEN 1e0 ELSE CASE right(u, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 ELSE 1e9 END END) AS BIGINT) END AS loose_value
        FROM (SELECT *, CASE WHEN regexp_matches(u, '[KMB]$') THEN left(u, length(u) - 1) ELSE u END AS body
        FROM (SELECT *, upper({STRIP_SQL}) AS u FROM texts))""",
    ["texts"],
)
def _(spark, sf):
    t = F.col("text")
    return ad.texts(spark, sf).select(
        "ordinal", "text", tx.loose_plausible(t).alias("loose_plausible"), tx.loose_parse(t).alias("loose_value")
    )


_READING_SCORE_SQL = """CASE WHEN length(text) = 0 THEN -10e0 ELSE
    CASE WHEN val IS NOT NULL THEN 10e0 ELSE 0e0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 3e0 ELSE 0e0 END
    + CASE WHEN regexp_matches(text, '[kKmMbB]') THEN 1.5e0 ELSE 0e0 END + CASE WHEN regexp_matches(text, '[.,]') THEN 1e0 ELSE 0e0 END
    + CASE WHEN length(text) < 2 THEN -3e0 ELSE 0e0 END + CASE WHEN length(text) > 10 THEN -2e0 ELSE 0e0 END END"""


@query(
    "p7_best_reading",
    f"""SELECT session_id, region, text AS best_text, score FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, region ORDER BY score DESC, ordinal) AS rn FROM (
        SELECT session_id, ordinal // 40 AS region, ordinal, text, {_READING_SCORE_SQL} AS score FROM {text_sql('texts', 'text')}))
        WHERE rn = 1""",
    ["texts"],
)
def _(spark, sf):
    scored = ad.texts(spark, sf).withColumn("region", F.expr("ordinal div 40")).withColumn("score", tx.reading_score(F.col("text")))
    best = F.max_by(F.struct("text", "score"), F.struct(F.col("score"), -F.col("ordinal")))
    return scored.groupBy("session_id", "region").agg(best.alias("b")).select("session_id", "region", F.col("b.text").alias("best_text"), F.col("b.score").alias("score"))


_FILL = "(pixel_count / greatest(width * height, 1))"
_ASPECT = "(width / greatest(height, 1))"


def _near(v: str, t: float) -> str:
    return f"greatest(0e0, 1e0 - abs({v} - {t}e0) / {t}e0)"


def _pts(cond: str, p: float) -> str:
    return f" + CASE WHEN {cond} THEN {p}e0 ELSE 0e0 END"


TOKEN_SCORE_SQL = (
    f"{_near('width', 46.0)} * 3 + {_near('height', 28.0)} * 3 + {_near(_FILL, 0.34)} * 2 + {_near(_ASPECT, 1.8)} * 2"
    + _pts("width BETWEEN 24 AND 90", 1.5) + _pts("height BETWEEN 14 AND 56", 1.5) + _pts("pixel_count BETWEEN 80 AND 1200", 1.0)
    + _pts(f"{_ASPECT} >= 1.35e0", 1.5) + _pts("width > 90", -2.0) + _pts("height > 70", -2.0) + _pts("pixel_count > 1800", -2.5)
    + _pts(f"{_FILL} > 0.8e0", -2.0) + _pts("width < 24", -2.5) + _pts(f"{_ASPECT} < 1.1e0", -2.5)
)
LINE_SCORE_SQL = (
    "0e0" + _pts("width BETWEEN 24 AND 260", 3.0) + _pts("height BETWEEN 12 AND 150", 3.0) + _pts(f"{_ASPECT} BETWEEN 1.5e0 AND 5e0", 2.0)
    + _pts("member_count BETWEEN 2 AND 6", 2.0) + _pts(f"{_FILL} BETWEEN 0.15e0 AND 0.7e0", 2.0) + _pts("member_count = 1", -3.0)
    + _pts("width > 280", -2.5) + _pts("height > 160", -2.5) + _pts(f"{_FILL} > 0.75e0", -2.0)
)
BATCH_READY_SQL = f"(({LINE_SCORE_SQL}) >= 5 AND width BETWEEN 16 AND 260 AND height BETWEEN 12 AND 90 AND member_count >= 2)"
LIVE_READY_SQL = f"(({LINE_SCORE_SQL}) >= 5 AND width BETWEEN 12 AND 380 AND height BETWEEN 10 AND 130 AND member_count >= 1)"
TOKEN_READY_SQL = f"(({TOKEN_SCORE_SQL}) >= 7 AND width BETWEEN 24 AND 90 AND height BETWEEN 14 AND 70 AND pixel_count BETWEEN 80 AND 1800 AND {_ASPECT} >= 1.1e0)"
_BOX = ("width", "height", "pixel_count", "member_count")


def _dims():
    return [F.col(c) for c in _BOX]


@query("p8_token_score", f"SELECT ordinal, round({TOKEN_SCORE_SQL}, 6) AS score, {TOKEN_READY_SQL} AS is_ready FROM boxes", ["boxes"])
def _(spark, sf):
    w, h, p, _m = _dims()
    return ad.boxes(spark, sf).select("ordinal", F.round(geo.token_score(w, h, p), 6).alias("score"), geo.token_ready(w, h, p).alias("is_ready"))


@query(
    "p9_line_score",
    f"SELECT ordinal, {LINE_SCORE_SQL} AS score, {BATCH_READY_SQL} AS batch_ready, {LIVE_READY_SQL} AS live_ready FROM boxes",
    ["boxes"],
)
def _(spark, sf):
    d = _dims()
    return ad.boxes(spark, sf).select(
        "ordinal", geo.line_score(*d).alias("score"), geo.line_ready(*d, gate="batch").alias("batch_ready"), geo.line_ready(*d, gate="live").alias("live_ready")
    )


def scored_readings(spark, sf):
    """Text readings with box-like features taken from the ordinal."""
    i = F.col("ordinal")
    t = ad.texts(spark, sf).select(
        "session_id", "ordinal", "text",
        ((i % 30) / 2.0).alias("line_score"), (i % 8).cast("int").alias("member_count"),
        (i % 120 + 10).cast("int").alias("width"), (i % 40 + 8).cast("int").alias("height"),
    )
    inputs = ("text", "parsed_value", "is_plausible", "line_score", "member_count", "width", "height")
    return tx.read_texts(t).withColumn("confidence", sc.heuristic_confidence(*[F.col(c) for c in inputs]))


CONFIDENCE_SQL = (
    "greatest(0e0, least(1e0, least(line_score / 12e0, 1e0) * 0.35e0"
    + _pts("val IS NOT NULL", 0.35) + _pts("ok", 0.2) + _pts("regexp_matches(text, '^[0-9]')", 0.1)
    + _pts("regexp_matches(text, '[kKmMbB]')", 0.1) + _pts("regexp_matches(text, '[.,]')", 0.05) + _pts("member_count BETWEEN 2 AND 6", 0.05)
    + _pts("val = 0", -0.4) + _pts("text <> '' AND NOT ok", -0.35)
    + _pts("text LIKE '0%' AND length(text) > 1 AND text NOT LIKE '0.%'", -0.25)
    + _pts("text <> '' AND NOT regexp_matches(text, '[0-9]')", -0.4) + _pts("length(text) <= 1", -0.3)
    + _pts("regexp_matches(text, '[KMB]$') AND length(regexp_replace(text, '[^0-9]', '', 'g')) = 1 AND width >= 50", -0.2)
    + _pts("val < 1000 AND NOT regexp_matches(text, '[kKmMbB]')", -0.25) + _pts("width < 28 OR height < 16", -0.15) + "))"
)
READINGS_SQL = f"""(SELECT *, {CONFIDENCE_SQL} AS confidence FROM {text_sql(
    '''(SELECT *, (ordinal % 30) / 2e0 AS line_score, CAST(ordinal % 8 AS INTEGER) AS member_count,
        CAST(ordinal % 120 + 10 AS INTEGER) AS width, CAST(ordinal % 40 + 8 AS INTEGER) AS height FROM texts)''', 'text')})"""


@query(
    "p10_confidence",
    f"SELECT ordinal, text, round(confidence, 6) AS confidence, confidence >= 0.6e0 AS is_confident FROM {READINGS_SQL}",
    ["texts"],
)
def _(spark, sf):
    return scored_readings(spark, sf).select(
        "ordinal", "text", F.round("confidence", 6).alias("confidence"), (F.col("confidence") >= 0.6).alias("is_confident")
    )


def featured(df):
    cols = sc.feature_columns(*[F.col(c) for c in ("line_score", "member_count", "width", "height", "pixel_count", "raw_text")])
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, *[c.alias(n) for n, c in cols.items()])


FEATURES_SQL = rf"""(SELECT ordinal, label, raw_text, line_score, {_FILL} AS fill_ratio, {_ASPECT} AS aspect_ratio, member_count, width, height,
    regexp_matches(raw_text, '[0-9]') AS has_digit, regexp_matches(upper(raw_text), '[KMB]') AS has_suffix, contains(raw_text, '.') AS has_decimal,
    regexp_matches(raw_text, '^[1-9]') AS starts_with_nonzero, CAST(length(raw_text) AS INTEGER) AS text_length, pv AS parsed_value,
    coalesce(pv BETWEEN 100 AND 100000000, false) AS value_in_range, regexp_matches(raw_text, '{tx.LOOSE_PLAUSIBLE}') AS is_plausible
    FROM (SELECT *, CASE WHEN regexp_matches(body, '{tx.LOOSE_NUMBER}') THEN TRY_CAST(trunc(TRY_CAST(body AS DOUBLE) *
        CASE WHEN body = u THEN 1e0 ELSE CASE right(u, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 ELSE 1e9 END END) AS BIGINT) END AS pv
    FROM (SELECT *, CASE WHEN regexp_matches(u, '[KMB]$') THEN left(u, length(u) - 1) ELSE u END AS body FROM (SELECT *, upper(raw_text) AS u FROM samples))))"""
WEIGHTED_SQL = "((" + " + ".join(
    f"coalesce(CAST({f} AS DOUBLE), 0e0) * {w}e0" for f, w in sc.FEATURE_WEIGHTS.items()
) + ") - 0.5e0) * 4e0"


@query(
    "p11_features",
    f"""SELECT ordinal, line_score, round(fill_ratio, 9) AS fill_ratio, round(aspect_ratio, 9) AS aspect_ratio, member_count, width, height, has_digit,
        has_suffix, has_decimal, starts_with_nonzero, text_length, parsed_value, value_in_range, is_plausible,
        CASE WHEN parsed_value IS NULL THEN 0e0 ELSE 1e0 END AS v_parsed_value FROM {FEATURES_SQL}""",
    ["samples"],
)
def _(spark, sf):
    f = featured(ad.samples(spark, sf))
    presence = [c for c, n in zip(sc.feature_vector_inputs(), sc.FEATURES) if n == "parsed_value"]
    cols = [F.round(n, 9).alias(n) if n in ("fill_ratio", "aspect_ratio") else F.col(n) for n in sc.FEATURES]
    return f.select("ordinal", *cols, *presence)


@query(
    "p12_default_weights",
    f"""SELECT ordinal, round(z, 6) AS probability, round(1 / (1 + exp(-z)), 6) AS confidence,
        CASE WHEN 1 / (1 + exp(-z)) >= 0.5e0 THEN 'hit' ELSE 'no_hit' END AS decision FROM (SELECT ordinal, {WEIGHTED_SQL} AS z FROM {FEATURES_SQL})""",
    ["samples"],
)
def _(spark, sf):
    z = featured(ad.samples(spark, sf)).select("ordinal", sc.weighted_score().alias("z"))
    conf = sc.logistic(F.col("z"))
    return z.select(
        "ordinal", F.round("z", 6).alias("probability"), F.round(conf, 6).alias("confidence"), F.when(conf >= 0.5, "hit").otherwise("no_hit").alias("decision")
    )


_MERGE_SQL = """CASE WHEN a = b THEN true WHEN greatest(a, b) < 1000 THEN greatest(a, b) - least(a, b) <= 5
    WHEN greatest(a, b) >= 1000000 THEN (greatest(a, b) - least(a, b)) / greatest(a, b) <= 0.03e0
    ELSE (greatest(a, b) - least(a, b)) / greatest(a, b) <= 0.015e0 END"""


@query(
    "p13_values_merge",
    f"SELECT ordinal, a, b, {_MERGE_SQL} AS can_merge FROM (SELECT event_id AS ordinal, event_id * 97 % 3000000 AS a, event_id * 97 % 3000000 + event_id % 11 * (event_id % 2000) AS b FROM events)",
)
def _(spark, sf):
    e = ad.table(spark, sf, "events").select(
        F.col("event_id").alias("ordinal"),
        F.expr("event_id * 97 % 3000000").alias("a"),
        F.expr("event_id * 97 % 3000000 + event_id % 11 * (event_id % 2000)").alias("b"),
    )
    return e.select("*", sc.values_merge(F.col("a"), F.col("b")).alias("can_merge"))


@query(
    "p14_frame_time",
    """SELECT ordinal, frame, fps, CASE WHEN fps > 0 AND frame >= 0 THEN CAST(round_even(frame / fps * 1000, 0) AS BIGINT) END AS timestamp_ms
       FROM (SELECT event_id AS ordinal, event_id - 5 AS frame, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 64 AS DOUBLE) END AS fps FROM events)""",
)
def _(spark, sf):
    e = ad.table(spark, sf, "events").select(
        F.col("event_id").alias("ordinal"),
        (F.col("event_id") - 5).alias("frame"),
        F.when(F.col("event_id") % 17 != 0, (F.col("event_id") % 64).cast("double")).alias("fps"),
    )
    return e.select("*", geo.timestamp_ms(F.col("frame"), F.col("fps")).alias("timestamp_ms"))


_POWERS = "1, 10, 100, 1000, 10000, 100000, 1000000, 10000000"


@query(
    "p15_display",
    f"""SELECT ordinal, n, CASE WHEN n = 0 THEN '0' WHEN n < 1000 THEN CAST(n AS VARCHAR)
        WHEN n < 1000000 THEN regexp_replace(printf('%.1f', n / 1e3), '\\.0$', '') || 'K'
        WHEN n < 1000000000 THEN regexp_replace(printf('%.1f', n / 1e6), '\\.0$', '') || 'M'
        WHEN n < 1000000000000 THEN regexp_replace(printf('%.1f', n / 1e9), '\\.0$', '') || 'B'
        ELSE regexp_replace(printf('%.1f', n / 1e12), '\\.0$', '') || 'T' END AS short,
        CASE WHEN value = floor(value) THEN format('{{:,}}', CAST(value AS BIGINT)) ELSE format('{{:,.2f}}', value) END AS grouped,
        lpad(CAST(n // 60000 AS VARCHAR), greatest(2, length(CAST(n // 60000 AS VARCHAR)))::INTEGER, '0') || ':' || lpad(CAST(n // 1000 % 60 AS VARCHAR), 2, '0') AS clock
        FROM (SELECT event_id AS ordinal, (event_id * 9973 % 1000003) * [{_POWERS}][event_id % 8 + 1] AS n, value * 1000 AS value FROM events)""",
)
def _(spark, sf):
    powers = ", ".join(f"{10**k}L" for k in range(8))
    e = ad.table(spark, sf, "events").select(
        F.col("event_id").alias("ordinal"),
        F.expr(f"(event_id * 9973 % 1000003) * element_at(array({powers}), cast(event_id % 8 + 1 as int))").alias("n"),
        (F.col("value") * 1000).alias("value"),
    )
    return e.select(
        "ordinal", "n", tx.short_number(F.col("n")).alias("short"), tx.grouped_number(F.col("value")).alias("grouped"), tx.clock(F.col("n")).alias("clock")
    )


@query(
    "p16_roi_filter",
    """SELECT session_id, count(*) AS boxes_inside, CAST(sum(clip_w) AS BIGINT) AS clipped_width FROM (
        SELECT *, greatest(0, least(width, 260 - "left")) AS clip_w FROM boxes)
        WHERE "left" >= CAST(trunc(1280 * 0.05e0) AS INTEGER) AND top >= CAST(trunc(720 * 0.02e0) AS INTEGER)
        AND "right" < CAST(trunc(1280 * 0.05e0) AS INTEGER) + CAST(trunc(1280 * 0.20e0) AS INTEGER)
        AND bottom < CAST(trunc(720 * 0.02e0) AS INTEGER) + CAST(trunc(720 * 0.15e0) AS INTEGER) GROUP BY 1""",
    ["boxes"],
)
def _(spark, sf):
    b = ad.boxes(spark, sf)
    roi = geo.scale_roi(F.lit(1280), F.lit(720), 0.05, 0.02, 0.20, 0.15)
    kept = b.filter(geo.inside(roi, F.col("left"), F.col("top"), F.col("right"), F.col("bottom")))
    clipped = geo.clip_extent(F.col("left"), F.col("width"), F.lit(260))
    return kept.groupBy("session_id").agg(F.count("*").alias("boxes_inside"), F.sum(clipped).alias("clipped_width"))


def bucket_sql(col: str, buckets) -> str:
    body = " ".join(f"WHEN {col} < {u} THEN '{lab}'" for lab, u in buckets[:-1])
    return f"CASE WHEN {col} IS NULL THEN NULL {body} ELSE '{buckets[-1][0]}' END"


@query(
    "p17_buckets",
    f"""SELECT ordinal, {bucket_sql('confidence', sc.CONFIDENCE_BUCKETS)} AS confidence_bucket, {bucket_sql('value', sc.DAMAGE_BUCKETS)} AS damage_bucket
        FROM (SELECT event_id AS ordinal, CASE WHEN event_id % 13 > 0 THEN (event_id % 11) / 10e0 END AS confidence, (event_id % 2000000) * (event_id % 2000000) % 2000000 AS value FROM events)""",
)
def _(spark, sf):
    i = F.col("event_id")
    return ad.table(spark, sf, "events").select(
        i.alias("ordinal"),
        sc.bucket_label(F.when(i % 13 > 0, (i % 11) / 10.0), sc.CONFIDENCE_BUCKETS).alias("confidence_bucket"),
        sc.bucket_label((i % 2000000) * (i % 2000000) % 2000000, sc.DAMAGE_BUCKETS).alias("damage_bucket"),
    )


@query(
    "p18_top_frame_count",
    """SELECT session_id, frames, CASE WHEN frames <= 0 THEN 6 ELSE CAST(least(greatest(round_even(frames * 0.12e0, 0), 6), 30) AS INTEGER) END AS top_frames
       FROM (SELECT session_id, count(DISTINCT frame_index) AS frames FROM hits GROUP BY 1)""",
    ["hits"],
)
def _(spark, sf):
    frames = ad.hits(spark, sf).groupBy("session_id").agg(F.count_distinct("frame_index").alias("frames"))
    return frames.select("*", geo.top_frame_count(F.col("frames")).alias("top_frames"))


@query(
    "p19_config_hash",
    """SELECT c_custkey, substring(md5(concat_ws(';', 'min_confidence=' || CAST(c_custkey % 100 AS VARCHAR), 'segment=' || c_mktsegment,
        'max_lines=' || CAST(c_nationkey AS VARCHAR))), 1, 8) AS config_hash FROM customer""",
)
def _(spark, sf):
    c = ad.table(spark, sf, "customer")

    def part(name, col):
        return F.concat(F.lit(f"{name}="), col.cast("string"))

    return c.select(
        "c_custkey",
        tx.config_hash(part("min_confidence", F.col("c_custkey") % 100), part("segment", F.col("c_mktsegment")), part("max_lines", F.col("c_nationkey"))).alias("config_hash"),
    )


@query(
    "p20_export_rounding",
    """SELECT event_id, round(value / 7, 4) AS confidence, round(value / 3, 2) AS processing_ms, round(value / 9, 3) AS stage_ms FROM events""",
)
def _(spark, sf):
    v = F.col("value")
    return ad.table(spark, sf, "events").select(
        "event_id", F.round(v / 7, 4).alias("confidence"), F.round(v / 3, 2).alias("processing_ms"), F.round(v / 9, 3).alias("stage_ms")
    )


@query(
    "s2_frame_number",
    """SELECT name, CASE WHEN regexp_matches(name, 'frame_[0-9]+') THEN TRY_CAST(regexp_extract(name, 'frame_([0-9]+)', 1) AS INTEGER) ELSE -1 END AS frame_index
       FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'still_' || event_id || '.png' ELSE 'frame_' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '.png' END AS name FROM events)""",
)
def _(spark, sf):
    i = F.col("event_id").cast("string")
    name = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("still_"), i, F.lit(".png"))).otherwise(
        F.concat(F.lit("frame_"), F.lpad(i, 6, "0"), F.lit(".png"))
    )
    return ad.table(spark, sf, "events").select(name.alias("name")).select("name", tx.frame_number(F.col("name")).alias("frame_index"))
