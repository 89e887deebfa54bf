"""Aggregations, windows and logs (A and W rows, as-of lookup)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions import scoring as sc, text as tx
from emberlog.operators import stats as st
from emberlog.operators.timeline import dense_buckets
from emberlog.plans import adapters as ad
from emberlog.plans.catalog_text import (
    FEATURES_SQL, KIND_SQL, READINGS_SQL, STRIP_SQL, WEIGHTED_SQL, bucket_sql, featured, scored_readings, text_sql,
)
from emberlog.plans.registry import query

HOUR = 3_600_000
DAY = 24 * HOUR


def sessions(spark, sf):
    c = ad.table(spark, sf, "customer")
    return c.select(F.expr("c_custkey div 8").alias("session_id"))


@query(
    "a1_session_totals",
    """SELECT s.session_id, coalesce(total_damage, 0) AS total_damage, coalesce(hit_count, 0) AS hit_count, coalesce(biggest_hit, 0) AS biggest_hit,
       coalesce(total_damage / hit_count, 0e0) AS average_hit FROM (SELECT DISTINCT c_custkey // 8 AS session_id FROM customer) s LEFT JOIN
       (SELECT session_id, CAST(sum(parsed_value) AS BIGINT) AS total_damage, count(*) AS hit_count, max(parsed_value) AS biggest_hit FROM hits GROUP BY 1) h USING (session_id)""",
    ["hits"],
)
def _(spark, sf):
    return st.session_totals(ad.hits(spark, sf), sessions(spark, sf))


@query(
    "a2_dps_timeline",
    f"""WITH b AS (SELECT session_id, timestamp_ms // {HOUR} AS bucket, CAST(sum(parsed_value) AS BIGINT) AS damage, count(*) AS hit_count FROM hits GROUP BY 1, 2),
        f AS (SELECT session_id, unnest(range(0, max(bucket) + 1)) AS bucket FROM b GROUP BY session_id)
        SELECT session_id, bucket * {HOUR} AS start_ms, (bucket + 1) * {HOUR} AS end_ms, coalesce(damage, 0) AS damage, coalesce(hit_count, 0) AS hit_count,
        coalesce(damage, 0) / 3600e0 AS dps FROM f LEFT JOIN b USING (session_id, bucket)""",
    ["hits"],
)
def _(spark, sf):
    return st.dps_timeline(ad.hits(spark, sf), bucket_ms=HOUR)


@query(
    "a3_top_hits",
    """SELECT session_id, ordinal, parsed_value, frame_index, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id
       ORDER BY parsed_value DESC, frame_index, ordinal) AS rn FROM hits) WHERE rn <= 5""",
    ["hits"],
)
def _(spark, sf):
    return st.top_hits(ad.hits(spark, sf)).select("session_id", "ordinal", "parsed_value", "frame_index", "rank")


@query(
    "a4_coverage",
    f"""SELECT session_id, count(*) AS candidate_count, count(*) FILTER (text <> '') AS recognized_count, count(val) AS parsed_count,
        count(*) FILTER (confidence >= 0.6e0) AS confident_count FROM {READINGS_SQL} GROUP BY 1""",
    ["texts"],
)
def _(spark, sf):
    return st.coverage(scored_readings(spark, sf))


def metadata(spark, sf):
    c = ad.table(spark, sf, "customer").filter(F.col("c_custkey") % 8 == 0)
    sid = F.expr("c_custkey div 8")
    return c.select(
        sid.alias("session_id"),
        F.when(sid % 3 != 0, (F.col("c_nationkey") + 10).cast("double")).alias("fps"),
        F.when(sid % 5 != 0, F.col("c_custkey") * 7 + 1).alias("frames_written"),
    )


@query(
    "a5_duration",
    """SELECT m.session_id, CAST(coalesce(CASE WHEN fps > 0 AND frames_written IS NOT NULL THEN round_even(frames_written / fps * 1000, 0) END, last, 0) AS BIGINT) AS duration_ms
       FROM (SELECT c_custkey // 8 AS session_id, CASE WHEN c_custkey // 8 % 3 <> 0 THEN CAST(c_nationkey + 10 AS DOUBLE) END AS fps,
       CASE WHEN c_custkey // 8 % 5 <> 0 THEN c_custkey * 7 + 1 END AS frames_written FROM customer WHERE c_custkey % 8 = 0) m
       LEFT JOIN (SELECT session_id, max(timestamp_ms) AS last FROM hits GROUP BY 1) h USING (session_id)""",
    ["hits"],
)
def _(spark, sf):
    return st.durations(metadata(spark, sf), ad.hits(spark, sf))


_TIMELINE_SQL = f"""(SELECT r.session_id, b, coalesce(damage, 0) AS damage, coalesce(hit_count, 0) AS hit_count
    FROM (SELECT session_id, unnest(range(max(timestamp_ms) // {HOUR} + 1)) AS b FROM hits GROUP BY 1) r
    LEFT JOIN (SELECT session_id, timestamp_ms // {HOUR} AS b, CAST(sum(parsed_value) AS BIGINT) AS damage, count(*) AS hit_count FROM hits GROUP BY 1, 2) f USING (session_id, b))"""


@query(
    "a_combat_summary",
    f"""WITH m AS (SELECT c_custkey // 8 AS session_id, CASE WHEN c_custkey // 8 % 3 <> 0 THEN CAST(c_nationkey + 10 AS DOUBLE) END AS fps,
            CASE WHEN c_custkey // 8 % 5 <> 0 THEN c_custkey * 7 + 1 END AS frames_written FROM customer WHERE c_custkey % 8 = 0),
        h AS (SELECT session_id, CAST(sum(parsed_value) AS BIGINT) AS total_damage, count(*) AS hit_count, max(parsed_value) AS biggest_hit, max(timestamp_ms) AS last FROM hits GROUP BY 1),
        t AS (SELECT session_id, list(parsed_value ORDER BY rn) AS top_values, list(frame_index ORDER BY rn) AS top_frames FROM
            (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY parsed_value DESC, frame_index, ordinal) AS rn FROM hits) WHERE rn <= 5 GROUP BY 1),
        c AS (SELECT session_id, count(*) AS candidate_count, count(*) FILTER (text <> '') AS recognized_count, count(val) AS parsed_count, count(*) FILTER (confidence >= 0.6e0) AS confident_count
            FROM {READINGS_SQL} GROUP BY 1),
        l AS (SELECT session_id, count(*) AS n_buckets, max(damage / 3600e0) AS peak_dps FROM {_TIMELINE_SQL} GROUP BY 1)
        SELECT session_id, coalesce(total_damage, 0) AS total_damage, coalesce(hit_count, 0) AS hit_count, coalesce(biggest_hit, 0) AS biggest_hit, coalesce(total_damage / hit_count, 0e0) AS average_hit,
            CAST(coalesce(CASE WHEN fps > 0 AND frames_written IS NOT NULL THEN round_even(frames_written / fps * 1000, 0) END, last, 0) AS BIGINT) AS duration_ms,
            coalesce(candidate_count, 0) AS candidate_count, coalesce(recognized_count, 0) AS recognized_count, coalesce(parsed_count, 0) AS parsed_count, coalesce(confident_count, 0) AS confident_count,
            coalesce(n_buckets, 0) AS n_buckets, coalesce(peak_dps, 0e0) AS peak_dps, coalesce(top_values, []) AS top_values, coalesce(top_frames, []) AS top_frames
        FROM m LEFT JOIN h USING (session_id) LEFT JOIN t USING (session_id) LEFT JOIN c USING (session_id) LEFT JOIN l USING (session_id)""",
    ["hits", "texts"],
)
def _(spark, sf):
    return st.combat_summary(ad.hits(spark, sf), scored_readings(spark, sf), metadata(spark, sf), HOUR)


@query(
    "a2_timeline_parts",
    f"""SELECT session_id, b // 256 AS part, min(b) * {HOUR} AS start_ms, list(damage ORDER BY b) AS damage, list(hit_count ORDER BY b) AS hits FROM {_TIMELINE_SQL} GROUP BY 1, 2""",
    ["hits"],
)
def _(spark, sf):
    return st.timeline_parts(st.dps_timeline(ad.hits(spark, sf), HOUR), HOUR, rows=256)


@query(
    "a6_candidate_kinds",
    f"""SELECT session_id, kind, count(*) AS candidates, CAST(coalesce(sum(CASE WHEN kind = 'damage' THEN val END), 0) AS BIGINT) AS parsed_damage
        FROM (SELECT *, {KIND_SQL} AS kind FROM (SELECT *, {STRIP_SQL} AS st FROM {text_sql('texts', 'text')})) GROUP BY 1, 2""",
    ["texts"],
)
def _(spark, sf):
    return st.candidate_kinds(ad.texts(spark, sf), ["session_id"])


@query(
    "a6_top_unknown",
    f"""SELECT session_id, text, n, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f) AS rn FROM (
        SELECT session_id, text, count(*) AS n, min(ordinal) AS f FROM (SELECT *, {KIND_SQL} AS kind FROM (SELECT *, {STRIP_SQL} AS st FROM texts))
        WHERE kind = 'unknown' GROUP BY 1, 2)) WHERE rn <= 5""",
    ["texts"],
)
def _(spark, sf):
    return st.top_unknown(ad.texts(spark, sf), ["session_id"])


@query(
    "a7_session_metrics",
    """SELECT session_id, count(*) AS total_frames, CAST(sum(candidates) AS BIGINT) AS total_candidates, CAST(sum(hits) AS BIGINT) AS total_hits,
       CAST(sum(rejected) AS BIGINT) AS total_rejected, CAST(coalesce(sum(damage) FILTER (hits > 0), 0) AS BIGINT) AS total_damage,
       coalesce(max(damage) FILTER (hits > 0), 0) AS biggest_hit,
       round(CASE WHEN sum(hits) > 0 THEN sum(max_confidence * hits) / sum(hits) ELSE 0 END, 6) AS avg_confidence,
       round(CASE WHEN sum(candidates) > 0 THEN sum(hits) / sum(candidates) ELSE 0 END, 6) AS acceptance_rate,
       round(avg(processing_time_ms), 6) AS avg_processing_time_ms, round(sum(processing_time_ms) / 1000, 6) AS duration_seconds,
       round(CASE WHEN sum(processing_time_ms) > 0 THEN count(*) / (sum(processing_time_ms) / 1000) ELSE 0 END, 6) AS fps_achieved FROM frame_log GROUP BY 1""",
    ["frame_log"],
)
def _(spark, sf):
    return st.session_metrics(ad.frame_log(spark, sf))


@query(
    "a8_rejection_reasons",
    "SELECT session_id, reason, count(*) AS n FROM (SELECT session_id, unnest(reasons) AS reason FROM rejections WHERE k >= 5) GROUP BY 1, 2",
    ["rejections"],
)
def _(spark, sf):
    return st.rejection_reasons(ad.rejections(spark, sf), min_confidence=0.05)


def _histogram_sql(value: str, buckets, source: str) -> str:
    labels = ", ".join(f"('{lab}')" for lab, _ in buckets)
    return f"""SELECT s.session_id, b.bucket, count(h.label) AS n FROM (SELECT DISTINCT session_id FROM {source}) s
        CROSS JOIN (VALUES {labels}) b(bucket) LEFT JOIN (SELECT session_id, {bucket_sql(value, buckets)} AS label FROM {source}) h
        ON h.session_id = s.session_id AND h.label = b.bucket GROUP BY 1, 2"""


@query("a9_confidence_histogram", _histogram_sql("confidence", sc.CONFIDENCE_BUCKETS, "hits"), ["hits"])
def _(spark, sf):
    return st.histogram(ad.hits(spark, sf), F.col("confidence"), sc.CONFIDENCE_BUCKETS)


@query("a9_damage_histogram", _histogram_sql("parsed_value", sc.DAMAGE_BUCKETS, "hits"), ["hits"])
def _(spark, sf):
    return st.histogram(ad.hits(spark, sf), F.col("parsed_value"), sc.DAMAGE_BUCKETS)


@query(
    "a10_frame_rate",
    """SELECT session_id, count(*) AS total_frames, round(avg(d), 6) AS avg_frame_time_s, round(min(d), 6) AS min_frame_time_s, round(max(d), 6) AS max_frame_time_s,
       round(stddev_pop(d), 6) AS std_dev_s, round(CASE WHEN avg(d) > 0 THEN 1 / avg(d) ELSE 0 END, 2) AS avg_fps,
       round(CASE WHEN max(d) > 0 THEN 1 / max(d) ELSE 0 END, 2) AS min_fps, round(CASE WHEN min(d) > 0 THEN 1 / min(d) ELSE 0 END, 2) AS max_fps
       FROM (SELECT session_id, (timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY timestamp_ms, ordinal)) / 1000e0 AS d FROM hits)
       GROUP BY 1 HAVING count(*) >= 2""",
    ["hits"],
)
def _(spark, sf):
    return st.frame_rate(ad.hits(spark, sf), width=DAY)


def confusion(spark, sf):
    z = featured(ad.samples(spark, sf)).select("label", "width", sc.weighted_score().alias("z"))
    return z.select("label", (F.col("width") % 5).alias("grp"), (sc.logistic(F.col("z")) >= 0.5).cast("int").alias("predicted"))


RATES_SQL = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1_score"""


@query(
    "a11_rates",
    f"SELECT session_id, run, tp, fp, fn, {RATES_SQL}, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS accuracy FROM runs",
    ["runs"],
)
def _(spark, sf):
    return st.with_rates(ad.runs(spark, sf)).drop("fps")


_STAGE_SQL = """SELECT {keys}, count(*) AS calls, round(sum(elapsed_ms), 4) AS total, min(elapsed_ms) AS lo, max(elapsed_ms) AS hi, round(avg(elapsed_ms), 6) AS mean,
    round(stddev_pop(elapsed_ms), 6) AS sd, round(quantile_cont(elapsed_ms, 0.5), 6) AS p50, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95,
    round(quantile_cont(elapsed_ms, 0.99), 6) AS p99 FROM stage_timings GROUP BY ALL"""


def _rounded_profile(df):
    return df.withColumns({"total": F.round("total", 4), **{c: F.round(c, 6) for c in ("mean", "sd", "p50", "p95", "p99")}})


@query("a14_stage_profile", _STAGE_SQL.format(keys="session_id, stage"), ["stage_timings"])
def _(spark, sf):
    return _rounded_profile(st.stage_profile(ad.stage_timings(spark, sf), ["session_id", "stage"]))


@query("a14_stage_profile_overall", _STAGE_SQL.format(keys="stage"), ["stage_timings"])
def _(spark, sf):
    return _rounded_profile(st.stage_profile(ad.stage_timings(spark, sf), ["stage"]))


@query(
    "a15_bottlenecks",
    """WITH p AS (SELECT session_id, stage, sum(elapsed_ms) AS total, avg(elapsed_ms) AS mean, stddev_pop(elapsed_ms) AS sd, quantile_cont(elapsed_ms, 0.99) AS p99 FROM stage_timings GROUP BY 1, 2),
       f AS (SELECT l_suppkey AS session_id, sum(l_quantity + l_discount * 100 + l_tax * 100) AS spent, count(*) * 1000 / sum(l_quantity + l_discount * 100 + l_tax * 100) AS fps FROM lineitem GROUP BY 1)
       SELECT session_id, arg_max(stage, (total, stage)) AS slowest_stage, round(max(total) / sum(total) * 100, 4) AS slowest_percent, max(total) > sum(total) * 0.5 AS is_bottleneck,
       coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (sd > mean * 0.5), '') AS high_variance, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (p99 > mean * 3), '') AS p99_spikes,
       round(greatest(0, max(spent) - sum(total)), 4) AS overhead_ms, round(max(fps), 4) AS fps_achieved, max(fps) < 27 AS fps_below_target,
       concat_ws('; ', CASE WHEN max(total) > sum(total) * 0.5 THEN 'Optimize ' || arg_max(stage, (total, stage)) END, string_agg('Reduce variance in ' || stage, '; ' ORDER BY stage) FILTER (sd > mean * 0.5),
         CASE WHEN max(fps) < 27 THEN 'Raise the frame rate to 30' END, string_agg('Investigate P99 spikes of ' || stage, '; ' ORDER BY stage) FILTER (p99 > mean * 3)) AS recommendations
       FROM p JOIN f USING (session_id) GROUP BY 1""",
    ["stage_timings"],
)
def _(spark, sf):
    profile = st.stage_profile(ad.stage_timings(spark, sf), ["session_id", "stage"])
    li = ad.table(spark, sf, "lineitem")
    spent = li.select(F.col("l_suppkey").alias("session_id"), (F.col("l_quantity") + F.col("l_discount") * 100 + F.col("l_tax") * 100).alias("frame_ms"))
    return st.stage_findings(profile, spent)


@query(
    "a16_memory_profile",
    """WITH s AS (SELECT session_id, stage, count(*) AS n, max(rss_mb) AS hi, avg(rss_mb) AS mean FROM memory_samples GROUP BY 1, 2),
       k AS (SELECT session_id, count(*) FILTER (n > 1 AND hi > mean * 1.5) AS spikes FROM s GROUP BY 1)
       SELECT session_id, count(*) AS samples, max(rss_mb) AS peak, round(avg(rss_mb), 6) AS mean, min(rss_mb) AS low,
       arg_max(rss_mb, frame_index) - arg_min(rss_mb, frame_index) AS growth,
       count(*) >= 10 AND arg_max(rss_mb, frame_index) - arg_min(rss_mb, frame_index) > 50 AS has_leak,
       CASE WHEN count(*) >= 10 THEN max(spikes) ELSE 0 END AS spike_stages FROM memory_samples JOIN k USING (session_id) GROUP BY 1""",
    ["memory_samples"],
)
def _(spark, sf):
    return st.memory_profile(ad.memory_samples(spark, sf))


_CHOICE_SQL = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) AS rn FROM (SELECT session_id, frame_index,
    CASE WHEN frame_index % 50 = 0 THEN 'periodic' WHEN rejected > 3 THEN 'rejection' WHEN hits > 1 THEN 'acceptance' WHEN max_confidence < 0.65e0 AND max_confidence > 0 THEN 'low_confidence'
    WHEN max_confidence >= 0.95e0 THEN 'high_confidence' END AS reason FROM frame_log) WHERE reason IS NOT NULL) WHERE rn <= 100)"""


def choice(spark, sf):
    log = ad.frame_log(spark, sf)
    shifted = log.withColumn("rejected", F.greatest(F.col("rejected") - 3, F.lit(0))).withColumn("hits", F.greatest(F.col("hits") - 1, F.lit(0)))
    return st.snapshot_choice(shifted, every=50)


@query("w9_snapshot_choice", f"SELECT session_id, frame_index, reason, CAST(rn AS INTEGER) AS rank FROM {_CHOICE_SQL}", ["frame_log"])
def _(spark, sf):
    return choice(spark, sf).select("session_id", "frame_index", "reason", "rank")


@query("a17_snapshot_counts", f"SELECT reason, count(*) AS n FROM {_CHOICE_SQL} GROUP BY 1", ["frame_log"])
def _(spark, sf):
    return st.snapshot_counts(choice(spark, sf), [])


def track_votes(spark, sf):
    return ad.hits(spark, sf).withColumn("track_id", F.col("ordinal") % 40)


_WINNER_SQL = """WITH v AS (SELECT session_id, ordinal % 40 AS track_id, parsed_value, count(*) AS n, sum(confidence) AS conf, {w} AS w, min((frame_index, ordinal)) AS f FROM hits GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, track_id ORDER BY round(w, 9) DESC, f) AS rn, sum(w) OVER (PARTITION BY session_id, track_id) AS tw,
      CAST(sum(n) OVER (PARTITION BY session_id, track_id) AS BIGINT) AS total_votes, count(*) OVER (PARTITION BY session_id, track_id) AS values_seen FROM v)
    SELECT session_id, track_id, parsed_value AS final_value, n AS vote_count, total_votes, values_seen, round(w / tw, 6) AS agreement_ratio, round(conf / n * (w / tw), 6) AS confidence
    FROM r WHERE rn = 1 AND total_votes >= 2"""


@query("a19_vote_winners", _WINNER_SQL.format(w="sum(confidence)"), ["hits"])
def _(spark, sf):
    return st.vote_winners(track_votes(spark, sf), ["session_id", "track_id"])


@query("a19_majority_winners", _WINNER_SQL.format(w="CAST(count(*) AS DOUBLE)"), ["hits"])
def _(spark, sf):
    return st.vote_winners(track_votes(spark, sf), ["session_id", "track_id"], weighted=False)


@query(
    "a20_vote_statistics",
    """SELECT session_id, CAST(sum(n) AS BIGINT) AS total_votes, count(*) AS total_tracks, round(avg(n), 6) AS avg_votes_per_track, max(n) AS max_votes_per_track, min(n) AS min_votes_per_track
       FROM (SELECT session_id, ordinal % 40 AS t, count(*) AS n FROM hits GROUP BY 1, 2) GROUP BY 1""",
    ["hits"],
)
def _(spark, sf):
    return st.vote_statistics(track_votes(spark, sf), "session_id", "track_id")


@query(
    "a21_sample_report",
    """SELECT member_count, count(*) AS total_samples, count(*) FILTER (label = 1) AS positive_samples, count(*) FILTER (label <> 1) AS negative_samples,
       round(count(*) FILTER (label = 1) / count(*), 6) AS positive_ratio, CASE WHEN count(*) FILTER (label = 1) / count(*) BETWEEN 0.3 AND 0.7 THEN 'balanced' ELSE 'imbalanced' END AS class_balance,
       round(coalesce(avg(line_score) FILTER (label = 1), 0), 6) AS avg_score_positive, round(coalesce(avg(line_score) FILTER (label <> 1), 0), 6) AS avg_score_negative FROM samples GROUP BY 1""",
    ["samples"],
)
def _(spark, sf):
    return st.sample_report(ad.samples(spark, sf), ["member_count"])


@query(
    "a22_classifier_report",
    f"""SELECT *, {RATES_SQL}, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM (SELECT grp, count(*) FILTER (label = 1 AND p = 1) AS tp, count(*) FILTER (label = 0 AND p = 1) AS fp,
        count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = 0 AND p = 0) AS tn
        FROM (SELECT label, width % 5 AS grp, CASE WHEN 1 / (1 + exp(-({WEIGHTED_SQL}))) >= 0.5 THEN 1 ELSE 0 END AS p FROM {FEATURES_SQL}) GROUP BY 1)""",
    ["samples"],
)
def _(spark, sf):
    return st.classifier_report(confusion(spark, sf), ["grp"])


@query(
    "a25_capture_statistics",
    """SELECT session_id, total_frames, total_duration_ms, min_frame_time_ms, max_frame_time_ms, avg_capture_time_ms,
       CASE WHEN total_duration_ms > 0 THEN round(total_frames / (total_duration_ms / 1000e0), 6) ELSE 0 END AS avg_fps FROM
       (SELECT session_id, count(*) AS total_frames, max(timestamp_ms) AS total_duration_ms, min(c) AS min_frame_time_ms, max(c) AS max_frame_time_ms,
        round(avg(c) FILTER (rn <= 120), 6) AS avg_capture_time_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_ms DESC, ordinal DESC) AS rn
        FROM (SELECT *, confidence * 40 AS c FROM hits)) GROUP BY 1)""",
    ["hits"],
)
def _(spark, sf):
    return st.capture_statistics(ad.hits(spark, sf).withColumn("capture_ms", F.col("confidence") * 40))


@query("a26_annotation_totals", "SELECT session_id, CAST(sum(value) AS BIGINT) AS total_damage, count(*) AS hit_count FROM truth GROUP BY 1", ["truth"])
def _(spark, sf):
    return ad.truth(spark, sf).groupBy("session_id").agg(F.sum("value").alias("total_damage"), F.count("*").alias("hit_count"))


@query(
    "w1_rolling_damage",
    f"""SELECT DISTINCT session_id, timestamp_ms, CAST(sum(parsed_value) OVER w AS BIGINT) AS rolling_damage, CAST(sum(parsed_value) OVER w AS BIGINT) / {6 * HOUR // 1000}e0 AS rolling_dps FROM hits
        WINDOW w AS (PARTITION BY session_id ORDER BY timestamp_ms RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)""",
    ["hits"],
)
def _(spark, sf):
    return st.rolling_damage(ad.hits(spark, sf), window_ms=6 * HOUR)


_RUN_SQL = """SELECT session_id, timestamp_ms, CAST(sum(d) OVER w AS BIGINT) AS total_damage, CAST(sum(n) OVER w AS BIGINT) AS hit_count, max(m) OVER w AS peak_hit,
    CAST(sum(d) OVER w AS BIGINT) / CAST(sum(n) OVER w AS BIGINT) AS average_hit, l AS last_hit FROM (SELECT session_id, timestamp_ms, sum(parsed_value) AS d, count(*) AS n, max(parsed_value) AS m,
    arg_max(parsed_value, (frame_index, ordinal)) AS l FROM hits GROUP BY 1, 2) WINDOW w AS (PARTITION BY session_id ORDER BY timestamp_ms)"""


@query("w2_running_stats", _RUN_SQL, ["hits"])
def _(spark, sf):
    return st.running_stats(ad.hits(spark, sf), width=DAY)


@query(
    "w3_hit_log",
    """SELECT session_id, ordinal, parsed_value, CAST(rn AS INTEGER) AS age FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_ms DESC, frame_index DESC, ordinal DESC) AS rn FROM hits) WHERE rn <= 50""",
    ["hits"],
)
def _(spark, sf):
    return st.hit_log(ad.hits(spark, sf)).select("session_id", "ordinal", "parsed_value", "age")


_MOTION_SQL = """WITH d AS (SELECT *, ordinal % 40 AS track_id, frame_index - lag(frame_index) OVER w AS df, center_x - lag(center_x) OVER w AS dx, center_y - lag(center_y) OVER w AS dy FROM hits
    WINDOW w AS (PARTITION BY session_id, ordinal % 40 ORDER BY frame_index, ordinal)),
    m AS (SELECT session_id, track_id, count(*) AS votes, min(frame_index) AS first_frame, max(frame_index) AS last_frame, coalesce(avg(dx / greatest(df, 1)), 0e0) AS vx, coalesce(avg(dy / greatest(df, 1)), 0e0) AS vy,
    arg_max(center_x, (frame_index, ordinal)) AS x, arg_max(center_y, (frame_index, ordinal)) AS y FROM d GROUP BY 1, 2)
    SELECT session_id, track_id, votes, first_frame, last_frame, round(vx, 6) AS velocity_x, round(vy, 6) AS velocity_y, round(x + vx * 5, 6) AS predicted_x, round(y + vy * 5, 6) AS predicted_y FROM m"""


@query("w4_w5_track_motion", _MOTION_SQL, ["hits"])
def _(spark, sf):
    return st.track_motion(track_votes(spark, sf), ["session_id", "track_id"], width=128)


@query(
    "w4_recent_velocity",
    """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index DESC, ordinal DESC) AS rn FROM hits) WHERE rn <= 100),
       d AS (SELECT session_id, greatest(frame_index - lag(frame_index) OVER w, 1) AS df, center_x - lag(center_x) OVER w AS dx, center_y - lag(center_y) OVER w AS dy FROM r
       WINDOW w AS (PARTITION BY session_id ORDER BY frame_index, ordinal))
       SELECT session_id, count(*) AS positions, round(CASE WHEN count(*) < 5 THEN 0 ELSE avg(dx / df) END, 6) AS velocity_x, round(CASE WHEN count(*) < 5 THEN -2 ELSE avg(dy / df) END, 6) AS velocity_y FROM d GROUP BY 1""",
    ["hits"],
)
def _(spark, sf):
    return st.recent_velocity(ad.hits(spark, sf))


def motion(spark, sf):
    """One motion score and one expansion per session frame."""
    per = ad.hits(spark, sf).groupBy("session_id", "frame_index").agg(F.sum("center_x").alias("motion"), F.max("ordinal").alias("_o"))
    return per.withColumn("expansion", F.when(F.col("_o") % 9 == 0, F.lit(50)).otherwise(0)).drop("_o")


_MOTION_VIEW = """(SELECT session_id, frame_index, sum(center_x) AS motion, CASE WHEN max(ordinal) % 9 = 0 THEN 50 ELSE 0 END AS expansion FROM hits GROUP BY 1, 2)"""


@query(
    "w8_motion_trend",
    f"""SELECT session_id, frame_index, round(a, 6) AS recent_motion, CASE WHEN n >= 5 AND a > 150 THEN least(expansion + 50, 200) ELSE expansion END AS predicted_expansion
        FROM (SELECT *, avg(motion) OVER w AS a, count(*) OVER w AS n FROM {_MOTION_VIEW} WINDOW w AS (PARTITION BY session_id ORDER BY frame_index ROWS 4 PRECEDING))""",
    ["hits"],
)
def _(spark, sf):
    return st.motion_trend(motion(spark, sf), threshold=100.0, current="expansion")


@query(
    "k8_roi_state",
    f"""SELECT session_id, frame_index, expansion, greatest(0, 288 - expansion) AS "left", greatest(0, 54 - expansion) AS top, 1632 + expansion AS "right", 864 + expansion AS bottom,
        CASE WHEN expansion > 0 THEN 'motion_detected' ELSE '' END AS reason, round(1 - expansion / 200, 6) AS confidence,
        coalesce(greatest(0, 30 - (pos - last)), 0) AS cooldown FROM (SELECT *, max(CASE WHEN expansion > 0 THEN pos END) OVER (PARTITION BY session_id ORDER BY pos) AS last
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) AS pos FROM {_MOTION_VIEW}))""",
    ["hits"],
)
def _(spark, sf):
    return st.roi_state(motion(spark, sf))


@query(
    "j10_state_at",
    f"""WITH s AS ({_RUN_SQL}), t AS (SELECT session_id, unnest(range(0, max(timestamp_ms) // {6 * HOUR} + 1)) * {6 * HOUR} AS tick_ms FROM hits GROUP BY 1)
        SELECT t.session_id, tick_ms, coalesce(total_damage, 0) AS total_damage, coalesce(hit_count, 0) AS hit_count, coalesce(peak_hit, 0) AS peak_hit, last_hit
        FROM t ASOF LEFT JOIN s ON t.session_id = s.session_id AND t.tick_ms >= s.timestamp_ms""",
    ["hits"],
)
def _(spark, sf):
    h = ad.hits(spark, sf)
    bounds = h.groupBy("session_id").agg(F.floor(F.max("timestamp_ms") / (6 * HOUR)).alias("last"))
    ticks = dense_buckets(bounds, ["session_id"], "last", "b").select("session_id", (F.col("b") * 6 * HOUR).alias("tick_ms"))
    return st.state_at(h, ticks, width=DAY)
