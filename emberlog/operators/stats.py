"""Session statistics: totals, timelines, histograms, profiles, running and rolling state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog.functions import scoring as sc, text as tx
from emberlog.operators.timeline import dense_buckets, positions, previous_row, quantiles, running, top_k, trailing

MS_WIDTH = 600_000  # bin width for millisecond axes


def session_totals(hits: DataFrame, sessions: DataFrame | None = None, key: str = "session_id") -> DataFrame:
    """Sum, count, mean and maximum per session; zeros for sessions without hits."""
    totals = hits.groupBy(key).agg(
        F.sum("parsed_value").alias("total_damage"),
        F.count("*").alias("hit_count"),
        F.max("parsed_value").alias("biggest_hit"),
    )
    if sessions is not None:
        totals = sessions.select(key).distinct().join(totals, key, "left").na.fill(0, ["total_damage", "hit_count", "biggest_hit"])
    mean = F.when(F.col("hit_count") > 0, F.col("total_damage") / F.col("hit_count")).otherwise(0.0)
    return totals.withColumn("average_hit", mean)


def dps_timeline(hits: DataFrame, bucket_ms: int = 1000, key: str = "session_id") -> DataFrame:
    """Tumbling damage buckets, gap-filled from bucket 0 to each session's last bucket."""
    when = F.greatest(F.coalesce(F.col("timestamp_ms"), F.col("frame_index").cast("bigint")), F.lit(0))
    filled = hits.groupBy(key, F.floor(when / bucket_ms).alias("bucket")).agg(
        F.sum("parsed_value").alias("damage"), F.count("*").alias("hit_count")
    )
    frame = dense_buckets(filled.groupBy(key).agg(F.max("bucket").alias("last")), [key], "last", "bucket")
    full = frame.join(filled, [key, "bucket"], "left").na.fill(0, ["damage", "hit_count"])
    return full.select(
        key,
        (F.col("bucket") * bucket_ms).alias("start_ms"),
        ((F.col("bucket") + 1) * bucket_ms).alias("end_ms"),
        "damage",
        "hit_count",
        (F.col("damage") / (bucket_ms / 1000)).alias("dps"),
    )


def top_hits(hits: DataFrame, k: int = 5, key: str = "session_id") -> DataFrame:
    return top_k(hits, [key], [F.desc("parsed_value"), F.asc("frame_index"), F.asc("ordinal")], k)


def combat_summary(hits: DataFrame, readings: DataFrame, metadata: DataFrame, bucket_ms: int = 1000, k: int = 5, key: str = "session_id", text: str = "text") -> DataFrame:
    """One nested report per session of ``metadata``: totals, duration, the ``k`` biggest hits, coverage, timeline facts.

    The timeline itself grows with the session and is a table of parts (``timeline_parts``); the report holds its size
    and its strongest bucket.
    """
    sessions = metadata.select(key).distinct()
    totals = session_totals(hits, sessions, key)
    best = top_hits(hits, k, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "parsed_value", "frame_index"))).alias("_top"))
    line = dps_timeline(hits, bucket_ms, key).groupBy(key).agg(F.count("*").alias("n_buckets"), F.max("dps").alias("peak_dps"))
    out = totals.join(durations(metadata, hits, key), key, "left").join(best, key, "left").join(coverage(readings, key, text), key, "left").join(line, key, "left")
    counts = ["candidate_count", "recognized_count", "parsed_count", "confident_count", "n_buckets"]
    top = F.coalesce("_top", F.array().cast("array<struct<rank:int,parsed_value:bigint,frame_index:int>>"))
    return out.na.fill(0, [*counts, "peak_dps"]).withColumns({"top_values": F.transform(top, lambda t: t["parsed_value"]), "top_frames": F.transform(top, lambda t: t["frame_index"])}).drop("_top")


def timeline_parts(timeline: DataFrame, bucket_ms: int = 1000, rows: int = 1024, key: str = "session_id") -> DataFrame:
    """The gap-filled timeline as arrays of at most ``rows`` buckets: ``part`` numbers them, damage and hits in time order."""
    place = (F.col("start_ms") / bucket_ms).cast("bigint")
    parts = timeline.groupBy(key, F.floor(place / rows).alias("part")).agg(F.sort_array(F.collect_list(F.struct("start_ms", "damage", "hit_count"))).alias("_b"))
    return parts.select(
        key, "part", F.col("_b")[0]["start_ms"].alias("start_ms"), F.transform("_b", lambda b: b["damage"]).alias("damage"), F.transform("_b", lambda b: b["hit_count"]).alias("hits")
    )


def coverage(readings: DataFrame, key: str = "session_id", text: str = "text", confident: float = 0.6) -> DataFrame:
    return readings.groupBy(key).agg(
        F.count("*").alias("candidate_count"),
        F.count_if(F.col(text) != "").alias("recognized_count"),
        F.count("parsed_value").alias("parsed_count"),
        F.count_if(F.col("confidence") >= confident).alias("confident_count"),
    )


def durations(metadata: DataFrame, hits: DataFrame, key: str = "session_id") -> DataFrame:
    """Frames written over frame rate where known, else the last hit, else 0."""
    last = hits.groupBy(key).agg(F.max(F.coalesce("timestamp_ms", F.lit(0).cast("bigint"))).alias("_last"))
    known = F.when((F.col("fps") > 0) & F.col("frames_written").isNotNull(), F.rint(F.col("frames_written") / F.col("fps") * 1000).cast("bigint"))
    return metadata.join(last, key, "left").select(key, F.coalesce(known, "_last", F.lit(0)).cast("bigint").alias("duration_ms"))


def candidate_kinds(candidates: DataFrame, keys: list[str]) -> DataFrame:
    kind = tx.classify(F.col("text"))
    damage = F.when(kind == "damage", tx.parse_value(F.col("text")))
    return candidates.groupBy(*keys, kind.alias("kind")).agg(
        F.count("*").alias("candidates"), F.coalesce(F.sum(damage), F.lit(0)).cast("bigint").alias("parsed_damage")
    )


def token_kinds(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Kinds of all whitespace-separated tokens.  Equal tokens are counted first (combined before
    the shuffle), so the pattern matching runs once per distinct token and spreads over the
    shuffle partitions.  ``damage`` is exact, a decimal, as a few thousand long numbers add up to more than a long holds."""
    tokens = texts.select(*keys, F.explode(F.split("text", r"\s+")).alias("text")).groupBy(*keys, "text").agg(F.count("*").alias("n"))
    kind = tx.classify(F.col("text"))
    damage = F.when(kind == "damage", tx.parse_value(F.col("text"))).cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")
    total = F.coalesce(F.sum(damage.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    return tokens.groupBy(*keys, kind.alias("kind")).agg(F.sum("n").alias("tokens"), total.alias("damage"))


def top_unknown(candidates: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Most common unknown texts; the first seen wins a tie."""
    counts = (
        candidates.filter(tx.classify(F.col("text")) == "unknown")
        .groupBy(*keys, "text")
        .agg(F.count("*").alias("n"), F.min("ordinal").alias("_first"))
    )
    return top_k(counts, keys, [F.desc("n"), F.asc("_first")], k).drop("_first")


def session_metrics(frames: DataFrame, key: str = "session_id") -> DataFrame:
    """Totals of a per-frame log; mean confidence is over hits, mean time over frames.

    The duration is the time spent on all frames, and the frame rate what follows from it (0 without any time).
    """
    base = frames.groupBy(key).agg(
        F.count("*").alias("total_frames"),
        F.sum("candidates").alias("total_candidates"),
        F.sum("hits").alias("total_hits"),
        F.sum("rejected").alias("total_rejected"),
        F.sum(F.when(F.col("hits") > 0, F.col("damage"))).alias("_damage"),
        F.max(F.when(F.col("hits") > 0, F.col("damage"))).alias("_biggest"),
        F.sum(F.col("max_confidence") * F.col("hits")).alias("_conf"),
        F.avg("processing_time_ms").alias("avg_processing_time_ms"),
        (F.coalesce(F.sum("processing_time_ms"), F.lit(0.0)) / 1000).alias("_seconds"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return base.select(
        key, "total_frames", "total_candidates", "total_hits", "total_rejected",
        F.coalesce("_damage", F.lit(0)).alias("total_damage"),
        F.coalesce("_biggest", F.lit(0)).alias("biggest_hit"),
        F.round(ratio("_conf", "total_hits"), 6).alias("avg_confidence"),
        F.round(ratio("total_hits", "total_candidates"), 6).alias("acceptance_rate"),
        F.round("avg_processing_time_ms", 6).alias("avg_processing_time_ms"),
        F.round("_seconds", 6).alias("duration_seconds"),
        F.round(ratio("total_frames", "_seconds"), 6).alias("fps_achieved"),
    )


def rejection_reasons(log: DataFrame, key: str = "session_id", min_confidence: float | None = None) -> DataFrame:
    """Each rejected candidate counts once for every one of its reasons."""
    rejected = log.select(key, F.explode("rejected").alias("r"))
    if min_confidence is not None:
        rejected = rejected.filter(F.col("r.confidence") >= min_confidence)
    return rejected.select(key, F.explode("r.reasons").alias("reason")).groupBy(key, "reason").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, buckets: list[tuple[str, float | None]], key: str = "session_id") -> DataFrame:
    """Fixed buckets per key in long form, empty buckets included: one conditional count per
    bucket in a single aggregation, then unpivoted."""
    label = sc.bucket_label(value, buckets)
    wide = df.groupBy(key).agg(*[F.count_if(label == lab).alias(f"b{i}") for i, (lab, _) in enumerate(buckets)])
    pairs = F.array(*[F.struct(F.lit(lab).alias("bucket"), F.col(f"b{i}").alias("n")) for i, (lab, _) in enumerate(buckets)])
    return wide.select(key, F.inline(pairs))


def frame_rate(frames: DataFrame, axis: str = "timestamp_ms", key: str = "session_id", width: int = MS_WIDTH) -> DataFrame:
    """Frame-delta statistics in seconds; sessions with fewer than two frames are left out."""
    d = previous_row(frames, [key], axis, [axis], order=["ordinal"], width=width)
    delta = (F.col(axis) - F.col(f"prev_{axis}")) / 1000.0
    agg = d.groupBy(key).agg(
        F.count("*").alias("total_frames"), F.avg(delta).alias("a"), F.min(delta).alias("lo"), F.max(delta).alias("hi"), F.stddev_pop(delta).alias("sd")
    ).filter(F.col("total_frames") >= 2)

    def rate(c: str) -> Column:
        return F.round(F.when(F.col(c) > 0, 1 / F.col(c)).otherwise(0.0), 2)

    return agg.select(
        key, "total_frames",
        F.round("a", 6).alias("avg_frame_time_s"), F.round("lo", 6).alias("min_frame_time_s"), F.round("hi", 6).alias("max_frame_time_s"),
        F.round("sd", 6).alias("std_dev_s"), rate("a").alias("avg_fps"), rate("hi").alias("min_fps"), rate("lo").alias("max_fps"),
    )


STAGE_QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def stage_profile(timings: DataFrame, keys: list[str], value: str = "elapsed_ms") -> DataFrame:
    """Per-stage timing profile with exact interpolated percentiles."""
    basic = timings.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
    )
    return basic.join(quantiles(timings, keys, value, STAGE_QUANTILES), keys)


def stage_findings(profile: DataFrame, frame_time: DataFrame, key: str = "session_id", fps_target: float = 30.0) -> DataFrame:
    """Bottlenecks and recommendations per session from its stage profiles (a handful of rows per session) and frame times.

    The frame rate follows from the frame times; below nine tenths of the target it is a finding.
    """
    stages = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("stage"))))
    slowest = F.max_by("stage", F.struct("total", "stage"))
    per = profile.groupBy(key).agg(
        slowest.alias("slowest_stage"), F.max("total").alias("_top"), F.sum("total").alias("pipeline_ms"),
        stages(F.col("sd") > F.col("mean") * 0.5).alias("_varied"), stages(F.col("p99") > F.col("mean") * 3).alias("_spikes"),
    )
    spent = frame_time.groupBy(key).agg(F.sum("frame_ms").alias("_frames"), F.count("frame_ms").alias("_n"))
    top = F.col("_top") > F.col("pipeline_ms") * 0.5
    per = per.join(spent, key, "left").withColumn("_fps", F.when(F.col("_frames") > 0, F.col("_n") * 1000 / F.col("_frames")).otherwise(0.0))
    slow = F.col("_fps") < fps_target * 0.9

    def advice(cond: Column, text: Column) -> Column:
        return F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))

    recommendations = F.concat(
        advice(top, F.concat(F.lit("Optimize "), "slowest_stage")), F.transform("_varied", lambda s: F.concat(F.lit("Reduce variance in "), s)),
        advice(slow, F.lit(f"Raise the frame rate to {fps_target:g}")), F.transform("_spikes", lambda s: F.concat(F.lit("Investigate P99 spikes of "), s)),
    )
    return per.select(
        key, "slowest_stage",
        F.round(F.col("_top") / F.col("pipeline_ms") * 100, 4).alias("slowest_percent"),
        top.alias("is_bottleneck"),
        F.array_join("_varied", ",").alias("high_variance"), F.array_join("_spikes", ",").alias("p99_spikes"),
        F.round(F.greatest(F.lit(0.0), F.coalesce("_frames", F.lit(0.0)) - F.col("pipeline_ms")), 4).alias("overhead_ms"),
        F.round("_fps", 4).alias("fps_achieved"), slow.alias("fps_below_target"), F.array_join(recommendations, "; ").alias("recommendations"),
    )


def memory_profile(samples: DataFrame, key: str = "session_id", leak_mb: float = 50, min_samples: int = 10, spike: float = 1.5) -> DataFrame:
    growth = F.max_by("rss_mb", "frame_index") - F.min_by("rss_mb", "frame_index")
    total = samples.groupBy(key).agg(
        F.count("*").alias("samples"), F.max("rss_mb").alias("peak"), F.round(F.avg("rss_mb"), 6).alias("mean"), F.min("rss_mb").alias("low"), growth.alias("growth")
    )
    stages = samples.groupBy(key, "stage").agg(F.count("*").alias("n"), F.max("rss_mb").alias("hi"), F.avg("rss_mb").alias("avg"))
    spikes = stages.groupBy(key).agg(F.count_if((F.col("n") > 1) & (F.col("hi") > F.col("avg") * spike)).alias("_spikes"))
    enough = F.col("samples") >= min_samples
    return total.join(spikes, key).select(
        "*", (enough & (F.col("growth") > leak_mb)).alias("has_leak"), F.when(enough, F.col("_spikes")).otherwise(0).alias("spike_stages")
    ).drop("_spikes")


def snapshot_choice(
    frames: DataFrame, every: int = 0, low: float = 0.65, high: float = 0.95, limit: int = 100, key: str = "session_id",
    on_rejection: bool = True, on_acceptance: bool = True, on_low: bool = True, on_high: bool = True,
) -> DataFrame:
    """The first applicable reason per frame; at most ``limit`` snapshots per session in frame order."""
    conf = F.col("max_confidence")
    rules = [
        (F.lit(every > 0) & (F.col("frame_index") % max(every, 1) == 0), "periodic"),
        (F.lit(on_rejection) & (F.col("rejected") > 0), "rejection"),
        (F.lit(on_acceptance) & (F.col("hits") > 0), "acceptance"),
        (F.lit(on_low) & (conf < low) & (conf > 0), "low_confidence"),
        (F.lit(on_high) & (conf >= high), "high_confidence"),
    ]
    reason = reduce(lambda acc, r: F.when(r[0], r[1]).otherwise(acc), reversed(rules), F.lit(None).cast("string"))
    chosen = frames.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return top_k(chosen, [key], [F.asc("frame_index")], limit)


def snapshot_counts(choice: DataFrame, keys: list[str]) -> DataFrame:
    return choice.groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def per_instant(hits: DataFrame, key: str = "session_id", axis: str = "timestamp_ms") -> DataFrame:
    """One row per session and timestamp.  Hits of one instant are indistinguishable to the
    rolling and running views, so they are merged before any window sees them."""
    return hits.groupBy(key, axis).agg(
        F.sum("parsed_value").alias("damage"), F.count("*").alias("hits"), F.max("parsed_value").alias("biggest"),
        F.max_by("parsed_value", F.struct("frame_index", "ordinal")).alias("last_value"),
    )


def rolling_damage(hits: DataFrame, window_ms: int = 5000, key: str = "session_id") -> DataFrame:
    """Damage within the closed trailing window at every hit time, and its rate per second."""
    rows = per_instant(hits, key).select(key, "timestamp_ms", "damage")
    out = trailing(rows, [key], "timestamp_ms", window_ms, {"rolling_damage": F.sum("damage")}, width=max(MS_WIDTH, 16 * window_ms))
    return out.select(key, "timestamp_ms", "rolling_damage", (F.col("rolling_damage") / (window_ms / 1000)).alias("rolling_dps"))


def running_stats(hits: DataFrame, key: str = "session_id", width: int = MS_WIDTH) -> DataFrame:
    """Session state after every hit time: total, peak, count, mean, last value."""
    out = running(
        per_instant(hits, key), [key], "timestamp_ms", sums={"total_damage": "damage", "hit_count": "hits"},
        maxes={"peak_hit": "biggest"}, lasts={"last_hit": "last_value"}, width=width,
    )
    return out.select(key, "timestamp_ms", "total_damage", "hit_count", "peak_hit", (F.col("total_damage") / F.col("hit_count")).alias("average_hit"), "last_hit")


def state_at(hits: DataFrame, ticks: DataFrame, key: str = "session_id", width: int = MS_WIDTH) -> DataFrame:
    """As-of lookup: the state after all hits up to each tick (``ticks``: key, tick_ms)."""
    rows = per_instant(hits, key).select(key, "timestamp_ms", "damage", "hits", "biggest", "last_value", F.lit(0).alias("_tick"))
    asked = ticks.select(
        key, F.col("tick_ms").alias("timestamp_ms"), F.lit(0).cast("bigint").alias("damage"), F.lit(0).cast("bigint").alias("hits"),
        F.lit(None).cast("bigint").alias("biggest"), F.lit(None).cast("bigint").alias("last_value"), F.lit(1).alias("_tick"),
    )
    out = running(
        rows.unionByName(asked), [key], "timestamp_ms", sums={"total_damage": "damage", "hit_count": "hits"},
        maxes={"peak_hit": "biggest"}, lasts={"last_hit": "last_value"}, order=["_tick"], width=width,
    )
    return out.filter("_tick = 1").select(key, F.col("timestamp_ms").alias("tick_ms"), "total_damage", "hit_count", F.coalesce("peak_hit", F.lit(0)).alias("peak_hit"), "last_hit")


def hit_log(hits: DataFrame, k: int = 50, key: str = "session_id") -> DataFrame:
    """The last ``k`` hits, oldest first in ``age`` order."""
    return top_k(hits, [key], [F.desc("timestamp_ms"), F.desc("frame_index"), F.desc("ordinal")], k, rank="age")


def track_motion(votes: DataFrame, keys: list[str], axis: str = "frame_index", width: int = 4096, ahead: int = 5) -> DataFrame:
    """Mean per-step velocity per track, last position, and the position ``ahead`` frames later."""
    d = previous_row(votes, keys, axis, [axis, "center_x", "center_y"], order=["ordinal"], width=width)
    step = F.greatest(F.col(axis) - F.col(f"prev_{axis}"), F.lit(1))
    at = F.struct(axis, "ordinal")
    m = d.groupBy(*keys).agg(
        F.count("*").alias("votes"), F.min(axis).alias("first_frame"), F.max(axis).alias("last_frame"),
        F.coalesce(F.avg((F.col("center_x") - F.col("prev_center_x")) / step), F.lit(0.0)).alias("vx"),
        F.coalesce(F.avg((F.col("center_y") - F.col("prev_center_y")) / step), F.lit(0.0)).alias("vy"),
        F.max_by("center_x", at).alias("_x"), F.max_by("center_y", at).alias("_y"),
    )
    return m.select(
        *keys, "votes", "first_frame", "last_frame",
        F.round("vx", 6).alias("velocity_x"), F.round("vy", 6).alias("velocity_y"),
        F.round(F.col("_x") + F.col("vx") * ahead, 6).alias("predicted_x"), F.round(F.col("_y") + F.col("vy") * ahead, 6).alias("predicted_y"),
    )


def recent_velocity(rows: DataFrame, key: str = "session_id", axis: str = "frame_index", last: int = 100, least: int = 5) -> DataFrame:
    """Velocity over the most recent ``last`` positions; a fixed upward drift with fewer than ``least``."""
    recent = top_k(rows, [key], [F.desc(axis), F.desc("ordinal")], last, rank="_age").drop("_age")
    d = previous_row(recent, [key], axis, [axis, "center_x", "center_y"], order=["ordinal"])
    step = F.greatest(F.col(axis) - F.col(f"prev_{axis}"), F.lit(1))
    agg = d.groupBy(key).agg(
        F.count("*").alias("positions"), F.avg((F.col("center_x") - F.col("prev_center_x")) / step).alias("vx"), F.avg((F.col("center_y") - F.col("prev_center_y")) / step).alias("vy")
    )
    few = F.col("positions") < least
    return agg.select(
        key, "positions", F.round(F.when(few, 0.0).otherwise(F.col("vx")), 6).alias("velocity_x"), F.round(F.when(few, -2.0).otherwise(F.col("vy")), 6).alias("velocity_y")
    )


def motion_trend(
    scores: DataFrame, key: str = "session_id", axis: str = "frame_index", score: str = "motion", threshold: float = 30.0,
    recent: int = 5, margin: int = 50, limit: int = 200, current: str | None = None,
) -> DataFrame:
    """Mean of the last ``recent`` motion scores and the expansion predicted from it."""
    ranked = positions(scores, [key], axis)
    out = trailing(ranked, [key], "pos", recent - 1, {"_mean": F.avg(score), "_n": F.count(score)})
    now = F.col(current) if current else F.lit(0)
    rising = (F.col("_n") >= recent) & (F.col("_mean") > threshold * 1.5)
    return out.select(key, axis, F.round("_mean", 6).alias("recent_motion"), F.when(rising, F.least(now + margin, F.lit(limit))).otherwise(now).alias("predicted_expansion"))


def roi_state(
    frames: DataFrame, key: str = "session_id", axis: str = "frame_index", expansion: str = "expansion", cooldown: int = 30, limit: int = 200,
    base: tuple[float, float, float, float] = (0.15, 0.05, 0.70, 0.75), size: tuple[int, int] = (1920, 1080),
) -> DataFrame:
    """Adaptive region per frame: bounds, reason, confidence, and the cooldown counter, which is
    ``cooldown`` minus the number of frames since the last expansion."""
    ranked = positions(frames, [key], axis).withColumn("_hot", F.when(F.col(expansion) > 0, F.col("pos")))
    seen = running(ranked, [key], "pos", lasts={"_last": "_hot"})
    e = F.col(expansion)
    left, top, w, h = base
    return seen.select(
        key, axis, expansion,
        F.greatest(F.lit(0), F.lit(int(size[0] * left)) - e).alias("left"), F.greatest(F.lit(0), F.lit(int(size[1] * top)) - e).alias("top"),
        (F.lit(int(size[0] * (left + w))) + e).alias("right"), (F.lit(int(size[1] * (top + h))) + e).alias("bottom"),
        F.when(e > 0, "motion_detected").otherwise("").alias("reason"),
        F.round(1.0 - e / F.lit(limit), 6).alias("confidence"),
        F.coalesce(F.greatest(F.lit(0), F.lit(cooldown) - (F.col("pos") - F.col("_last"))), F.lit(0)).cast("bigint").alias("cooldown"),
    )


def vote_winners(votes: DataFrame, keys: list[str], min_votes: int = 2, weighted: bool = True) -> DataFrame:
    """The value each track agrees on; the value seen first wins a tie."""
    weight = F.sum("confidence") if weighted else F.count("*").cast("double")
    per_value = votes.groupBy(*keys, "parsed_value").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("_conf"), weight.alias("w"), F.min(F.struct("frame_index", "ordinal")).alias("_first")
    )
    # Sums of doubles are compared after rounding so that a tie is a tie in any summation order.
    best = F.max_by(F.struct("parsed_value", "n", "_conf", "w"), F.struct(F.round("w", 9), -F.col("_first.frame_index"), -F.col("_first.ordinal")))
    per_track = per_value.groupBy(*keys).agg(best.alias("b"), F.sum("w").alias("_total"), F.sum("n").alias("total_votes"), F.count("*").alias("values_seen"))
    agreement = F.when(F.col("_total") > 0, F.col("b.w") / F.col("_total")).otherwise(0.0)
    return per_track.filter(F.col("total_votes") >= min_votes).select(
        *keys, F.col("b.parsed_value").alias("final_value"), F.col("b.n").alias("vote_count"), "total_votes", "values_seen",
        F.round(agreement, 6).alias("agreement_ratio"), F.round(F.col("b._conf") / F.col("b.n") * agreement, 6).alias("confidence"),
    )


def vote_statistics(votes: DataFrame, key: str, track: str) -> DataFrame:
    sizes = votes.groupBy(key, track).agg(F.count("*").alias("n"))
    return sizes.groupBy(key).agg(
        F.sum("n").alias("total_votes"), F.count("*").alias("total_tracks"), F.round(F.avg("n"), 6).alias("avg_votes_per_track"),
        F.max("n").alias("max_votes_per_track"), F.min("n").alias("min_votes_per_track"),
    )


def sample_report(samples: DataFrame, keys: list[str] = ()) -> DataFrame:
    hit = F.col("label") == 1
    agg = samples.groupBy(*keys).agg(
        F.count("*").alias("total_samples"), F.count_if(hit).alias("positive_samples"), F.count_if(~hit).alias("negative_samples"),
        F.coalesce(F.avg(F.when(hit, F.col("line_score"))), F.lit(0.0)).alias("_p"), F.coalesce(F.avg(F.when(~hit, F.col("line_score"))), F.lit(0.0)).alias("_n"),
    )
    ratio = F.when(F.col("total_samples") > 0, F.col("positive_samples") / F.col("total_samples")).otherwise(0.0)
    return agg.select(
        *keys, "total_samples", "positive_samples", "negative_samples", F.round(ratio, 6).alias("positive_ratio"),
        F.when(ratio.between(0.3, 0.7), "balanced").otherwise("imbalanced").alias("class_balance"),
        F.round("_p", 6).alias("avg_score_positive"), F.round("_n", 6).alias("avg_score_negative"),
    )


def capture_statistics(frames: DataFrame, key: str = "session_id", last: int = 120) -> DataFrame:
    """Frames, frame rate, extreme capture times, and the mean capture time of the last frames."""
    whole = frames.groupBy(key).agg(
        F.count("*").alias("total_frames"), F.max("timestamp_ms").alias("total_duration_ms"), F.min("capture_ms").alias("min_frame_time_ms"), F.max("capture_ms").alias("max_frame_time_ms")
    )
    recent = top_k(frames, [key], [F.desc("timestamp_ms"), F.desc("ordinal")], last).groupBy(key).agg(F.round(F.avg("capture_ms"), 6).alias("avg_capture_time_ms"))
    fps = F.when(F.col("total_duration_ms") > 0, F.round(F.col("total_frames") / (F.col("total_duration_ms") / 1000.0), 6)).otherwise(0.0)
    return whole.join(recent, key).withColumn("avg_fps", fps)


def classifier_report(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Confusion counts and the usual rates from ``label`` and ``predicted`` (0/1)."""
    def both(a: int, b: int) -> Column:
        return F.count_if((F.col("label") == a) & (F.col("predicted") == b))

    c = scored.groupBy(*keys).agg(both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(0, 0).alias("tn"))
    return with_rates(c, tn="tn")


def with_rates(counts: DataFrame, tn: str | None = None) -> DataFrame:
    """Adds precision, recall, F1 and accuracy to tp / fp / fn counts (0 on empty denominators)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    good = tp + F.col(tn) if tn else tp
    everything = good + fp + fn

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    out = counts.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1_score", share(2 * p * r, p + r)).withColumn("accuracy", share(good, everything))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score", "accuracy")})
