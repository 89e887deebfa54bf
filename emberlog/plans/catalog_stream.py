"""Streaming twins (T rows): the events table is read as a stream, run to its end, and the
written table is compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog.operators import sequence as sq, stats as st
from emberlog.plans import adapters as ad
from emberlog.plans.catalog_sequence import KILL_MS, LIVE_IDS
from emberlog.plans.catalog_stats import HOUR
from emberlog.plans.registry import ORACLE, query
from emberlog.session import work_folder
from emberlog.sources import buckets, io
from emberlog.streaming import live


class _Streamed:
    """Gives the adapters a streaming scan instead of a batch scan of the same file."""

    def __init__(self, spark) -> None:
        self.spark = spark

    @property
    def read(self):
        return self

    def parquet(self, path: str) -> DataFrame:
        folder, _, name = path.rpartition("/")
        schema = self.spark.read.parquet(path).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def started(rows: DataFrame) -> DataFrame:
    """Sessions start hours apart: 2024-01-01 UTC plus an hour for every session number modulo seven."""
    return rows.withColumn("started_at_ms", F.lit(1_704_067_200_000) + F.col("session_id") % 7 * HOUR)


def stream(spark, sf, adapter, late="10 minutes"):
    return live.with_event_time(started(adapter(_Streamed(spark), sf)), late=late)


def in_steps(spark, sf, folder, run, mixed=0):
    """Writes the hits in three steps of session time and calls ``run`` with the stream of files after each.

    With ``mixed``, every third hit of the last frames of a step only comes with the next one.
    """
    rows = started(ad.hits(spark, sf)).select(*live.LIVE_COLUMNS, "started_at_ms")
    rows = rows.withColumn("at", F.col("frame_index") + F.when(F.col("ordinal") % 3 == 0, mixed).otherwise(0))
    for n, part in enumerate(("at < 240", "at >= 240 and at < 480", "at >= 480")):
        rows.filter(part).drop("at").write.json(f"{folder}/in/{n}")
        out = run(live.read_hits(spark, f"{folder}/in/*"))
    return out


@query("t1_live_unique", f"SELECT h.session_id, ordinal, frame_index, parsed_value FROM hits h JOIN {LIVE_IDS} USING (session_id, ordinal) WHERE assigned = ordinal", ["hits"])
def _(spark, sf):
    """Rows come up to five frames out of order; none is lost, and the answer is that of the batch operator."""
    folder = work_folder(spark, "t1")
    in_steps(spark, sf, folder, lambda hits: live.run_unique(live.with_event_time(hits, late="1 day"), f"{folder}/table", f"{folder}/state", late_ms=24 * HOUR), mixed=5)
    table = live.finish_unique(spark, f"{folder}/table", late_ms=24 * HOUR)
    return table.select("session_id", "ordinal", "frame_index", "parsed_value")


@query(
    "t2_session_stats",
    f"""SELECT session_id, max(timestamp_ms) AS timestamp_ms, CAST(sum(parsed_value) AS BIGINT) AS total_damage, count(*) AS hit_count, max(parsed_value) AS peak_hit, arg_max(parsed_value, (timestamp_ms, ordinal)) AS last_hit,
        CAST(sum(parsed_value) FILTER (last - timestamp_ms <= {6 * HOUR}) AS BIGINT) AS rolling_damage, CAST(sum(parsed_value) FILTER (last - timestamp_ms <= {6 * HOUR}) AS BIGINT) / 21600e0 AS rolling_dps
        FROM (SELECT *, max(timestamp_ms) OVER (PARTITION BY session_id) AS last FROM hits) GROUP BY 1""",
    ["hits"],
)
def _(spark, sf):
    latest = stats_at_end(spark, sf)
    return latest.select("session_id", "s.timestamp_ms", "s.total_damage", "s.hit_count", "s.peak_hit", "s.last_hit", "s.rolling_damage", "s.rolling_dps")


def stats_at_end(spark, sf):
    """The last state of every session after three steps."""
    folder = work_folder(spark, "t2")
    run = lambda hits: live.run_to_table(live.session_stats(live.with_event_time(hits, late="1 day"), window_ms=6 * HOUR, idle_ms=400 * 24 * HOUR), f"{folder}/table", f"{folder}/state", mode="update")
    table = in_steps(spark, sf, folder, run)
    facts = [c for c in table.columns if c not in ("session_id", "epoch")]
    return table.groupBy("session_id").agg(F.max_by(F.struct(*facts), "hit_count").alias("s"))


@query(
    "t2_hit_log",
    """SELECT session_id, ordinal, parsed_value, row_number() OVER w AS age FROM hits WINDOW w AS (PARTITION BY session_id ORDER BY timestamp_ms DESC, frame_index DESC, ordinal DESC)
       QUALIFY row_number() OVER w <= 50""",
    ["hits"],
)
def _(spark, sf):
    """The log of the last 50 hits that the state keeps, newest first."""
    log = stats_at_end(spark, sf).select("session_id", F.posexplode(F.reverse("s.log")).alias("at", "hit"))
    return log.select("session_id", "hit.ordinal", "hit.parsed_value", (F.col("at") + 1).cast("bigint").alias("age"))


@query(
    "t3_refresh_sessions",
    """SELECT session_id, CAST(sum(parsed_value) AS BIGINT) AS total_damage, count(*) AS hit_count, max(parsed_value) AS biggest_hit, sum(parsed_value) / count(*) AS average_hit FROM hits GROUP BY 1""",
    ["hits"],
)
def _(spark, sf):
    """The hits arrive in two steps; the second replaces the sessions it touches."""
    folder = work_folder(spark, "t3")
    rows = ad.hits(spark, sf)
    schema = "session_id bigint, total_damage bigint, hit_count bigint, biggest_hit bigint, average_hit double"
    run = live.refresh_sessions(f"{folder}/hits", rows.schema, st.session_totals, f"{folder}/table")
    for n, part in enumerate((rows.filter("frame_index < 360"), rows.filter("session_id % 3 = 0 or frame_index >= 360"))):
        buckets.replace_rows(part if n == 0 else rows, f"{folder}/hits", "session_id")
        part.write.parquet(f"{folder}/in/{n}")
        news = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*")
        news.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return buckets.load_rows(spark, f"{folder}/table", schema)


@query(
    "t6_dps_timeline",
    f"""SELECT session_id, b * {HOUR} AS start_ms, (b + 1) * {HOUR} AS end_ms, damage, hit_count, damage / 3600e0 AS dps FROM
        (SELECT session_id, timestamp_ms // {HOUR} AS b, CAST(sum(parsed_value) AS BIGINT) AS damage, count(*) AS hit_count FROM hits GROUP BY 1, 2)""",
    ["hits"],
)
def _(spark, sf):
    folder = work_folder(spark, "t6")
    run = lambda hits: live.run_to_table(live.dps_timeline(hits, HOUR, "1 day"), f"{folder}/table", f"{folder}/state", mode="update")
    return live.latest_buckets(in_steps(spark, sf, folder, run).drop("epoch"))


@query(
    "t7_confirmed_damage",
    f"""SELECT d.session_id, d.ordinal AS damage_ordinal, d.value, c.cue_type, c.ordinal AS cue_ordinal FROM damage d JOIN cues c ON c.session_id = d.session_id
        AND c.timestamp_ms > d.timestamp_ms AND c.timestamp_ms <= d.timestamp_ms + {6 * HOUR} AND sqrt((d.center_x - c.center_x) ** 2 + (d.center_y - c.center_y) ** 2) < 50""",
    ["damage", "cues"],
)
def _(spark, sf):
    folder = work_folder(spark, "t7")
    cues = live.with_event_time(started(ad.cues(_Streamed(spark), sf)), name="cue_time")
    pairs = live.confirmed_damage(stream(spark, sf, ad.damage), cues, within_ms=6 * HOUR)
    return live.run_to_table(pairs, f"{folder}/table", f"{folder}/state")


@query("t7_kill_events", ORACLE["k7_kills"])
def _(spark, sf):
    """Damage and cues come in three steps, cues half a day late; then a far later row of no session moves the watermark past all of them."""
    folder = work_folder(spark, "t7k")
    sides = {"damage": (started(ad.damage(spark, sf)), 0), "cues": (started(ad.cues(spark, sf)), 12)}
    for n, (low, high) in enumerate(((None, 240), (240, 480), (480, None), (None, None))):
        for name, (rows, behind) in sides.items():
            at = F.col("frame") + behind
            part = rows.filter(F.lit(low is None) | (at >= F.lit(low))).filter(F.lit(high is None) | (at < F.lit(high)))
            if n == 3:
                part = rows.limit(1).withColumns({"session_id": F.lit(-1).cast("bigint"), "started_at_ms": F.lit(1_704_067_200_000 + 1000 * 24 * HOUR)})
            part.write.parquet(f"{folder}/in/{name}/{n}")
        streams = [live.with_event_time(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/{name}/*"), late="1 day") for name, (rows, _) in sides.items()]
        table = live.run_to_table(live.kill_events(*streams, within_ms=KILL_MS), f"{folder}/table", f"{folder}/state")
    return sq.kill_scores(table)


# --- files written from the tables and read back -----------------------------------------------


@query(
    "s9_detection_log",
    "SELECT session_id, reason, count(*) AS n FROM (SELECT session_id, unnest(reasons) AS reason FROM rejections) GROUP BY 1, 2",
    ["rejections"],
)
def _(spark, sf):
    path = work_folder(spark, "s9")
    log = ad.rejections(spark, sf)
    io.write_detection_log(log, path)
    return st.rejection_reasons(io.read_detection_log(spark, path, log.schema))


@query("s4_candidates", "SELECT text, CAST(ordinal AS INTEGER) AS frame, CASE WHEN ordinal % 3 = 0 THEN 0.0 ELSE (ordinal % 10) / 10e0 END::DOUBLE AS confidence FROM texts", ["texts"])
def _(spark, sf):
    path = work_folder(spark, "s4")
    t = ad.texts(spark, sf)
    t.select("text", F.col("ordinal").cast("int").alias("frame"), F.when(F.col("ordinal") % 3 != 0, F.col("ordinal") % 10 / 10.0).alias("confidence")).write.json(path)
    return io.read_candidates(spark, path, multi_line=False).select("text", "frame", "confidence")


@query("s5_annotations", "SELECT CAST(session_id AS VARCHAR) AS session_id, frame, value, x, y, 'direct' AS damage_type FROM truth", ["truth"])
def _(spark, sf):
    path = work_folder(spark, "s5")
    t = ad.truth(spark, sf).withColumn("session_id", F.col("session_id").cast("string"))
    io.write_annotations(io.nest_truth(t), path)
    good, _bad = io.read_annotations(spark, path, pattern="*.json", multi_line=False)
    return io.annotation_hits(good).select("session_id", "frame", "value", "x", "y", "damage_type")


@query(
    "t4_incremental_pickup",
    "SELECT session_id, count(*) AS hits, max(frame_index) AS last_frame FROM hits GROUP BY 1",
    ["hits"],
)
def _(spark, sf):
    """The hits arrive as files in two steps; the second run takes the new files only."""
    folder = work_folder(spark, "t4")
    rows = ad.hits(spark, sf).select(*live.LIVE_COLUMNS)
    middle = F.col("frame_index") < 360
    rows.filter(middle).write.json(f"{folder}/in/a")
    source = lambda: live.read_hits(spark, f"{folder}/in/*", files_per_batch=4)
    live.run_to_table(source(), f"{folder}/table", f"{folder}/state")
    rows.filter(~middle).write.json(f"{folder}/in/b")
    table = live.run_to_table(source(), f"{folder}/table", f"{folder}/state")
    return table.groupBy("session_id").agg(F.count("*").alias("hits"), F.max("frame_index").alias("last_frame"))
