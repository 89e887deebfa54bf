"""Live twins: unique hits, session statistics, timelines, kill confirmation, refresh.

Streams carry a wall-clock column ``event_time``: when the session started plus its session time.  Sessions that
start at different times therefore share one watermark, which should allow for the spread with which
they arrive; later rows are dropped by the windowed operators.  State is bounded: it holds what the look-back of the
operator needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import hypot

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog import schemas
from emberlog.operators.sequence import live_unique, nearby_enemy
from emberlog.session import cut_lineage
from emberlog.sources.buckets import load_rows, replace_rows, touched_buckets

LATE = "10 minutes"
# Where no start is known: a fresh watermark stands at the epoch and would drop that instant as late.
UNKNOWN_START_MS = 86_400_000


def read_hits(spark: SparkSession, path: str, files_per_batch: int = 1000, schema: str = schemas.LIVE_HIT) -> DataFrame:
    """New files only, at most ``files_per_batch`` per trigger; the checkpoint remembers the rest."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def with_event_time(hits: DataFrame, ms: str = "timestamp_ms", late: str = LATE, name: str = "event_time", started: str = "started_at_ms") -> DataFrame:
    """Adds the wall-clock time of a row: the start of its session, in milliseconds since the epoch, plus session time."""
    start = F.coalesce(F.col(started), F.lit(UNKNOWN_START_MS)) if started in hits.columns else F.lit(UNKNOWN_START_MS)
    return hits.withColumn(name, F.timestamp_millis(start + F.col(ms))).withWatermark(name, late)


LIVE_COLUMNS = ["session_id", "frame_index", "timestamp_ms", "ordinal", "parsed_value", "confidence", "center_x", "center_y"]


def unique_hits(folder: str, window: int = 1, reach: float = 45.0, late_ms: int = 600_000, idle_ms: int = 86_400_000, key: str = "session_id", drain: bool = False):
    """``foreachBatch`` body: appends the hits that do not repeat an accepted one, in the order of frames whatever the order of arrival.

    Rows wait until the watermark, ``late_ms`` of wall-clock time behind the newest row, has passed a later frame of their
    session; only then no row of their frame or an earlier one can still come in time.  Released frames run through the batch
    operator together with the accepted hits of the last ``window`` frames of each session.  Those are accepted again (they never
    were duplicates of each other), so the answer is that of one pass over all rows, and a crowded session is cut
    into pieces like any other.  A session whose newest row is ``idle_ms`` older than the newest row of all is released to its
    end and forgotten; with ``drain`` every session is.

    Accepted hits go to ``hits/epoch=n``, the ones still in reach to ``recent/epoch=n``, rows not released to ``waiting/epoch=n`` and how far each
    session has come to ``progress/epoch=n``; repeating a batch rewrites its own folders.  A row of a frame that its session has
    released, which only a row below the watermark can be, is dropped and counted in ``late/epoch=n``.
    """
    columns = [key, *LIVE_COLUMNS[1:]]

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns, F.unix_millis("event_time").alias("_event"))
        kind = rows.schema
        progress = spark.createDataFrame([], rows.select(key, F.col("frame_index").alias("_reached"), F.col("_event").alias("_newest")).schema)
        if epoch > 0:
            progress = spark.read.schema(progress.schema).parquet(f"{folder}/progress/epoch={epoch - 1}")
        known = progress.select(F.col(key).alias("_k"), "_reached", "_newest")
        rows = cut_lineage(rows.join(known, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k"))
        behind = F.coalesce(F.col("frame_index") < F.col("_reached"), F.lit(False))
        rows.agg(F.count_if(behind).alias("late")).write.mode("overwrite").parquet(f"{folder}/late/epoch={epoch}")
        rows = rows.filter(~behind).select(kind.names)
        old = spark.createDataFrame([], batch.select(*columns).schema)
        if epoch > 0:
            rows = rows.unionByName(spark.read.schema(kind).parquet(f"{folder}/waiting/epoch={epoch - 1}"))
            old = spark.read.schema(old.schema).parquet(f"{folder}/recent/epoch={epoch - 1}")
        seen = rows.groupBy(key).agg(F.max("_event").alias("_newest")).unionByName(progress.select(key, "_newest"))
        newest = seen.agg(F.max("_newest")).first()[0]
        mark = F.lit(newest) - late_ms
        front = rows.groupBy(key).agg(F.max(F.when(F.col("_event") < mark, F.col("frame_index"))).alias("_front")).unionByName(progress.select(key, F.col("_reached").alias("_front")))
        state = seen.groupBy(key).agg(F.max("_newest").alias("_newest")).withColumnRenamed(key, "_k")
        state = state.join(front.groupBy(key).agg(F.max("_front").alias("_front")), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
        over = F.lit(True) if drain else F.col("_newest") < F.lit(newest) - idle_ms
        state = cut_lineage(state.withColumn("_over", F.coalesce(over, F.lit(False))))
        rows = rows.join(state.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")))
        ready = F.col("_over") | F.coalesce(F.col("frame_index") < F.col("_front"), F.lit(False))
        rows = cut_lineage(rows.select(*kind.names, ready.alias("_ready")))
        rows.filter("not _ready").select(kind.names).write.mode("overwrite").parquet(f"{folder}/waiting/epoch={epoch}")
        judged = rows.filter("_ready").select(*columns, F.lit(False).alias("_old")).unionByName(old.withColumn("_old", F.lit(True)))
        kept = cut_lineage(live_unique(judged, window=window, reach=reach, keys=[key]))
        kept.filter("not _old").select(*columns).write.mode("overwrite").parquet(f"{folder}/hits/epoch={epoch}")
        going = state.filter(~F.col("_over")).select(F.col(key).alias("_k"), F.col("_front").alias("_reached"), "_newest")
        recent = kept.join(going, F.col(key).eqNullSafe(F.col("_k"))).filter(F.col("frame_index") >= F.col("_reached") - window)
        recent.select(*columns).write.mode("overwrite").parquet(f"{folder}/recent/epoch={epoch}")
        going.withColumnRenamed("_k", key).write.mode("overwrite").parquet(f"{folder}/progress/epoch={epoch}")

    return run


def run_unique(stream: DataFrame, folder: str, checkpoint: str, **params) -> DataFrame:
    """Drives ``unique_hits`` over what is there now and returns the table of accepted hits."""
    q = stream.writeStream.foreachBatch(unique_hits(folder, **params)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/hits").select(*LIVE_COLUMNS)


def finish_unique(spark: SparkSession, folder: str, schema: str = schemas.LIVE_HIT, **params) -> DataFrame:
    """Releases what still waits when no more rows will come, and returns the table of accepted hits."""
    last = spark.read.parquet(f"{folder}/progress").agg(F.max("epoch")).first()[0]
    if last is None:  # no session is open: look at the folders of rows that wait
        last = spark.read.parquet(f"{folder}/late").agg(F.max("epoch")).first()[0]
    nothing = spark.createDataFrame([], schema).withColumn("event_time", F.lit(None).cast("timestamp"))
    unique_hits(folder, drain=True, **params)(nothing, last + 1)
    return spark.read.parquet(f"{folder}/hits").select(*LIVE_COLUMNS)


#: Hits of a session's log.
LOG = 50
#: Rows of a task that are reduced together.
_BUFFER = 1 << 18
_PARTIAL = "total bigint, hits bigint, peak bigint, last_ms bigint, last_ordinal bigint, last_value bigint"
_ENTRY = "timestamp_ms bigint, frame_index bigint, ordinal bigint, parsed_value bigint"
_INSTANT = "timestamp_ms bigint, damage bigint"
_STATS_OUT = (
    "session_id bigint, timestamp_ms bigint, total_damage bigint, hit_count bigint, peak_hit bigint, last_hit bigint, rolling_damage bigint, rolling_dps double, "
    f"log array<struct<{', '.join(':'.join(c.split()) for c in _ENTRY.split(', '))}>>"
)


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers and lists needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _SessionStats(StatefulProcessor):
    """Totals, trailing window and log of each session; all of it goes when the watermark is ``idle_ms`` past the session's newest row."""

    def __init__(self, window_ms: int, idle_ms: int, log: int) -> None:
        self.window_ms, self.idle_ms, self.size = window_ms, idle_ms, log
        self.names = [c.split()[0] for c in _ENTRY.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", f"{_PARTIAL}, newest bigint")
        self.window = handle.getListState("window", _INSTANT)
        self.log = handle.getListState("log", _ENTRY)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known = self.totals.exists()
        total, hits, peak, ms, ordinal, value, newest = self.totals.get() if known else (0, 0, None, None, None, None, None)
        window = dict(tuple(r) for r in self.window.get()) if known else {}
        log = [tuple(r) for r in self.log.get()] if known else []
        for r in rows:
            total, hits, peak = total + r.total, hits + r.hits, r.peak if peak is None else max(peak, r.peak)
            if ms is None or (r.last_ms, r.last_ordinal) > (ms, ordinal):
                ms, ordinal, value = r.last_ms, r.last_ordinal, r.last_value
            newest = r.newest if newest is None else max(newest, r.newest)
            for x in r.window:  # nested rows arrive as dictionaries
                window[x["timestamp_ms"]] = window.get(x["timestamp_ms"], 0) + x["damage"]
            log += [tuple(x[name] for name in self.names) for x in r.log]
        window = {t: d for t, d in window.items() if ms - t <= self.window_ms}
        log = sorted(log)[-self.size :]
        self.totals.update((total, hits, peak, ms, ordinal, value, newest))
        self.window.put(sorted(window.items()))
        self.log.put(log)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(newest + self.idle_ms)
        rolling = sum(window.values())
        yield Row(session_id=key[0], timestamp_ms=ms, total_damage=total, hit_count=hits, peak_hit=peak, last_hit=value, rolling_damage=rolling, rolling_dps=rolling / (self.window_ms / 1000), log=[Row(**dict(zip(self.names, x))) for x in log])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        for state in (self.totals, self.window, self.log):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _summaries(batches: list[pa.RecordBatch], key: str, window_ms: int, log: int) -> pa.RecordBatch:
    """One row per session of the batches: totals, last hit, newest wall-clock time, sums by instant of the trailing window, last hits."""
    table = pa.Table.from_batches(batches).combine_chunks()

    def numbers(column: pa.ChunkedArray) -> np.ndarray:
        return column.cast(pa.int64()).combine_chunks().to_numpy()

    none = table[key].is_null().combine_chunks().to_numpy(zero_copy_only=False)
    sid, ts, frame, ordinal = numbers(table[key].fill_null(0)), *(numbers(table[c]) for c in ("timestamp_ms", "frame_index", "ordinal"))
    value, event = numbers(table["parsed_value"].fill_null(0)), numbers(table["_event"])
    newest_last = np.lexsort((ordinal, ts, sid, none))
    order = np.lexsort((ordinal, frame, ts, sid, none))
    at, who = ts[order], np.stack((sid[order], none[order]))
    first = np.concatenate(([True], (who[:, 1:] != who[:, :-1]).any(axis=0)))
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(order))
    hits, last, amount = ends - starts, newest_last[ends - 1], value[order]
    inside = at >= np.repeat(ts[last] - window_ms, hits)
    instant = inside & (first | ~np.append(False, inside[:-1]) | np.append(True, at[1:] != at[:-1]))
    opens = np.flatnonzero(instant)
    recent = {"timestamp_ms": at[opens], "damage": np.add.reduceat(np.where(inside, amount, 0), opens)}
    kept = order[np.arange(len(order)) >= np.repeat(ends - log, hits)]
    latest = {"timestamp_ms": ts[kept], "frame_index": frame[kept], "ordinal": ordinal[kept], "parsed_value": value[kept]}

    def lists(fields: dict[str, np.ndarray], sizes: np.ndarray) -> pa.Array:
        ends_at = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        return pa.ListArray.from_arrays(ends_at, pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))

    columns = {
        key: pa.array(sid[last], pa.int64(), mask=none[last]),
        "total": pa.array(np.add.reduceat(amount, starts)), "hits": pa.array(hits, pa.int64()), "peak": pa.array(np.maximum.reduceat(amount, starts)),
        "last_ms": pa.array(ts[last]), "last_ordinal": pa.array(ordinal[last]), "last_value": pa.array(value[last]),
        "newest": pa.array(np.maximum.reduceat(event[order], starts)),
        "window": lists(recent, np.add.reduceat(instant.astype(np.int64), starts)), "log": lists(latest, np.minimum(hits, log)),
    }
    return pa.RecordBatch.from_pydict(columns)


def session_stats(hits: DataFrame, window_ms: int = 5000, key: str = "session_id", idle_ms: int = 86_400_000, log: int = LOG) -> DataFrame:
    """Session state after each batch, for update mode: totals, peak, last hit, the trailing window and the last ``log`` hits, oldest first.

    Every task reduces ``_BUFFER`` rows at a time to one summary per session *before* the shuffle: totals, the per-instant sums of its
    trailing window and its last hits (older rows cannot be in the final ones).  All sessions of a buffer are reduced together,
    so its cost follows its rows however many sessions share it, and a crowded session sends one row per buffer; state keeps one
    summary per session and ends by an event-time timer.  A NULL session is a session; a hit without a value adds no damage.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= _BUFFER:
                yield _summaries(held, key, window_ms, log)
                held, size = [], 0
        if size:
            yield _summaries(held, key, window_ms, log)

    lists = ", ".join(f"{name} array<struct<{', '.join(':'.join(c.split()) for c in kind.split(', '))}>>" for name, kind in (("window", _INSTANT), ("log", _ENTRY)))
    use_rocksdb(hits.sparkSession)
    rows = hits.select(key, "timestamp_ms", "frame_index", "ordinal", "parsed_value", F.unix_millis("event_time").alias("_event"))
    rows = rows.mapInArrow(combine, f"{key} bigint, {_PARTIAL}, newest bigint, {lists}")
    return rows.groupBy(key).transformWithState(_SessionStats(window_ms, idle_ms, log), _STATS_OUT, "update", "EventTime")


def dps_timeline(hits: DataFrame, bucket_ms: int = 1000, late: str = LATE, key: str = "session_id") -> DataFrame:
    """Buckets of session time, for update mode; read them with ``latest_buckets``.

    Buckets follow the session's clock and close by the wall clock at which they began, so a bucket open at the end is there
    as well.  ``hits`` carry ``started_at_ms`` and no watermark yet.
    """
    start = F.floor(F.col("timestamp_ms") / bucket_ms) * bucket_ms
    placed = with_event_time(hits.withColumn("start_ms", start.cast("bigint")), "start_ms", late, "bucket_time")
    w = placed.groupBy(key, "start_ms", "bucket_time").agg(F.sum("parsed_value").alias("damage"), F.count("*").alias("hit_count"))
    return w.select(key, "start_ms", (F.col("start_ms") + bucket_ms).alias("end_ms"), "damage", "hit_count", (F.col("damage") / (bucket_ms / 1000)).alias("dps"))


def latest_buckets(updates: DataFrame, key: str = "session_id") -> DataFrame:
    """The last state of every bucket; a bucket only ever gains hits.  Empty buckets are filled by the batch operator."""
    facts = F.struct("end_ms", "damage", "hit_count", "dps")
    return updates.groupBy(key, "start_ms").agg(F.max_by(facts, "hit_count").alias("_s")).select(key, "start_ms", "_s.*")


def confirmed_damage(damage: DataFrame, cues: DataFrame, within_ms: int = 2000, reach: float = 50.0, key: str = "session_id") -> DataFrame:
    """Damage followed by a close cue within the interval.  Both sides carry watermarks, so each
    keeps only the rows that can still find a partner.

    Rows meet by session, interval of wall-clock time and cell of the screen: a cue is copied to its own interval and the
    one before, and to the nine cells about it, so a crowded session is no single key.
    """
    step = F.floor(F.unix_millis("event_time") / within_ms)
    d = damage.withColumns({"_step": step, "_x": F.floor(F.col("center_x") / reach), "_y": F.floor(F.col("center_y") / reach)}).alias("d")
    own = F.floor(F.unix_millis("cue_time") / within_ms)
    cells = [F.floor(F.col(f"center_{a}") / reach) for a in "xy"]
    spots = F.array(*[F.struct((own - t).alias("_step"), (cells[0] + x).alias("_x"), (cells[1] + y).alias("_y")) for t in (0, 1) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    c = cues.withColumn("_spot", F.explode(spots)).withColumns({n: F.col(f"_spot.{n}") for n in ("_step", "_x", "_y")}).alias("c")
    near = F.hypot(F.col("d.center_x") - F.col("c.center_x"), F.col("d.center_y") - F.col("c.center_y")) < reach
    cond = (F.col("c.cue_time") > F.col("d.event_time")) & (F.col("c.cue_time") <= F.col("d.event_time") + F.expr(f"interval {within_ms} milliseconds")) & near
    for name in (key, "_step", "_x", "_y"):
        cond = (F.col(f"d.{name}") == F.col(f"c.{name}")) & cond
    return d.join(c, cond).select(
        F.col(f"d.{key}"), F.col("d.ordinal").alias("damage_ordinal"), F.col("d.value"), F.col("c.cue_type"), F.col("c.ordinal").alias("cue_ordinal"),
    )


_MOMENT = "is_cue boolean, frame bigint, timestamp_ms bigint, ordinal bigint, value bigint, center_x double, center_y double, cue_type string, wall bigint"
_LIVE = "enemy_id bigint, frame bigint, value bigint, confidence double, x double, y double"
_FACTS = (
    "enemy_id bigint, total_damage bigint, hits bigint, last_frame bigint, last_ms bigint, final_hit bigint, x double, y double, cue_ms bigint, cue_ordinal bigint, cue_frame bigint, cue_type string"
)
_KILL = "session_id bigint, enemy_id bigint, timestamp_ms bigint, frame_index int, total_damage bigint, hits bigint, final_hit bigint, x double, y double, cue_type string"


class _Enemies(StatefulProcessor):
    """The enemies of one session, and which of them a cue after their last damage has confirmed as killed.

    Moments wait until the watermark has passed a later frame, so frames are worked off whole and in order: first the damage of
    a frame joins its enemies or opens new ones, then its cues are held against every enemy's last damage.  Later damage to an
    enemy voids its cue.  An enemy is settled once no later damage can reach it and every cue in time has been seen; a
    timer settles all when the session stays silent for ``idle_ms``.
    """

    def __init__(self, within_ms: int, reach: float, window: int, radius: float, idle_ms: int) -> None:
        self.within_ms, self.reach, self.window, self.radius, self.idle_ms = within_ms, reach, window, radius, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _MOMENT)
        self.live = handle.getListState("live", _LIVE)
        self.facts = handle.getListState("facts", _FACTS)

    def _work_off(self, key, waiting: list[tuple], mark: int | None):
        """Takes the frames that are complete (all, if ``mark`` is None) and yields the kills that are certain."""
        front = max((m[1] for m in waiting if m[8] < mark), default=None) if mark is not None else None
        ready = [m for m in waiting if mark is None or (front is not None and m[1] < front)]
        rest = [m for m in waiting if mark is not None and (front is None or m[1] >= front)]
        live = [list(r) for r in self.live.get()]
        facts = {r[0]: list(r) for r in self.facts.get()}
        joins = nearby_enemy(self.radius)
        for is_cue, frame, ms, ordinal, value, x, y, cue_type, _ in sorted(ready, key=lambda m: (m[1], m[0], m[2] if m[0] else 0, m[3])):
            if is_cue:
                for f in facts.values():
                    if f[4] < ms <= f[4] + self.within_ms and hypot(f[6] - x, f[7] - y) < self.reach and (f[8] is None or (ms, ordinal) < (f[8], f[9])):
                        f[8:] = [ms, ordinal, frame, cue_type]
                continue
            live[:] = [e for e in live if frame - e[1] < self.window]
            enemy = joins(live, (ordinal, frame, value, 0.0, x, y))
            f = facts.setdefault(enemy, [enemy, 0, 0, *[None] * 9])
            f[1:8] = [f[1] + value, f[2] + 1, frame, ms, value, x, y]
            if f[8] is not None and f[8] <= ms:
                f[8:] = [None] * 4
        begun = min((m[2] for m in rest if m[1] == front), default=None)
        for enemy, f in list(facts.items()):
            if mark is None or (front is not None and front - f[3] >= self.window and begun > f[4] + self.within_ms):
                del facts[enemy]
                if f[8] is not None:
                    yield Row(session_id=key[0], enemy_id=enemy, timestamp_ms=f[8], frame_index=f[10], total_damage=f[1], hits=f[2], final_hit=f[5], x=f[6], y=f[7], cue_type=f[11])
        for state, rows in ((self.waiting, rest), (self.live, live), (self.facts, list(facts.values()))):
            if rows:
                state.put([tuple(r) for r in rows])
            else:  # an empty list cannot be stored
                state.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        waiting = [tuple(r) for r in self.waiting.get()] + [tuple(r)[1:] for r in rows]
        newest = max(m[8] for m in waiting)
        for at in list(self.handle.listTimers()):
            newest = max(newest, at - self.idle_ms)
            self.handle.deleteTimer(at)
        self.handle.registerTimer(newest + self.idle_ms)
        yield from self._work_off(key, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self._work_off(key, [tuple(r) for r in self.waiting.get()], None)
        for state in (self.waiting, self.live, self.facts):
            state.clear()

    def close(self) -> None:
        pass


def kill_events(
    damage: DataFrame, cues: DataFrame, within_ms: int = 2000, reach: float = 50.0, window: int = 60, radius: float = 100.0, idle_ms: int = 86_400_000, key: str = "session_id"
) -> DataFrame:
    """Kills as they become certain, from two streams of one watermark: damage and cues, each with ``event_time``.

    Session time must not fall from one frame to the next.  The rows are those of the batch operator, before its scores (``kill_scores``).
    """
    use_rocksdb(damage.sparkSession)
    wall = F.unix_millis("event_time").alias("wall")
    place = [F.col("center_x").cast("double").alias("center_x"), F.col("center_y").cast("double").alias("center_y")]
    moments = [F.col(key).cast("bigint").alias(key), F.col("frame").cast("bigint").alias("frame"), "timestamp_ms", F.col("ordinal").cast("bigint").alias("ordinal")]
    none = F.lit(None)
    hit = damage.select(*moments, F.lit(False).alias("is_cue"), F.col("value").cast("bigint").alias("value"), *place, none.cast("string").alias("cue_type"), wall)
    cue = cues.select(*moments, F.lit(True).alias("is_cue"), none.cast("bigint").alias("value"), *place, "cue_type", wall)
    rows = hit.unionByName(cue).select(key, *[c.split()[0] for c in _MOMENT.split(", ")])
    return rows.groupBy(key).transformWithState(_Enemies(within_ms, reach, window, radius, idle_ms), _KILL, "append", "EventTime")


def refresh_sessions(source: str, schema, analyse, target: str, key: str = "session_id"):
    """``foreachBatch`` body: re-analyses the sessions seen in a batch and replaces exactly their rows.

    ``source`` and ``target`` are tables of hashed buckets; of both a batch touches the buckets of its sessions only.  Running a
    batch twice gives the same table.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        touched = cut_lineage(batch.select(F.col(key).alias("_key")).distinct())
        rows = load_rows(batch.sparkSession, source, schema, touched_buckets(touched, "_key"))
        replace_rows(analyse(rows.join(touched, F.col(key).eqNullSafe(F.col("_key")), "left_semi")), target, key)

    return run


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes what is there now, writes it as a table and returns the table."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, epoch: int) -> None:
            # The batch number is part of the folder, so a repeated batch replaces itself.
            batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path) if mode == "append" else spark.read.parquet(path)
