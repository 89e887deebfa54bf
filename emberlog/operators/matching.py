"""Band, distance and one-to-one joins between detections, truth and neighbouring lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import sqrt
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog.functions import text as tx
from emberlog.functions.scoring import VALUE_RANGES, within_share
from emberlog.operators.chained import chained_scan
from emberlog.operators.places import CROWD, by_cell
from emberlog.operators.stats import with_rates
from emberlog.operators.timeline import near_frames, top_k
from emberlog.session import cut_lineage

SESSION = ["session_id"]


def temporal_support(lines: DataFrame, window: int = 2, reach: float = 80.0, keys: list[str] = SESSION, crowd: int = CROWD) -> DataFrame:
    """Adds ``support``: closeness-weighted count of lines in neighbouring frames.

    Support depends only on frame and position, so equal positions are merged with a weight
    before the join: a frame then holds at most as many points as it has pixels, however
    many copies of a line there are.  Frames are matched by equality on shifted copies, crowded ones cell by cell.
    """
    place = [*keys, "frame_index", "center_x", "center_y"]
    # The filter is what the joins below imply for each side; stating it once lets them share one shuffle.
    known = reduce(and_, [F.col(c).isNotNull() for c in place])
    points = lines.filter(known).groupBy(*place).agg(F.count("*").alias("_w"))
    targets = F.array(*[F.col("frame_index") + d for d in range(-window, window + 1) if d])
    other = points.select(*keys, F.explode(targets).alias("frame_index"), F.col("center_x").alias("_x"), F.col("center_y").alias("_y"), F.col("_w").alias("_ow"))
    d = F.hypot(F.col("center_x") - F.col("_x"), F.col("center_y") - F.col("_y"))
    points, other, cells = by_cell(points, other, [*keys, "frame_index"], ["center_x", "center_y"], ["_x", "_y"], reach, crowd)
    pairs = points.join(other, [*keys, "frame_index", *cells]).filter(d <= reach)
    support = pairs.groupBy(*keys, "frame_index", "center_x", "center_y").agg(F.sum(F.col("_ow") * (1.0 - d / reach * 0.5)).alias("support"))
    return lines.join(support, [*keys, "frame_index", "center_x", "center_y"], "left").na.fill(0.0, ["support"])


def seed_expansion(
    supported: DataFrame, window: int = 2, reach: float = 80.0, keep: int = 50, max_seeds: int = 48, keys: list[str] = SESSION
) -> DataFrame:
    """Lines worth reading: the strongest seeds of each session and the two nearest lines per
    seed and neighbouring frame, ranked.  Seeds are at most ``max_seeds`` per session."""
    n = supported.groupBy(*keys).agg(F.count("*").alias("_n"))
    strength = F.round(F.col("score") + F.col("support") * 1.5, 9)
    ranked = top_k(supported, keys, [F.desc(strength), F.asc("frame_index"), F.asc("ordinal")], max_seeds, rank="_r")
    allowed = F.least(F.greatest(F.lit(12), F.floor(F.col("_n") / 4)), F.lit(max_seeds))
    seeds = ranked.join(n, keys).filter(F.col("_r") <= allowed)
    seeds = seeds.select(
        *keys, (F.col("_r") - 1).alias("seed_pos"), F.col("frame_index").alias("seed_frame"), F.col("score").alias("seed_score"),
        F.col("support").alias("seed_support"), F.col("center_x").alias("sx"), F.col("center_y").alias("sy"),
    )
    near = near_frames(seeds, "seed_frame", window, "frame_index")
    d = F.hypot(F.col("center_x") - F.col("sx"), F.col("center_y") - F.col("sy"))
    pairs = near.join(supported, [*keys, "frame_index"]).withColumn("distance", d).filter(F.col("distance") <= reach)
    best = top_k(pairs, [*keys, "seed_pos", "frame_index"], [F.asc("distance"), F.desc("score"), F.asc("ordinal")], 2, rank="_fr")
    rank = (
        F.col("seed_score") * 2.0 + F.col("seed_support") * 1.5 + F.col("score") + F.col("support")
        - F.abs(F.col("frame_index") - F.col("seed_frame")) * 0.75 - F.col("distance") / reach
        - (F.col("_fr") - 1) * 0.25 - F.col("seed_pos") * 0.05
    )
    per_line = best.groupBy(*keys, "ordinal", "frame_index", "score").agg(F.round(F.max(rank), 6).alias("selection_rank"))
    return top_k(per_line, keys, [F.desc("selection_rank"), F.asc("frame_index"), F.desc("score"), F.asc("ordinal")], keep)


class _Match:
    """Takes the nearest unmatched truth within the tolerances.

    Truth rows enter the live list when they come into reach; a detection removes the one it
    takes.  A live entry is [ordinal, arrival, frame, value, x, y].
    """

    reads_ids = True

    def __init__(self, frames: int, share: float, reach: float) -> None:
        self.frames, self.share, self.reach = frames, share, reach

    def __call__(self, live: list, row: tuple) -> int | None:
        ident, arrival, is_truth, frame, value, x, y = row
        if is_truth:
            live.append([ident, arrival, frame, value, x, y])
            return None
        best, best_key = None, None
        reach = self.reach
        for e in live:
            dx, dy = x - e[4], y - e[5]
            if dx > reach or dx < -reach or dy > reach or dy < -reach or abs(frame - e[2]) > self.frames:
                continue
            if (value != 0) if e[3] == 0 else abs(value - e[3]) / e[3] > self.share:
                continue
            d = sqrt(dx**2 + dy**2)
            if d <= reach and (best_key is None or (d, e[0]) < best_key):
                best, best_key = e, (d, e[0])
        if best is None:
            return None
        live.remove(best)
        return best[0]


def match_truth(
    detections: DataFrame, truth: DataFrame, frames: int = 3, share: float = 0.1, reach: float = 70.0, keys: list[str] = SESSION, span: int = 16384
) -> DataFrame:
    """One-to-one greedy matching in detection order (frame, ordinal).

    Returns the detections with ``truth_ordinal`` (NULL for a false positive).  No pair list is
    built: both sides are streamed in arrival order through a bounded live list.
    """
    det = detections.select(
        *keys, F.col("frame").cast("bigint").alias("_at"), F.lit(0).alias("_truth"), F.col("frame").cast("bigint").alias("frame"),
        "value", F.col("center_x").alias("x"), F.col("center_y").alias("y"), "ordinal",
    )
    tru = truth.select(*keys, (F.col("frame") - frames).cast("bigint").alias("_at"), F.lit(1).alias("_truth"), F.col("frame").cast("bigint").alias("frame"), "value", "x", "y", "ordinal")
    both = det.unionByName(tru).withColumn("_after", F.lit(1) - F.col("_truth"))
    fields = ["ordinal", "_at", "_truth", "frame", "value", "x", "y"]
    out = chained_scan(both, keys, "_at", ["_after", "ordinal"], fields, 2 * frames, _Match(frames, share, reach), span)
    return out.filter("_truth = 0").select(*keys, "frame", "value", "x", "y", "ordinal", F.col("assigned").alias("truth_ordinal"))


def match_counts(matched: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """True / false positives and false negatives per key, for keys present on either side."""
    d = matched.groupBy(*keys).agg(F.count("truth_ordinal").alias("tp"), F.count_if(F.col("truth_ordinal").isNull()).alias("fp"))
    t = truth.groupBy(*keys).agg(F.count("*").alias("_truths"))
    both = d.join(t, keys, "full").na.fill(0, ["tp", "fp", "_truths"])
    return both.withColumn("fn", F.col("_truths") - F.col("tp")).drop("_truths")


def frame_metrics(detections: DataFrame, truth: DataFrame, share: float = 0.1, reach: float = 70.0, keys: list[str] = SESSION, span: int = 16384) -> DataFrame:
    """Matching inside each exact frame; frames of either side appear."""
    matched = match_truth(detections, truth, frames=0, share=share, reach=reach, keys=keys, span=span)
    t = truth.withColumn("frame", F.col("frame").cast("bigint"))
    return with_rates(match_counts(matched, t, [*keys, "frame"]))


def range_metrics(detections: DataFrame, truth: DataFrame, keys: list[str] = SESSION, ranges=VALUE_RANGES, **tolerances) -> DataFrame:
    """Metrics per value range: truth is filtered by range, detections are not (so a false
    positive repeats in every range).  Detections are copied once per range, a fixed number."""
    label = F.lit(None).cast("string")
    for name, low, high in reversed(ranges):
        cond = F.lit(True)
        if low is not None:
            cond = cond & (F.col("value") >= low)
        if high is not None:
            cond = cond & (F.col("value") < high)
        label = F.when(cond, name).otherwise(label)
    t = truth.withColumn("value_range", label)
    d = detections.withColumn("value_range", F.explode(F.array(*[F.lit(r[0]) for r in ranges])))
    k = [*keys, "value_range"]
    return with_rates(match_counts(match_truth(d, t, keys=k, **tolerances), t, k))


def label_by_truth(
    results: DataFrame, truth: DataFrame, frames: int = 3, share: float = 0.1, reach: float = 70.0, keys: list[str] = SESSION, crowd: int = CROWD
) -> DataFrame:
    """Adds ``label`` 1 where any truth is close in frame, value and place (not one-to-one)."""
    t = truth.select(*keys, F.col("frame").alias("_f"), F.col("value").alias("_v"), F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    t = near_frames(t, "_f", frames, "frame").drop("_f").distinct()
    close = F.hypot(F.col("d.center_x") - F.col("t._x"), F.col("d.center_y") - F.col("t._y")) <= reach
    value_ok = (F.col("t._v") <= 0) | within_share(F.col("d.value"), F.col("t._v"), share)
    placed, t, cells = by_cell(results, t, [*keys, "frame"], ["center_x", "center_y"], ["_x", "_y"], reach, crowd)
    same = [F.col(f"d.{k}") == F.col(f"t.{k}") for k in [*keys, "frame", *cells]]
    cond = close & value_ok
    for s in same:
        cond = cond & s
    d = placed.alias("d")
    hit = d.join(t.alias("t"), cond, "left_semi").select(*keys, "ordinal").withColumn("_hit", F.lit(1))
    return results.join(hit, [*keys, "ordinal"], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def truth_near(frames: DataFrame, truth: DataFrame, tolerance: int = 0, keys: list[str] = SESSION) -> DataFrame:
    """Truth rows within ``tolerance`` of each asked frame."""
    near = near_frames(truth.withColumnRenamed("frame", "truth_frame"), "truth_frame", tolerance, "frame")
    return frames.select(*keys, "frame").distinct().join(near, [*keys, "frame"])


def suffix_hints(lines: DataFrame, max_w: int = 200, max_h: int = 120, max_gap: int = 120, drift: float = 0.55, keys: list[str] = ["session_id", "frame_index"], crowd: int = CROWD) -> DataFrame:  # noqa: B006
    """Completes plain numbers with the nearest K / M / B line to their right in the frame.

    The lines of a frame are brought together once, and each number looks its suffix up in the list of the frame's suffix-like lines.  Where a frame has
    more than ``crowd`` of those, no list is built: both sides meet cell by cell.
    """
    base = tx.read_texts(lines)
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    small = (F.col("right") - F.col("left") + 1 <= max_w) & (F.col("bottom") - F.col("top") + 1 <= max_h)
    number = F.col("normalized").rlike("[0-9]$") & F.col("parsed_value").isNotNull()
    flags = {"_number": known & number, "_suffix": known & small & F.col("normalized").isin("K", "M", "B")}
    base = base.withColumns({n: F.coalesce(f, F.lit(False)) for n, f in flags.items()})

    def fits(left: Column, top: Column, bottom: Column) -> Column:
        gap = left - F.col("right") - 1
        tall = F.greatest(F.col("bottom") - F.col("top") + 1, bottom - top + 1)
        off = F.abs((F.col("top") + F.col("bottom")) / 2 - (top + bottom) / 2)
        return (gap >= 0) & (gap <= max_gap) & (off <= tall * drift)

    most = base.filter("_suffix").groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= crowd:
        out = _listed_hints(base, keys, fits)
    else:
        base = cut_lineage(base.withColumn("_suffixes", F.count_if("_suffix").over(W.partitionBy(*keys))))
        out = _listed_hints(base.filter(F.col("_suffixes") <= crowd), keys, fits).unionByName(_crowded_hints(base.filter(F.col("_suffixes") > crowd), keys, fits, max_gap + 1))
    out = out.drop("_number", "_suffix", "_suffixes")
    return out.withColumn("completed", F.when(F.col("hint").isNotNull(), F.concat("normalized", "hint")).otherwise(F.col("normalized")))


def _listed_hints(base: DataFrame, keys: list[str], fits: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Adds ``hint`` from a list of each frame's suffixes: one shuffle and one sort."""
    frame = W.partitionBy(*keys).orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = F.struct("left", "top", "bottom", F.col("ordinal").alias("at"), F.col("normalized").alias("hint"))
    listed = base.withColumn("_hints", F.collect_list(F.when(F.col("_suffix"), found)).over(frame))
    near = F.filter("_hints", lambda h: fits(h["left"], h["top"], h["bottom"]))
    nearest = F.array_min(F.transform(near, lambda h: F.struct((h["left"] - F.col("right") - 1).alias("gap"), h["at"].alias("at"), h["hint"].alias("hint"))))
    listed = listed.withColumn("_best", F.when(F.col("_number"), nearest)).drop("_hints")
    return listed.withColumn("hint", F.min("_best").over(W.partitionBy(*keys, "ordinal"))["hint"]).drop("_best")


def _crowded_hints(base: DataFrame, keys: list[str], fits: Callable[[Column, Column, Column], Column], reach: int) -> DataFrame:
    """Adds ``hint`` for frames of any number of suffixes: merged by place and text, they are copied to the two cells from which a line may reach them."""
    place = [F.col("left").alias("h_left"), F.col("top").alias("h_top"), F.col("bottom").alias("h_bottom"), F.col("normalized").alias("hint")]
    merged = base.filter("_suffix").groupBy(*keys, *place).agg(F.min("ordinal").alias("h_ordinal"))
    cell = F.floor(F.col("h_left") / reach)
    copies = merged.withColumn("_cell", F.explode(F.array(cell - 1, cell)))
    asked = base.filter("_number").select(*keys, "ordinal", "top", "right", "bottom", F.floor(F.col("right") / reach).alias("_cell"))
    pairs = asked.join(copies, [*keys, "_cell"]).filter(fits(F.col("h_left"), F.col("h_top"), F.col("h_bottom")))
    best = pairs.groupBy(*keys, "ordinal").agg(F.min_by("hint", F.struct((F.col("h_left") - F.col("right") - 1).alias("gap"), "h_ordinal")).alias("hint"))
    return base.join(best, [*keys, "ordinal"], "left")


def missed_frames(captured: DataFrame, detected: DataFrame, recent: int = 30, least: int = 10, keys: list[str] = SESSION) -> DataFrame:
    """Recent captured frames without a detection record, for sessions with enough frames."""
    last = top_k(captured.select(*keys, "frame_index", "timestamp_ms").distinct(), keys, [F.desc("frame_index"), F.desc("timestamp_ms")], recent)
    enough = last.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    gone = last.join(enough, keys, "left_semi").join(detected.select(*keys, "frame_index").distinct(), [*keys, "frame_index"], "left_anti")
    return gone.select(*keys, "frame_index", "timestamp_ms", F.lit(0.5).alias("prediction_confidence"), F.lit("motion_without_detection").alias("reason"))
