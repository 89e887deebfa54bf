"""Frame-level jobs: colour census, motion gates, blobs, frame sampling, line ranking."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog.functions import geometry as geo
from emberlog.operators.timeline import positions, previous_row, top_k

FRAME = ["frame_index"]

# Fixed values: (hue, saturation, value) ranges of combat text, hue in half degrees.
CENSUS_RANGES = [
    ((10, 30), (120, 255), (140, 255)),  # yellow and orange
    ((0, 180), (0, 40), (190, 255)),  # white
    ((90, 130), (100, 255), (140, 255)),  # blue
    ((0, 8), (130, 255), (130, 255)),  # red, low end
    ((172, 180), (130, 255), (130, 255)),  # red, high end
    ((40, 85), (100, 255), (100, 255)),  # green
    ((130, 165), (100, 255), (100, 255)),  # purple
]
# Ranges and prior confidence per damage colour, in detection order.
COLOUR_RANGES = {
    "yellow_orange": ((10, 30), (120, 255), (140, 255), 0.95),
    "white": ((0, 180), (0, 40), (190, 255), 0.85),
    "blue": ((90, 130), (100, 255), (140, 255), 0.90),
    "green": ((50, 70), (100, 255), (140, 255), 0.85),
    "red": ((0, 10), (150, 255), (140, 255), 0.85),
    "purple": ((130, 160), (80, 255), (140, 255), 0.80),
    "gold": ((25, 35), (150, 255), (180, 255), 0.90),
}


def with_hsv(pixels: DataFrame) -> DataFrame:
    """Adds h (0-180), s and v (0-255) from 8-bit r, g, b."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    v = F.greatest(r, g, b)
    spread = v - F.least(r, g, b)
    div = F.nullif(spread, F.lit(0))
    degrees = (
        F.when(spread == 0, 0.0)
        .when(v == r, (g - b) / div * 60.0)
        .when(v == g, (b - r) / div * 60.0 + 120.0)
        .otherwise((r - g) / div * 60.0 + 240.0)
    )
    h = F.rint(degrees / 2).cast("int")
    s = F.coalesce(F.rint(spread / F.nullif(v, F.lit(0)) * 255.0), F.lit(0.0)).cast("int")
    return pixels.withColumns({"h": F.when(h < 0, h + 180).otherwise(h), "s": s, "v": v})


def _in_range(h: tuple, s: tuple, v: tuple) -> Column:
    return F.col("h").between(*h) & F.col("s").between(*s) & F.col("v").between(*v)


def is_combat_text() -> Column:
    return reduce(or_, [_in_range(*r) for r in CENSUS_RANGES])


def pixel_census(pixels: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Combat-text pixels per frame: one conditional count, combined before the shuffle."""
    return with_hsv(pixels).groupBy(*keys).agg(F.count_if(is_combat_text()).alias("text_pixels"), F.count("*").alias("pixels"))


def colour_masks(pixels: DataFrame, total_pixels: int, keys: list[str] = FRAME) -> DataFrame:
    """Pixel count and confidence of every colour per frame (long form) from one aggregation."""
    wide = with_hsv(pixels).groupBy(*keys).agg(*[F.count_if(_in_range(*r[:3])).alias(f"n_{c}") for c, r in COLOUR_RANGES.items()])
    items = [
        F.struct(F.lit(i).alias("colour_order"), F.lit(c).alias("colour"), F.lit(r[3]).alias("prior"), F.col(f"n_{c}").alias("pixel_count"))
        for i, (c, r) in enumerate(COLOUR_RANGES.items())
    ]
    long = wide.select(*keys, F.inline(F.array(*items)))
    fill = F.col("pixel_count") / F.lit(total_pixels)
    quality = (
        F.when(F.col("pixel_count") == 0, 0.0).when(fill.between(0.01, 0.10), 1.0).when(fill < 0.01, fill / 0.01)
        .otherwise(F.greatest(F.lit(0.1), 1.0 - (fill - 0.10) / 0.90))
    )
    return long.select(*keys, "colour_order", "colour", "pixel_count", (quality * F.col("prior")).alias("confidence"))


def dominant_colour(masks: DataFrame, min_pixels: int = 100, keys: list[str] = FRAME) -> DataFrame:
    """Colour with the highest count times confidence; the earlier colour wins a tie."""
    score = F.round(F.col("pixel_count") * F.col("confidence"), 9)
    ok = masks.filter((F.col("pixel_count") >= min_pixels) & (score > 0))
    best = F.max_by(F.struct("colour", "pixel_count", "confidence"), F.struct(score, -F.col("colour_order")))
    return ok.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def combined_mask(pixels: DataFrame, colours: list[str] | None = None, keys: list[str] = FRAME) -> DataFrame:
    chosen = reduce(or_, [_in_range(*COLOUR_RANGES[c][:3]) for c in colours or COLOUR_RANGES])
    return with_hsv(pixels).groupBy(*keys).agg(F.count_if(chosen).alias("mask_pixels"))


def calibrate(pixels: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Colour range per sample: mean plus or minus two population deviations, truncated and clipped."""
    agg = with_hsv(pixels).groupBy(*keys).agg(
        *[e for c in "hsv" for e in (F.avg(c).alias(f"m{c}"), F.stddev_pop(c).alias(f"d{c}"))]
    )
    out = []
    for c, name, top in (("h", "hue", 180), ("s", "sat", 255), ("v", "val", 255)):
        lo, hi = F.round(F.col(f"m{c}") - 2 * F.col(f"d{c}"), 9).cast("int"), F.round(F.col(f"m{c}") + 2 * F.col(f"d{c}"), 9).cast("int")
        out += [F.greatest(F.lit(0), lo).alias(f"{name}_min"), F.least(F.lit(top), hi).alias(f"{name}_max")]
    return agg.select(*keys, *out)


# --- motion ---------------------------------------------------------------------------------


def motion(thumbs: DataFrame, cut: float = 100.0, keys: list[str] = ["session_id"], axis: str = "frame_index", width: int = 1024) -> DataFrame:  # noqa: B006
    """Mean absolute difference to the previous captured frame (NULL for the first), and the share
    of strongly changed pixels times ten, at most one (0 for the first)."""
    d = previous_row(thumbs, keys, axis, ["thumb"], width=width)
    delta = F.zip_with("thumb", "prev_thumb", lambda a, b: F.abs(a - b))
    total = F.aggregate(delta, F.lit(0.0), lambda acc, x: acc + x)
    strong = F.size(F.filter(delta, lambda x: x > cut))
    n = F.size("thumb")
    return d.select(
        *keys, axis, F.when(F.col("prev_thumb").isNotNull(), total / n).alias("mean_change"),
        F.when(F.col("prev_thumb").isNull(), 0.0).otherwise(F.least(strong / n * 10, F.lit(1.0))).alias("motion_score"),
    )


def motion_gate(thumbs: DataFrame, threshold: float = 3.0, **kw) -> DataFrame:
    m = motion(thumbs, **kw)
    return m.withColumn("is_kept", F.coalesce(F.col("mean_change") >= threshold, F.lit(True)))


# --- blobs ----------------------------------------------------------------------------------


def _label_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    """Joins horizontal runs of neighbouring rows that overlap; one frame of runs at a time."""
    pdf = pdf.sort_values(["y", "x0"], ignore_index=True)
    parent = list(range(len(pdf)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above, current, row = [], [], None
    for i, (y, x0, x1) in enumerate(zip(pdf["y"].tolist(), pdf["x0"].tolist(), pdf["x1"].tolist())):
        if y != row:
            above, current, row = (current if row is not None and y == row + 1 else []), [], y
        for j, a0, a1 in above:
            if a0 <= x1 and x0 <= a1:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        current.append((i, x0, x1))
    pdf["label"] = [root(i) for i in range(len(pdf))]
    return pdf


def components(mask: DataFrame, min_pixels: int = 20, min_width: int = 4, min_height: int = 6, keys: list[str] = FRAME) -> DataFrame:
    """4-connected blobs of a pixel mask (``keys``, x, y) with their boxes.

    Pixels become horizontal runs in Spark (a row holds at most the image width); only the
    runs of one frame, bounded by the image area, meet in one Python call.
    """
    points = mask.select(*keys, "x", "y").distinct()
    row = W.partitionBy(*keys, "y").orderBy("x")
    runs = points.withColumn("_g", F.col("x") - F.row_number().over(row)).groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = runs.select(*keys, "y", "x0", "x1")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields) + ", label long"
    labelled = runs.groupBy(*keys).applyInPandas(_label_frame, schema)
    boxes = labelled.groupBy(*keys, "label").agg(
        F.min("x0").alias("left"), F.min("y").alias("top"), F.max("x1").alias("right"), F.max("y").alias("bottom"), F.sum(F.col("x1") - F.col("x0") + 1).alias("pixel_count")
    )
    return _sized(boxes, min_pixels, min_width, min_height).drop("label")


def _sized(boxes: DataFrame, min_pixels: int, min_width: int, min_height: int) -> DataFrame:
    return boxes.filter(
        (F.col("pixel_count") >= min_pixels) & (F.col("right") - F.col("left") + 1 >= min_width) & (F.col("bottom") - F.col("top") + 1 >= min_height)
    )


def split_wide(mask: DataFrame, boxes: DataFrame, ratio: float = 1.6, min_pixels: int = 20, min_width: int = 4, min_height: int = 6, keys: list[str] = FRAME) -> DataFrame:
    """Cuts over-wide boxes at columns with at most one pixel.  A box stays whole when there is
    nothing to cut or no piece is large enough."""
    box = [*keys, "left", "top", "right", "bottom"]
    wide = F.col("right") - F.col("left") + 1 > F.floor((F.col("bottom") - F.col("top") + 1) * ratio)
    points = mask.select(*keys, "x", "y").distinct()
    # One row per column of a wide box, so pixels join on equality of frame and column.
    cols = boxes.filter(wide).select(*box, F.explode(F.sequence("left", "right")).alias("x"))
    inside = cols.join(points, [*keys, "x"]).filter(F.col("y").between(F.col("top"), F.col("bottom")))
    column = inside.groupBy(*box, "x").agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1")).filter("n > 1")
    # Consecutive kept columns of one box; a box has at most the image width of them.
    grouped = column.withColumn("_g", F.col("x") - F.row_number().over(W.partitionBy(*box).orderBy("x")))
    seg = grouped.groupBy(*box, "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("n").alias("n"))
    counted = seg.withColumn("_segments", F.count("*").over(W.partitionBy(*box)))
    pieces = counted.filter("_segments > 1").select(
        *[F.col(c).alias(f"_{c}") if c not in keys else F.col(c) for c in box],
        F.col("x0").alias("left"), F.col("y0").alias("top"), F.col("x1").alias("right"), F.col("y1").alias("bottom"), F.col("n").alias("pixel_count"),
    )
    pieces = _sized(pieces, min_pixels, min_width, min_height)
    cut = pieces.select(*keys, *[F.col(f"_{c}").alias(c) for c in box if c not in keys]).distinct()
    whole = boxes.join(cut, box, "left_anti")
    out = [*keys, "left", "top", "right", "bottom", "pixel_count"]
    return whole.select(*out).unionByName(pieces.select(*out))


# --- sampling and ranking ---------------------------------------------------------------------


def densest_frames(frames: DataFrame, k: int = 12, measure: str = "pixels", keys: list[str] = ["session_id"]) -> DataFrame:  # noqa: B006
    return top_k(frames, keys, [F.desc(measure), F.asc("frame_index")], k)


def select_frames(frames: DataFrame, radius: int = 2, count: int | None = None, measure: str = "pixels", keys: list[str] = ["session_id"]) -> DataFrame:  # noqa: B006
    """The densest frames of each session and their neighbours by position."""
    placed = positions(frames, keys, "frame_index")
    most = count or 30
    seeds = top_k(placed, keys, [F.desc(measure), F.asc("pos")], most, rank="_r")
    if count is None:
        n = frames.groupBy(*keys).agg(F.count("*").alias("_n"))
        seeds = seeds.join(n, keys).filter(F.col("_r") <= geo.top_frame_count(F.col("_n")))
    wanted = seeds.select(*keys, F.explode(F.sequence(F.col("pos") - radius, F.col("pos") + radius)).alias("pos")).distinct()
    seed_pos = seeds.select(*keys, "pos", F.lit(True).alias("is_seed"))
    return placed.join(wanted, [*keys, "pos"], "left_semi").join(seed_pos, [*keys, "pos"], "left").na.fill(False, ["is_seed"])


def keyframes(frames: DataFrame, every: int = 3, last: int | None = None, keys: list[str] = ["session_id"]) -> DataFrame:  # noqa: B006
    """Every third frame; optionally only the latest ones among the last ``last * every`` frames."""
    if last is not None:
        frames = top_k(frames, keys, [F.desc("frame_index")], last * every, rank="_a").drop("_a")
    keys_only = frames.filter(F.pmod(F.col("frame_index"), F.lit(every)) == 0)
    if last is not None:
        keys_only = top_k(keys_only, keys, [F.desc("frame_index")], last, rank="_a").drop("_a")
    return keys_only


def skip_frames(frames: DataFrame, skip: int) -> DataFrame:
    return frames.filter(F.pmod(F.col("frame_index"), F.lit(skip + 1)) == 0)


def recent_frames(frames: DataFrame, limit: int, keys: list[str] = ["session_id"]) -> DataFrame:  # noqa: B006
    return top_k(frames, keys, [F.desc("frame_index")], limit)


def scored_lines(lines: DataFrame, gate: str = "live") -> DataFrame:
    d = [F.col(c) for c in ("width", "height", "pixel_count", "member_count")]
    return lines.withColumns({"score": geo.line_score(*d), "is_ready": geo.line_ready(*d, gate=gate)})


def best_lines(lines: DataFrame, k: int = 8, keys: list[str] = ["session_id", "frame_index"]) -> DataFrame:  # noqa: B006
    """The ``k`` best ready lines per frame; ties keep reading order (top, left)."""
    ready = lines.filter("is_ready")
    return top_k(ready, keys, [F.desc("score"), F.asc("top"), F.asc("left"), F.asc("line_id")], k)


def accepted(readings: DataFrame, min_confidence: float = 0.2) -> DataFrame:
    return readings.filter(F.col("parsed_value").isNotNull() & (F.col("confidence") >= min_confidence) & F.col("is_plausible"))


def ready_summary(candidates: DataFrame, keys: list[str] = ["session_id"]) -> DataFrame:  # noqa: B006
    return candidates.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if("is_ready").alias("ready"), F.max("score").alias("best_score"))


def ranked(candidates: DataFrame, keys: list[str] = ["session_id"]) -> DataFrame:  # noqa: B006
    """Whole ranking as one range-partitioned sort: ready first, then score, then size."""
    return candidates.orderBy(*keys, F.desc("is_ready"), F.desc("score"), F.desc("pixel_count"), F.asc("ordinal"))
