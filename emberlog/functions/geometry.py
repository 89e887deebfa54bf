"""Box and frame geometry: candidate scores, gates, regions of interest, sampling counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _if(cond: Column, points: float) -> Column:
    return F.when(cond, points).otherwise(0.0)


def _shape(width: Column, height: Column, pixels: Column) -> tuple[Column, Column]:
    fill = pixels / F.greatest(width * height, F.lit(1))
    aspect = width / F.greatest(height, F.lit(1))
    return fill, aspect


def token_score(width: Column, height: Column, pixels: Column) -> Column:
    fill, aspect = _shape(width, height, pixels)

    def closeness(value: Column, target: float) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - F.abs(value - target) / target)

    return (
        closeness(width, 46.0) * 3.0
        + closeness(height, 28.0) * 3.0
        + closeness(fill, 0.34) * 2.0
        + closeness(aspect, 1.8) * 2.0
        + _if(width.between(24, 90), 1.5)
        + _if(height.between(14, 56), 1.5)
        + _if(pixels.between(80, 1200), 1.0)
        + _if(aspect >= 1.35, 1.5)
        + _if(width > 90, -2.0)
        + _if(height > 70, -2.0)
        + _if(pixels > 1800, -2.5)
        + _if(fill > 0.8, -2.0)
        + _if(width < 24, -2.5)
        + _if(aspect < 1.1, -2.5)
    )


def token_ready(width: Column, height: Column, pixels: Column) -> Column:
    aspect = _shape(width, height, pixels)[1]
    return (
        (token_score(width, height, pixels) >= 7.0)
        & width.between(24, 90)
        & height.between(14, 70)
        & pixels.between(80, 1800)
        & (aspect >= 1.1)
    )


def line_score(width: Column, height: Column, pixels: Column, members: Column) -> Column:
    fill, aspect = _shape(width, height, pixels)
    return (
        _if(width.between(24, 260), 3.0)
        + _if(height.between(12, 150), 3.0)
        + _if(aspect.between(1.5, 5.0), 2.0)
        + _if(members.between(2, 6), 2.0)
        + _if(fill.between(0.15, 0.7), 2.0)
        + _if(members == 1, -3.0)
        + _if(width > 280, -2.5)
        + _if(height > 160, -2.5)
        + _if(fill > 0.75, -2.0)
    )


# The two readiness gates (minimum score, width range, height range, members).
LINE_GATES = {
    "batch": (5.0, (16, 260), (12, 90), 2),
    "live": (5.0, (12, 380), (10, 130), 1),
}


def line_ready(width: Column, height: Column, pixels: Column, members: Column, gate: str = "batch") -> Column:
    floor, w, h, m = LINE_GATES[gate]
    return (line_score(width, height, pixels, members) >= floor) & width.between(*w) & height.between(*h) & (members >= m)


def timestamp_ms(frame: Column, fps: Column) -> Column:
    """Session time of a frame, rounded half to even; NULL without a usable frame rate."""
    return F.when((fps > 0) & (frame >= 0), F.rint(frame / fps * 1000).cast("bigint"))


def scale_roi(image_w: Column, image_h: Column, left: float, top: float, width: float, height: float) -> Column:
    def part(size: Column, share: float) -> Column:
        return (size * F.lit(share)).cast("int")

    return F.struct(
        part(image_w, left).alias("left"), part(image_h, top).alias("top"),
        part(image_w, width).alias("width"), part(image_h, height).alias("height"),
    )


def clip_extent(offset: Column, extent: Column, limit: Column) -> Column:
    """Width or height of a region clipped to the window."""
    return F.greatest(F.lit(0), F.least(extent, limit - offset))


def inside(roi: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return (
        (left >= roi["left"]) & (top >= roi["top"])
        & (right < roi["left"] + roi["width"]) & (bottom < roi["top"] + roi["height"])
    )


def top_frame_count(frames: Column, low: int = 6, high: int = 30, share: float = 0.12) -> Column:
    """How many frames of a session to segment."""
    wanted = F.least(F.greatest(F.rint(frames * share), F.lit(float(low))), F.lit(float(high)))
    return F.when(frames <= 0, low).otherwise(wanted.cast("int"))
