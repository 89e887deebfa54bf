"""Confidence: the heuristic score, the classifier's features and its default weights."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from emberlog.functions import text as tx


def _if(cond: Column, points: float) -> Column:
    return F.when(cond, points).otherwise(0.0)


def heuristic_confidence(
    raw: Column, parsed: Column, plausible: Column, line_score: Column, members: Column, width: Column, height: Column
) -> Column:
    """Sum of bonuses and penalties, clamped to [0, 1]."""
    nonempty = raw != ""
    has_unit = raw.rlike("[kKmMbB]")
    one_digit = F.length(F.regexp_replace(raw, "[^0-9]", "")) == 1
    parts = [
        F.least(line_score / 12.0, F.lit(1.0)) * 0.35,
        _if(parsed.isNotNull(), 0.35),
        _if(plausible, 0.2),
        _if(raw.rlike("^[0-9]"), 0.1),
        _if(has_unit, 0.1),
        _if(raw.rlike("[.,]"), 0.05),
        _if(members.between(2, 6), 0.05),
        _if(parsed == 0, -0.4),
        _if(nonempty & ~plausible, -0.35),
        _if(raw.startswith("0") & (F.length(raw) > 1) & ~raw.startswith("0."), -0.25),
        _if(nonempty & ~raw.rlike("[0-9]"), -0.4),
        _if(F.length(raw) <= 1, -0.3),
        _if(raw.rlike("[KMB]$") & one_digit & (width >= 50), -0.2),
        _if((parsed < 1000) & ~has_unit, -0.25),
        _if((width < 28) | (height < 16), -0.15),
    ]
    return F.greatest(F.lit(0.0), F.least(reduce(add, parts), F.lit(1.0)))


# Feature order and the weights used when no model is fitted.
FEATURE_WEIGHTS = {
    "line_score": 0.15,
    "fill_ratio": -0.20,
    "aspect_ratio": 0.05,
    "member_count": 0.03,
    "width": -0.001,
    "height": -0.001,
    "has_digit": 0.25,
    "has_suffix": 0.05,
    "has_decimal": 0.02,
    "starts_with_nonzero": 0.05,
    "text_length": -0.02,
    "parsed_value": 0.05,
    "value_in_range": 0.10,
    "is_plausible": 0.25,
}
FEATURES = list(FEATURE_WEIGHTS)


def feature_columns(line_score: Column, members: Column, width: Column, height: Column, pixels: Column, raw: Column) -> dict[str, Column]:
    """The fourteen classifier features of one candidate."""
    text = F.coalesce(raw, F.lit(""))
    value = F.when(text != "", tx.loose_parse(text))
    return {
        "line_score": line_score.cast("double"),
        "fill_ratio": pixels / F.greatest(width * height, F.lit(1)),
        "aspect_ratio": width / F.greatest(height, F.lit(1)),
        "member_count": members,
        "width": width,
        "height": height,
        "has_digit": text.rlike("[0-9]"),
        "has_suffix": F.upper(text).rlike("[KMB]"),
        "has_decimal": text.contains("."),
        "starts_with_nonzero": text.rlike("^[1-9]"),
        "text_length": F.length(text),
        "parsed_value": value,
        "value_in_range": F.coalesce(value.between(100, 100_000_000), F.lit(False)),
        "is_plausible": tx.loose_plausible(text),
    }


def feature_vector_inputs() -> list[Column]:
    """Numeric inputs for a fitted model; the parsed value enters as present or absent."""
    return [
        (F.col(f).isNotNull() if f == "parsed_value" else F.col(f)).cast("double").alias(f"v_{f}") for f in FEATURES
    ]


def weighted_score(features: dict[str, Column] | None = None) -> Column:
    """Default-weight score before the logistic step; the parsed value enters as a raw number."""
    cols = features or {f: F.col(f) for f in FEATURES}
    total = reduce(add, [F.coalesce(cols[f].cast("double"), F.lit(0.0)) * w for f, w in FEATURE_WEIGHTS.items()])
    return (total - 0.5) * 4.0


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


# Two readings merge below the first limit by their gap, below the second and from there on by its share.
MERGE_LIMITS = (1_000, 1_000_000)
MERGE_GAP = 5
MERGE_SHARES = (0.015, 0.03)


def values_merge(a: Column, b: Column) -> Column:
    """Whether two readings can be the same number."""
    big, small = F.greatest(a, b), F.least(a, b)
    gap = big - small
    return (
        F.when(a == b, True)
        .when(big < MERGE_LIMITS[0], gap <= MERGE_GAP)
        .when(big >= MERGE_LIMITS[1], gap / big <= MERGE_SHARES[1])
        .otherwise(gap / big <= MERGE_SHARES[0])
    )


def within_share(value: Column, reference: Column, share: float) -> Column:
    """Relative tolerance; a zero reference only accepts zero."""
    return F.when(reference == 0, value == 0).otherwise(F.abs(value - reference) / F.nullif(reference, F.lit(0)) <= share)


# Histogram edges and labels (left-closed).
CONFIDENCE_BUCKETS = [("0.0-0.2", 0.2), ("0.2-0.4", 0.4), ("0.4-0.6", 0.6), ("0.6-0.8", 0.8), ("0.8-1.0", None)]
DAMAGE_BUCKETS = [("0-1k", 1_000), ("1k-10k", 10_000), ("10k-100k", 100_000), ("100k-1M", 1_000_000), ("1M+", None)]
VALUE_RANGES = [
    ("tiny (<1k)", None, 1_000),
    ("small (1k-10k)", 1_000, 10_000),
    ("medium (10k-100k)", 10_000, 100_000),
    ("large (100k-1M)", 100_000, 1_000_000),
    ("huge (>1M)", 1_000_000, None),
]


def bucket_label(value: Column, buckets: list[tuple[str, float | None]]) -> Column:
    """The bucket of a value; a NULL has none."""
    out = F.when(value.isNotNull(), buckets[-1][0])
    for label, upper in reversed(buckets[:-1]):
        out = F.when(value < upper, label).otherwise(out)
    return out
