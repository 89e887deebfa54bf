"""Evaluation against truth, before/after comparison and the regression gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.functions.text import fixed
from emberlog.operators.matching import match_counts, match_truth
from emberlog.operators.stats import with_rates

SESSION = ["session_id"]


@dataclass(frozen=True)
class Gate:
    """The regression thresholds."""

    f1_min: float = 0.70
    f1_max_drop: float = 0.05
    precision_min: float = 0.70
    recall_min: float = 0.70
    fps_min: float = 25.0
    latency_p95_max: float = 100.0


def run_benchmark(detections: DataFrame, truth: DataFrame, frames: DataFrame, keys: list[str] = SESSION, **tolerances) -> DataFrame:
    """Counts, rates and speed per session of ``frames (keys…, total_frames, processing_ms)``.

    A session without detections keeps all of its truths as false negatives; ``error`` is set only where there are no
    frames to look at.
    """
    counts = match_counts(match_truth(detections, truth, keys=keys, **tolerances), truth, keys)
    counts = frames.select(*keys, "total_frames", "processing_ms").join(counts, keys, "left").na.fill(0, ["tp", "fp", "fn"])
    speed = F.when(F.col("processing_ms") > 0, F.col("total_frames") * 1000 / F.col("processing_ms")).otherwise(0.0)
    out = with_rates(counts).withColumns(
        {
            "total_truth": F.col("tp") + F.col("fn"),
            "total_detected": F.col("tp") + F.col("fp"),
            "fps_processed": F.round(speed, 6),
            "error": F.when(F.coalesce("total_frames", F.lit(0)) == 0, "No frame images found"),
        }
    )
    return out.drop("processing_ms")


def average_rates(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("benchmarks"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("precision", "recall", "f1_score")]
    )


def _truthy(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != 0)


def against_baseline(current: DataFrame, baseline: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Attaches the baseline rates; the change is NULL when either side is missing or zero."""
    base = baseline.select(*keys, *[F.col(c).alias(f"baseline_{c}") for c in ("f1_score", "precision", "recall")])
    out = current.join(base, keys, "left")
    return out.withColumn("f1_change", F.when(_truthy("baseline_f1_score") & _truthy("f1_score"), F.col("f1_score") - F.col("baseline_f1_score")))


def compare_runs(before: DataFrame, after: DataFrame, keys: list[str] = SESSION, metrics: tuple[str, ...] = ("precision", "recall", "f1_score", "fps")) -> DataFrame:
    """Delta and percent change per metric in long form; growth from zero is infinite."""
    b = before.select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics])
    both = b.join(after.select(*keys, *metrics), keys)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("before"), F.col(m).alias("after")) for m in metrics])
    long = both.select(*keys, F.inline(rows))
    old, new = F.col("before"), F.col("after")
    percent = F.when(old != 0, (new - old) / F.nullif(old, F.lit(0.0)) * 100).when(new == 0, 0.0).otherwise(F.lit(float("inf")))
    return long.select(*keys, "metric", "before", "after", F.round(new - old, 6).alias("delta"), F.when(percent == float("inf"), percent).otherwise(F.round(percent, 6)).alias("percent_change"))


def check_gate(rows: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """Adds ``failures`` and ``warnings`` (arrays of rule names) and ``passed``.  A missing metric
    skips its rule; the latency rule applies where the column exists."""
    f1, p, r, fps, change = (F.col(c) for c in ("f1_score", "precision", "recall", "fps", "f1_change"))

    def rule(cond: Column, name: str) -> Column:
        return F.when(cond, name)

    failures = [
        rule(f1 < gate.f1_min, "f1_min"), rule(f1.isNotNull() & (change < -gate.f1_max_drop), "f1_drop"),
        rule(p < gate.precision_min, "precision_min"), rule(r < gate.recall_min, "recall_min"), rule(fps < gate.fps_min, "fps_min"),
    ]
    if "latency_p95" in rows.columns:
        failures.append(rule(F.col("latency_p95") > gate.latency_p95_max, "latency_p95_max"))
    warnings = [
        rule(f1.isNotNull() & (change < 0) & (change >= -gate.f1_max_drop), "f1_decreased"),
        rule((fps >= gate.fps_min) & (fps < gate.fps_min * 1.1), "fps_close"),
    ]
    out = rows.withColumn("failures", F.array_compact(F.array(*failures))).withColumn("warnings", F.array_compact(F.array(*warnings)))
    return out.withColumn("passed", F.size("failures") == 0)


def gate_summary(checked: DataFrame) -> DataFrame:
    s = checked.agg(F.count("*").alias("total_scenarios"), F.count_if("passed").alias("passed_scenarios"), F.count_if(~F.col("passed")).alias("failed_scenarios"))
    text = F.concat(F.col("passed_scenarios").cast("string"), F.lit("/"), F.col("total_scenarios").cast("string"), F.lit(" scenarios passed"))
    return s.withColumns({"overall_passed": F.col("failed_scenarios") == 0, "summary": text})


def markdown_rows(checked: DataFrame, name: str = "session_id") -> DataFrame:
    """One Markdown table line per scenario."""
    def cell(c: str, digits: int, sign: bool = False) -> Column:
        shown = fixed(F.col(c), digits)
        if sign:
            shown = F.when(F.col(c) > 0, F.concat(F.lit("+"), shown)).otherwise(shown)
        return F.when(_truthy(c), shown).otherwise("N/A")

    status = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    cells = [F.col(name).cast("string"), status, cell("f1_score", 3), cell("f1_change", 3, True), cell("precision", 3), cell("recall", 3), cell("fps", 1)]
    return checked.select(name, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def verdict(change: Column, margin: float = 0.02) -> Column:
    return F.when(change > margin, "improved").when(change < -margin, "regression").otherwise("none")
