"""Readers and writers for sessions, annotations, samples, analyses, logs and reports.

Readers never list files on the driver one by one: globs and recursive lookup are left to the
file source, and the session id comes out of ``_metadata.file_path``.  Nested documents that
would grow with a session are written in parts (``session_id``, ``part``), each covering a
fixed range of frames, so no session has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog import schemas
from emberlog.functions.text import frame_number
from emberlog.sources.buckets import load_rows, replace_rows

FRAMES_PER_PART = 4096


def _path_part(pattern: str):
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def read_frames(spark: SparkSession, root: str, decode: bool = True) -> DataFrame:
    """Frame images below ``root`` as (session_id, frame_index, image or content)."""
    fmt = "image" if decode else "binaryFile"
    df = spark.read.format(fmt).option("recursiveFileLookup", "true").option("pathGlobFilter", "frame_*.png").load(root)
    origin = F.col("image.origin") if decode else F.col("path")
    session = F.regexp_extract(origin, r"([^/]+)/(?:frames/)?frame_[0-9]+\.png$", 1)
    return df.select(session.alias("session_id"), frame_number(origin).alias("frame_index"), "image" if decode else "content")


def read_metadata(spark: SparkSession, root: str, sessions: DataFrame | None = None) -> DataFrame:
    """``metadata.json`` per session; sessions without a usable file keep NULLs."""
    df = (
        spark.read.schema(schemas.METADATA).option("multiLine", True).option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").json(root)
        .withColumn("session_id", _path_part(r"([^/]+)/metadata\.json$"))
    )
    return df if sessions is None else sessions.select("session_id").distinct().join(df, "session_id", "left")


def read_candidates(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Candidate arrays, one document per file, or one candidate per line."""
    df = spark.read.schema(schemas.CANDIDATE).option("multiLine", multi_line).json(path)
    return df.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def read_annotations(spark: SparkSession, root: str, pattern: str = "benchmark_*.json", multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(annotations, rejected): documents that do not parse are set aside with their path.
    Annotation tables written by this package hold one document per line."""
    raw = (
        spark.read.schema(schemas.ANNOTATION + ", _corrupt_record string").option("multiLine", multi_line).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .json(root).withColumn("path", F.col("_metadata.file_path"))
    )
    # The whole record is kept in the plan so that the corrupt column is filled.
    bad = F.col("_corrupt_record").isNotNull() | F.col("session_id").isNull()
    return raw.filter(~bad).drop("_corrupt_record"), raw.filter(bad).select("path", "_corrupt_record")


def annotation_hits(annotations: DataFrame) -> DataFrame:
    """One row per truth hit, with the format's defaults."""
    hit = annotations.select("session_id", F.inline_outer("hits"))
    return hit.na.fill({"width": 0, "height": 0, "damage_type": "direct", "notes": ""})


def nest_truth(truth: DataFrame, key: str = "session_id", part_frames: int = FRAMES_PER_PART) -> DataFrame:
    """Annotation documents: hits nested per session and part."""
    have = set(truth.columns)
    fill = {"width": F.lit(0), "height": F.lit(0), "damage_type": F.lit("direct"), "notes": F.lit("")}
    fields = [F.col(c).alias(c) if c in have else fill[c].alias(c) for c in ("frame", "value", "x", "y", "width", "height", "damage_type", "notes")]
    part = F.floor(F.col("frame") / part_frames).alias("part")
    return truth.groupBy(key, part).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("hits"), F.sum("value").alias("total_damage"), F.count("*").alias("hit_count"))


def write_annotations(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def nest_samples(samples: DataFrame, features: list[str]) -> DataFrame:
    return samples.select(F.struct(*features).alias("features"), "label")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SAMPLE).json(path).select("features.*", "label")


def read_analyses(spark: SparkSession, root: str) -> DataFrame:
    """Analysis summaries of all sessions; the session is three folders above the file."""
    df = spark.read.schema(schemas.SUMMARY).option("multiLine", True).json(f"{root}/*/analysis/combat-ocr/summary.json")
    return df.withColumn("session_id", _path_part(r"([^/]+)/analysis/combat-ocr/summary\.json$"))


def analysis_readings(analyses: DataFrame) -> DataFrame:
    return analyses.select("session_id", F.inline("results"))


def analysis_hits(analyses: DataFrame) -> DataFrame:
    """Stable hits of summaries as replay hits: frame falls back to the first frame, time to 0."""
    h = analyses.select("session_id", F.inline("stable_hits"))
    return h.select(
        "session_id", F.coalesce("frame_index", "first_frame", F.lit(0)).alias("frame_index"), F.coalesce("timestamp_ms", F.lit(0).cast("bigint")).alias("timestamp_ms"),
        "parsed_value", F.coalesce("best_confidence", F.lit(0.0)).alias("confidence"),
    )


def write_detection_log(log: DataFrame, path: str, key: str = "session_id") -> None:
    """True JSON lines, one row per frame, in session folders.

    The rows of a session are brought together first, so files grow in number with the sessions and not with sessions times
    tasks; a crowded session is split by its size into several files.
    """
    log.hint("rebalance", key).write.mode("append").partitionBy(key).json(path)


def read_detection_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_markdown(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def nest_frame_metrics(metrics: DataFrame, key: str = "session_id", part_frames: int = FRAMES_PER_PART) -> DataFrame:
    """Result documents whose per-frame map has string keys; a map covers one range of frames."""
    m = F.struct(
        F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"), F.lit(0).cast("bigint").alias("true_negatives"),
        "precision", "recall", "f1_score", "accuracy",
    )
    entry = F.struct(F.col("frame").cast("string").alias("key"), m.alias("value"))
    part = F.floor(F.col("frame") / part_frames).alias("part")
    return metrics.groupBy(key, part).agg(F.map_from_entries(F.collect_list(entry)).alias("per_frame_metrics"))


def unnest_frame_metrics(documents: DataFrame, key: str = "session_id") -> DataFrame:
    rows = documents.select(key, F.explode("per_frame_metrics").alias("frame", "m"))
    return rows.select(key, F.col("frame").cast("bigint").alias("frame"), "m.*")


def save_baselines(results: DataFrame, path: str) -> None:
    """Replaces the baselines of the given sessions only."""
    rows = results.select(F.col("session_id").cast("string").alias("session_id"), *[F.col(c).cast("double").alias(c) for c in ("f1_score", "precision", "recall", "fps")])
    replace_rows(rows, path, "session_id")


def load_baselines(spark: SparkSession, path: str) -> DataFrame:
    return load_rows(spark, path, schemas.BASELINE)


def unprocessed(sessions: DataFrame, processed: DataFrame, force: bool = False, key: str = "session_id") -> DataFrame:
    names = sessions.select(key).distinct()
    return names if force else names.join(processed.select(key).distinct(), key, "left_anti")


def inventory(frames: DataFrame, processed: DataFrame, key: str = "session_id", candidates_per_frame: float = 0.37, hits_per_frame: float = 0.10) -> DataFrame:
    """Frames, analysis flag and expected samples per session, with a grand-total row."""
    per = frames.groupBy(key).agg(F.count("*").alias("frames"))
    done = processed.select(key).distinct().withColumn("_done", F.lit(1))
    per = per.join(done, key, "left").select(
        key, "frames", F.coalesce("_done", F.lit(0)).alias("analysed"),
        (F.col("frames") * candidates_per_frame).cast("bigint").alias("estimated_candidates"), (F.col("frames") * hits_per_frame).cast("bigint").alias("estimated_hits"),
    )
    total = per.rollup(key).agg(*[F.sum(c).alias(c) for c in ("frames", "analysed", "estimated_candidates", "estimated_hits")], F.grouping(key).cast("int").alias("is_total"))
    return total
