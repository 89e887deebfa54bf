"""Learning jobs (M rows).  Fitted models depend on the optimiser, so only M1 has SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import learn as ml
from emberlog.plans import adapters as ad
from emberlog.plans.catalog_text import READINGS_SQL, featured, scored_readings
from emberlog.plans.registry import query


def reading_boxes(spark, sf):
    r = scored_readings(spark, sf)
    return r.select(
        "session_id", "ordinal", F.col("text").alias("raw_text"), F.col("line_score").alias("score"), "parsed_value", "confidence", "is_plausible",
        F.lit(0).alias("left"), F.lit(0).alias("top"), F.col("width").alias("right"), F.col("height").alias("bottom"),
    )


@query(
    "m1_extract_samples",
    f"""SELECT session_id, ordinal, label, line_score, round(least(line_score / 12, 1), 6) AS fill_ratio, round(width / greatest(height, 1), 6) AS aspect_ratio, CAST(1 AS INTEGER) AS member_count, width, height,
        regexp_matches(text, '[0-9]') AS has_digit, regexp_matches(upper(text), '[KMB]') AS has_suffix, contains(text, '.') AS has_decimal, regexp_matches(text, '^[1-9]') AS starts_with_nonzero,
        CAST(length(text) AS INTEGER) AS text_length, val AS parsed_value, coalesce(val BETWEEN 100 AND 100000000, false) AS value_in_range, ok AS is_plausible
        FROM (SELECT *, CAST(CASE WHEN confidence >= 0.6e0 AND ok THEN 1 WHEN confidence < 0.3e0 OR NOT ok THEN 0 END AS INTEGER) AS label FROM {READINGS_SQL}) WHERE label IS NOT NULL""",
    ["texts"],
)
def _(spark, sf):
    out = ml.extract_samples(reading_boxes(spark, sf))
    return out.withColumns({"fill_ratio": F.round("fill_ratio", 6), "aspect_ratio": F.round("aspect_ratio", 6)})


def training_rows(spark, sf):
    return featured(ad.samples(spark, sf))


@query("m3_train")
def _(spark, sf):
    rows = training_rows(spark, sf)
    return ml.classifier_report(ml.predict(ml.train(rows), rows))


@query("m4_train_report")
def _(spark, sf):
    return ml.train_report(training_rows(spark, sf))[1]


@query("m5_choose_model")
def _(spark, sf):
    rows = training_rows(spark, sf).drop("raw_text", "pixel_count")
    read = scored_readings(spark, sf).filter(F.col("is_plausible") & (F.col("confidence") >= 0.6))
    collected = ml.collected_samples(read.select("text", F.col("parsed_value").alias("value"), "confidence"))
    extra = ml.negatives(rows.drop("ordinal")).unionByName(collected.select(*[c for c in rows.columns if c != "ordinal"]))
    both = rows.unionByName(extra.withColumn("ordinal", F.xxhash64(*extra.columns)))
    return ml.choose_model(both)[2]


@query("m6_feature_importance")
def _(spark, sf):
    return ml.feature_importance(ml.train(training_rows(spark, sf)), spark)


@query("m7_batch_scoring")
def _(spark, sf):
    rows = training_rows(spark, sf)
    return ml.predict(ml.train(rows), rows).select("ordinal", "label", F.round("hit_probability", 6).alias("hit_probability"), "decision")
