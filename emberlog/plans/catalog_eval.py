"""Evaluation, gate, and the nested file formats (E, J6, J9, A23, A24, S rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog import schemas
from emberlog.operators import evaluate as ev, matching as mt, sequence as sq, stats as st
from emberlog.functions import scoring as sc
from emberlog.plans import adapters as ad
from emberlog.plans.catalog_sequence import ACC_SQL, MATCH_SQL, STABLE_SQL, _FRAME_DET, _FRAME_TRUTH, counts_sql, match_sql
from emberlog.plans.catalog_stats import RATES_SQL
from emberlog.plans.catalog_text import FEATURES_SQL, featured
from emberlog.plans.registry import ORACLE, query
from emberlog.session import work_folder
from emberlog.sources import io

# --- before / after -------------------------------------------------------------------------


def side(spark, sf, run):
    return st.with_rates(ad.runs(spark, sf).filter(F.col("run") == run)).drop("run")


_RUN = f"(SELECT session_id, tp, fp, fn, fps, {RATES_SQL} FROM runs WHERE run = '{{}}')"


@query(
    "j6_against_baseline",
    f"""SELECT a.session_id, a.f1_score, b.f1_score AS baseline_f1_score, b.precision AS baseline_precision, b.recall AS baseline_recall,
        round(CASE WHEN a.f1_score <> 0 AND b.f1_score <> 0 THEN a.f1_score - b.f1_score END, 6) AS f1_change
        FROM {_RUN.format('O')} a LEFT JOIN (SELECT * FROM {_RUN.format('F')} WHERE session_id % 5 <> 0) b USING (session_id)""",
    ["runs"],
)
def _(spark, sf):
    out = ev.against_baseline(side(spark, sf, "O"), side(spark, sf, "F").filter("session_id % 5 <> 0"))
    return out.select("session_id", "f1_score", "baseline_f1_score", "baseline_precision", "baseline_recall", F.round("f1_change", 6).alias("f1_change"))


@query(
    "j9_compare_runs",
    f"""SELECT session_id, metric, before, after, round(after - before, 6) AS delta, CASE WHEN before <> 0 THEN round((after - before) / before * 100, 6) WHEN after = 0 THEN 0 ELSE 'infinity'::DOUBLE END AS percent_change FROM (
        SELECT b.session_id, unnest(['precision', 'recall', 'f1_score', 'fps']) AS metric, unnest([b.precision, b.recall, b.f1_score, b.fps]) AS before, unnest([a.precision, a.recall, a.f1_score, a.fps]) AS after
        FROM {_RUN.format('F')} b JOIN {_RUN.format('O')} a USING (session_id))""",
    ["runs"],
)
def _(spark, sf):
    return ev.compare_runs(side(spark, sf, "F"), side(spark, sf, "O"))


GATE = ev.Gate(fps_min=18.0)
CHECKED_SQL = f"""(SELECT *, len(failures) = 0 AS passed FROM (SELECT *, list_filter([CASE WHEN f1_score < 0.7 THEN 'f1_min' END, CASE WHEN f1_change < -0.05 THEN 'f1_drop' END,
    CASE WHEN precision < 0.7 THEN 'precision_min' END, CASE WHEN recall < 0.7 THEN 'recall_min' END, CASE WHEN fps < 18 THEN 'fps_min' END], lambda x: x IS NOT NULL) AS failures,
    list_filter([CASE WHEN f1_change < 0 AND f1_change >= -0.05 THEN 'f1_decreased' END, CASE WHEN fps >= 18 AND fps < 19.8e0 THEN 'fps_close' END], lambda x: x IS NOT NULL) AS warnings
    FROM (SELECT a.session_id, a.f1_score, a.precision, a.recall, a.fps, CASE WHEN a.f1_score <> 0 AND b.f1_score <> 0 THEN a.f1_score - b.f1_score END AS f1_change
    FROM {_RUN.format('O')} a LEFT JOIN (SELECT * FROM {_RUN.format('F')} WHERE session_id % 5 <> 0) b USING (session_id))))"""


def checked(spark, sf):
    base = side(spark, sf, "F").filter("session_id % 5 <> 0")
    return ev.check_gate(ev.against_baseline(side(spark, sf, "O"), base), GATE)


@query(
    "e3_check_gate",
    f"SELECT session_id, passed, array_to_string(failures, ',') AS failures, array_to_string(warnings, ',') AS warnings FROM {CHECKED_SQL}",
    ["runs"],
)
def _(spark, sf):
    return checked(spark, sf).select("session_id", "passed", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"))


@query(
    "a23_gate_summary",
    f"""SELECT count(*) AS total_scenarios, count(*) FILTER (passed) AS passed_scenarios, count(*) FILTER (NOT passed) AS failed_scenarios, count(*) FILTER (NOT passed) = 0 AS overall_passed,
        concat(count(*) FILTER (passed), '/', count(*), ' scenarios passed') AS summary FROM {CHECKED_SQL}""",
    ["runs"],
)
def _(spark, sf):
    return ev.gate_summary(checked(spark, sf))


@query(
    "s10_e4_report_lines",
    f"""SELECT session_id, concat('| ', session_id, ' | ', CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END, ' | ', CASE WHEN f1_score <> 0 THEN printf('%.3f', f1_score) ELSE 'N/A' END, ' | ',
        CASE WHEN f1_change <> 0 THEN CASE WHEN f1_change > 0 THEN '+' ELSE '' END || printf('%.3f', f1_change) ELSE 'N/A' END, ' | ', CASE WHEN precision <> 0 THEN printf('%.3f', precision) ELSE 'N/A' END, ' | ',
        CASE WHEN recall <> 0 THEN printf('%.3f', recall) ELSE 'N/A' END, ' | ', CASE WHEN fps <> 0 THEN printf('%.1f', fps) ELSE 'N/A' END, ' |') AS line FROM {CHECKED_SQL}""",
    ["runs"],
)
def _(spark, sf):
    return ev.markdown_rows(checked(spark, sf))


@query(
    "e5_verdict",
    f"SELECT session_id, CASE WHEN f1_change > 0.02 THEN 'improved' WHEN f1_change < -0.02 THEN 'regression' ELSE 'none' END AS verdict FROM {CHECKED_SQL}",
    ["runs"],
)
def _(spark, sf):
    return checked(spark, sf).select("session_id", ev.verdict(F.col("f1_change")).alias("verdict"))


_FRAMES_SQL = """(SELECT c_custkey // 8 AS session_id, count(*) FILTER (c_mktsegment <> 'BUILDING') * 90 AS total_frames, count(*) FILTER (c_mktsegment <> 'BUILDING') * 3000 + c_custkey // 8 % 7 AS processing_ms
    FROM customer GROUP BY 1, c_custkey // 8)"""
_BENCH_SQL = f"""(SELECT s.session_id, total_frames, processing_ms, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM {_FRAMES_SQL} s
    LEFT JOIN {counts_sql(MATCH_SQL, 'truth', 'session_id')} c USING (session_id))"""


def benchmark(spark, sf):
    """Frames per session from ``customer``: some sessions have frames but no detections, some have neither."""
    seen = F.count_if(F.col("c_mktsegment") != "BUILDING")
    frames = ad.table(spark, sf, "customer").groupBy(F.expr("c_custkey div 8").alias("session_id")).agg((seen * 90).alias("total_frames"), (seen * 3000).alias("_ms"))
    return ev.run_benchmark(ad.detections(spark, sf), ad.truth(spark, sf), frames.withColumn("processing_ms", F.col("_ms") + F.col("session_id") % 7))


@query(
    "e1_e2_run_benchmark",
    f"""SELECT session_id, total_frames, tp, fp, fn, {RATES_SQL}, {ACC_SQL}, tp + fn AS total_truth, tp + fp AS total_detected,
        coalesce(round(CASE WHEN processing_ms > 0 THEN total_frames * 1000 / processing_ms END, 6), 0) AS fps_processed, CASE WHEN total_frames = 0 THEN 'No frame images found' END AS error FROM {_BENCH_SQL}""",
    ["detections", "truth"],
)
def _(spark, sf):
    return benchmark(spark, sf)


@query(
    "a24_average_rates",
    f"SELECT count(*) AS benchmarks, round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall, round(avg(f1_score), 6) AS avg_f1_score FROM (SELECT {RATES_SQL} FROM {_BENCH_SQL})",
    ["detections", "truth"],
)
def _(spark, sf):
    return ev.average_rates(benchmark(spark, sf))


# --- nested formats ---------------------------------------------------------------------------


@query(
    "s6_annotation_roundtrip",
    """SELECT session_id, frame, value, x, y, CAST(0 AS INTEGER) AS width, CAST(0 AS INTEGER) AS height, 'direct' AS damage_type, '' AS notes FROM truth""",
    ["truth"],
)
def _(spark, sf):
    docs = io.nest_truth(ad.truth(spark, sf)).select("session_id", F.to_json("hits").alias("doc"))
    back = docs.select("session_id", F.from_json("doc", f"array<struct<{schemas.TRUTH_HIT}>>").alias("hits"))
    return io.annotation_hits(back)


@query(
    "s7_sample_roundtrip",
    f"""SELECT round(line_score, 6) AS line_score, round(fill_ratio, 6) AS fill_ratio, round(aspect_ratio, 6) AS aspect_ratio, member_count, width, height, has_digit, has_suffix, has_decimal, starts_with_nonzero, text_length, parsed_value, value_in_range, is_plausible, label FROM {FEATURES_SQL}""",
    ["samples"],
)
def _(spark, sf):
    docs = io.nest_samples(featured(ad.samples(spark, sf)), sc.FEATURES).select(F.to_json(F.struct("features", "label")).alias("doc"))
    back = docs.select(F.from_json("doc", schemas.SAMPLE).alias("d")).select("d.features.*", "d.label")
    return back.withColumns({c: F.round(c, 6) for c in ("line_score", "fill_ratio", "aspect_ratio")})


@query(
    "s11_result_roundtrip",
    f"""SELECT session_id, frame, tp AS true_positives, fp AS false_positives, fn AS false_negatives, CAST(0 AS BIGINT) AS true_negatives, {RATES_SQL}, {ACC_SQL}
        FROM {counts_sql(match_sql(_FRAME_DET, _FRAME_TRUTH, 'session_id, frame', 0), _FRAME_TRUTH, 'session_id, frame')}""",
    ["detections", "truth"],
)
def _(spark, sf):
    metrics = mt.frame_metrics(ad.detections(spark, sf), ad.truth(spark, sf))
    docs = io.nest_frame_metrics(metrics, part_frames=256).select(F.to_json(F.struct("session_id", "part", "per_frame_metrics")).alias("doc"))
    back = docs.select(F.from_json("doc", schemas.RESULT).alias("d")).select("d.*")
    return io.unnest_frame_metrics(back)


@query(
    "s12_baseline_lookup",
    f"SELECT a.session_id, b.f1_score AS baseline_f1_score, b.f1_score IS NULL AS is_new FROM {_RUN.format('O')} a LEFT JOIN (SELECT * FROM {_RUN.format('F')} WHERE session_id % 5 <> 0) b USING (session_id)",
    ["runs"],
)
def _(spark, sf):
    out = ev.against_baseline(side(spark, sf, "O"), side(spark, sf, "F").filter("session_id % 5 <> 0"))
    return out.select("session_id", "baseline_f1_score", F.col("baseline_f1_score").isNull().alias("is_new"))


@query("s12_baseline_files", ORACLE["s12_baseline_lookup"], [])
def _(spark, sf):
    """Baselines saved in two steps, the second of which replaces some, and loaded again."""
    path = work_folder(spark, "s12")
    known = side(spark, sf, "F").filter("session_id % 5 <> 0")
    io.save_baselines(known.withColumn("f1_score", F.lit(0.0)), path)
    io.save_baselines(known, path)
    saved = io.load_baselines(spark, path).withColumn("session_id", F.col("session_id").cast("bigint"))
    out = ev.against_baseline(side(spark, sf, "O"), saved)
    return out.select("session_id", "baseline_f1_score", F.col("baseline_f1_score").isNull().alias("is_new"))


@query(
    "s13_unprocessed",
    "SELECT DISTINCT c_custkey // 8 AS session_id FROM customer WHERE c_custkey // 8 NOT IN (SELECT session_id FROM hits)",
    ["hits"],
)
def _(spark, sf):
    sessions = ad.table(spark, sf, "customer").select(F.expr("c_custkey div 8").alias("session_id"))
    return io.unprocessed(sessions, ad.hits(spark, sf))


@query(
    "s15_inventory",
    """WITH p AS (SELECT session_id, count(*) AS frames, CASE WHEN session_id IN (SELECT DISTINCT session_id FROM hits WHERE parsed_value >= 14000) THEN 1 ELSE 0 END AS analysed,
       CAST(trunc(count(*) * 0.37e0) AS BIGINT) AS c, CAST(trunc(count(*) * 0.1e0) AS BIGINT) AS h FROM (SELECT DISTINCT session_id, frame_index FROM hits) GROUP BY 1)
       SELECT session_id, frames, CAST(analysed AS BIGINT) AS analysed, c AS estimated_candidates, h AS estimated_hits, 0 AS is_total FROM p UNION ALL
       SELECT NULL, CAST(sum(frames) AS BIGINT), CAST(sum(analysed) AS BIGINT), CAST(sum(c) AS BIGINT), CAST(sum(h) AS BIGINT), 1 FROM p""",
    ["hits"],
)
def _(spark, sf):
    h = ad.hits(spark, sf)
    return io.inventory(h.select("session_id", "frame_index").distinct(), h.filter("parsed_value >= 14000"))


@query(
    "s16_summary_hits",
    """SELECT session_id, CAST(coalesce(CASE WHEN ordinal % 3 <> 0 THEN frame_index END, frame_index - 1) AS INTEGER) AS frame_index, coalesce(CASE WHEN ordinal % 4 <> 0 THEN timestamp_ms END, 0) AS timestamp_ms,
       parsed_value, confidence FROM hits""",
    ["hits"],
)
def _(spark, sf):
    h = ad.hits(spark, sf)
    item = F.struct(
        F.when(F.col("ordinal") % 3 != 0, F.col("frame_index")).alias("frame_index"), (F.col("frame_index") - 1).alias("first_frame"),
        F.when(F.col("ordinal") % 4 != 0, F.col("timestamp_ms")).alias("timestamp_ms"), "parsed_value", F.col("confidence").alias("best_confidence"),
    )
    docs = h.groupBy("session_id", F.floor(F.col("frame_index") / 64).alias("part")).agg(F.collect_list(item).alias("stable_hits"))
    return io.analysis_hits(docs)


@query(
    "m2_pseudo_truth",
    f"SELECT session_id, first_frame AS frame, parsed_value AS value, center_x AS x, center_y AS y, 'direct' AS damage_type FROM {STABLE_SQL}",
    ["hits"],
)
def _(spark, sf):
    from emberlog.operators.learn import pseudo_truth

    return pseudo_truth(sq.stable_hits(ad.hits(spark, sf)))
