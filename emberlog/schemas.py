"""Schemas of the file formats (DDL strings)."""

METADATA = "session_name string, fps double, status string, frames_written int, started_at_epoch_s double"
CANDIDATE = "text string, frame int, timestamp_ms bigint, confidence double"
TRUTH_HIT = "frame:int, value:bigint, x:double, y:double, width:int, height:int, damage_type:string, notes:string"
ANNOTATION = (
    "session_id string, session_name string, description string, resolution string, ui_scale double, total_frames int, fps double, "
    f"hits array<struct<{TRUTH_HIT}>>, metadata map<string,string>"
)
FEATURES = (
    "line_score:double, fill_ratio:double, aspect_ratio:double, member_count:int, width:int, height:int, has_digit:boolean, has_suffix:boolean, "
    "has_decimal:boolean, starts_with_nonzero:boolean, text_length:int, parsed_value:bigint, value_in_range:boolean, is_plausible:boolean"
)
SAMPLE = f"features struct<{FEATURES}>, label int"
READING = (
    "frame_name string, frame_index int, mask_name string, raw_text string, normalized_text string, parsed_value bigint, score double, "
    "confidence double, is_confident boolean, is_plausible boolean, left int, top int, right int, bottom int"
)
STABLE_HIT = (
    "frame_index int, timestamp_ms bigint, parsed_value bigint, first_frame int, last_frame int, occurrences int, best_confidence double, "
    "sample_text string, center_x double, center_y double"
)


def _nested(ddl: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (part.strip().split(" ", 1) for part in ddl.split(", ")))


SUMMARY = (
    f"metadata struct<{_nested(METADATA)}>, candidate_count bigint, recognized_count bigint, parsed_count bigint, confident_count bigint, "
    f"results array<struct<{_nested(READING)}>>, stable_hits array<struct<{_nested(STABLE_HIT)}>>"
)
METRICS = "true_positives:bigint, false_positives:bigint, false_negatives:bigint, true_negatives:bigint, precision:double, recall:double, f1_score:double, accuracy:double"
RESULT = f"session_id bigint, part bigint, per_frame_metrics map<string,struct<{METRICS}>>"
BASELINE = "session_id string, f1_score double, precision double, recall double, fps double"
LIVE_HIT = "session_id bigint, frame_index int, timestamp_ms bigint, ordinal bigint, parsed_value bigint, confidence double, center_x double, center_y double, started_at_ms bigint"
