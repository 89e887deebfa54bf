"""All registered queries, keyed by the operator ids of the survey."""

from emberlog.plans import catalog_eval, catalog_frames, catalog_learn, catalog_sequence, catalog_stats, catalog_stream, catalog_text  # noqa: F401
from emberlog.plans.registry import ORACLE, QUERIES  # noqa: F401
