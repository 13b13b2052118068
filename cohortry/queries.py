"""All queries of the library but those of subpackage llm."""

from .plans import q_clinical, q_cohort, q_frames, q_more, q_reports, q_search, q_text  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
