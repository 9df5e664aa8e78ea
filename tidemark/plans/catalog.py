"""Imports every query module, which fills the registry."""
from tidemark.plans import q_labels, q_lines, q_metrics, q_reports, q_scoring, q_sources, q_timeline  # noqa: F401
from tidemark.plans.registry import QUERIES  # noqa: F401
