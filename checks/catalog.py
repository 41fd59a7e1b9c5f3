"""All registered queries."""

from checks import q_logs, q_measure, q_model, q_prepare, q_stream  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
