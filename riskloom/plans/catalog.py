"""All registered queries (importing the modules fills the registry)."""

from . import q_eval, q_monitor, q_sampling, q_sft, q_tables, q_text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
