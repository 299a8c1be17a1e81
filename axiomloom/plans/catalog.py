"""Importing the query modules fills the registry."""

from . import q_datasets, q_graph, q_learning, q_metrics, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
