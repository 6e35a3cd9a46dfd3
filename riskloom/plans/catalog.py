"""Importing this module fills the registry."""

from riskloom.plans import queries_text, queries_inventory, queries_state, queries_streaming  # noqa: F401
from riskloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
