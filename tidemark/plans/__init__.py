"""Registered queries, by domain."""

from tidemark.plans import events, find, metrics, ops, serving, streams, vault  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
