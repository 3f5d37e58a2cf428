"""Registered queries on the test tables, each with its SQL counterpart where one exists."""

from . import aggregation, learning, network, panel, relational, scalars, temporal, texts  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
