"""All registered queries of the recommendation operators, with their DuckDB oracles."""

from __future__ import annotations

from . import codes, logs, metrics, texts

QUERIES: dict = logs.QUERIES | texts.QUERIES | codes.QUERIES | metrics.QUERIES
ORACLES: dict = logs.ORACLES | texts.ORACLES | codes.ORACLES | metrics.ORACLES
