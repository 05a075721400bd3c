"""Every query of the library with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import aggregates, evidence, graphs, harness, joins, mapping, metrics, models, packs, ranking, reports, scans, sequences, splits, statistics  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
