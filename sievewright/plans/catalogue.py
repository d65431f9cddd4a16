"""The queries that this package registers, by name, with equivalent DuckDB SQL."""

from __future__ import annotations

from . import archives, curves, exchange, imaging, leakage, lookups, records, relations, resampling, scoring, selecting, streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _part in (archives, exchange, imaging, leakage, lookups, relations, records, scoring, resampling, curves, selecting, streams):
    QUERIES |= _part.REGISTER.queries
    ORACLE |= _part.REGISTER.oracle
