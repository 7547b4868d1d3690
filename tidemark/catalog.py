"""All queries of the engine over the driver's tables, with the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.suites import QUERIES, SQL, basics, calibrations, decisions, forecasts, resampling, sources, summaries, temporal, trailing

SUITES = (temporal, trailing, summaries, basics, forecasts, decisions, calibrations, resampling, sources)


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
