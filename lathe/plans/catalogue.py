"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from lathe.plans import combining, scoring, selection, statistics, training  # noqa: F401  they register their queries
from lathe.plans.util import ORACLES, QUERIES  # noqa: F401
