"""Registered queries: one module per operator family, each query with its DuckDB counterpart where SQL can say it."""

from queries import aggregation, charts, cleaning, joining, modelling, profiling, reading, statistics, texts, timeseries, typing_  # noqa: F401
from queries.base import ORACLES, QUERIES  # noqa: F401
