"""Registered queries over the driver tables, each with its DuckDB twin where SQL can say it."""

from playtape.workloads import backtesting, boxes, core, feeds, fitting, joins, modelling, text_flags  # noqa: F401
from playtape.workloads.base import REGISTRY

__all__ = ["REGISTRY"]
