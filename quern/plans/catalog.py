"""Every registered query of the retrieval engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans.answering import ANSWERING
from quern.plans.evaluation import EVALUATION
from quern.plans.indexes import INDEXES
from quern.plans.layers import LAYERS
from quern.plans.operations import OPERATIONS
from quern.plans.search import SEARCH
from quern.plans.streams import STREAMS
from quern.plans.text import TEXT

_ALL = (TEXT, SEARCH, ANSWERING, EVALUATION, OPERATIONS, LAYERS, INDEXES, STREAMS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for catalog in _ALL for name, run in catalog.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for catalog in _ALL for name, sql in catalog.sql.items()}
