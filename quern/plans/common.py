"""How a registered query is kept: its function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Catalog:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None):
        """Register the decorated function under its name."""

        def keep(function):
            self.queries[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = sql
            return function

        return keep


#: Tables whose rows are worth spreading: long texts in few files.
TEXTS = {"documents", "conversations", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's scan. A text table in fewer splits than there are cores is spread over the cores; at scale this never applies."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def rounded(column: Column | str, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


# SQL pieces that several statements share
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def tokens_sql(text: str) -> str:
    return TOKENS.format(text)


def token_set_sql(text: str) -> str:
    return f"list_distinct({TOKENS.format(text)})"


def coverage_sql(of: str, by: str) -> str:
    """Share of the first text's distinct tokens that the second has; 0 without tokens."""
    return f"coalesce(len(list_intersect({token_set_sql(of)}, {token_set_sql(by)}))::DOUBLE / nullif(len({token_set_sql(of)}), 0), 0)"
