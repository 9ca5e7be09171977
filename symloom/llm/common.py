"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.shared import new_folder  # noqa: F401
from symloom.shared import written as materialise  # noqa: F401

#: ASCII white space, as a Java regular expression class; words are runs of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORDS)).cast("long")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that begin with ``names`` and that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{n}{mark}".lower() in taken for n in names):
        mark += "_"
    return [f"{n}{mark}" for n in names]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions in this block send at most so many rows at a time to Python: for tables with wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
