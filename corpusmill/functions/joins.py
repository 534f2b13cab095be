"""Joins of tables that both grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left.join(right, on, how), with both sides dealt by key and sorted: neither is gathered and broadcast by the driver.

    For sides with a row or more per case or text. Spark takes the bytes of a file for the size of its rows, so a
    table that repeats itself, and all that is exploded from one, looks small enough to broadcast at any number of rows.
    """
    return left.join(right.hint("merge"), on, how)
