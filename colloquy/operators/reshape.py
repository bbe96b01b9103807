"""Reshaping: wide and long tables, nested records, checked lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivoted(rows: DataFrame, keys: list[str], column: str, values: list[str], measure: Callable[[], Column]) -> DataFrame:
    """One column for each of the given values; 0 where a group has none.  The values are named, so none are collected."""
    return rows.groupBy(*keys).pivot(column, values).agg(measure()).fillna(0, values)


def stacked(wide: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """The long form of a wide table."""
    return wide.unpivot(keys, columns, name, value)


def nested(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows grouped back under their parent as ``records``, an array of structs ordered by the fields in turn."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("records"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def asserted_lookup(rows: DataFrame, entries: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A left join whose value must be found: the first row without one ends the query with an error."""
    message = F.concat(F.lit(f"no {value} for "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    return rows.join(entries, keys, "left").withColumn(value, F.when(F.col(value).isNull(), F.raise_error(message)).otherwise(F.col(value)))
