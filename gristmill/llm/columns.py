"""Columns of tables of any shape: names are compared as Spark does, in any case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def others(df: DataFrame, *new: str) -> list[str]:
    """The columns of df but those that a new column takes the name of, in any case."""
    taken = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in taken]


def private(df: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    """df's columns as c0, c1, ... and further ones by their names, so that no name of df can clash with one within."""
    return df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)), *(v.alias(k) for k, v in own.items()))


def public(columns: list[str]) -> list[Column]:
    """The columns of `private` by their own names again."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
