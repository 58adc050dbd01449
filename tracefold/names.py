"""Column names that meet no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever the case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def every(df: DataFrame) -> list[Column]:
    """All columns, also those with dots in their names."""
    return [df[f"`{x}`"] for x in df.columns]
