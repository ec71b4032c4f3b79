"""Turning an array into rows without computing the array twice.

The optimizer guards a plain explode with a filter on the size of its array and pushes that filter
down, which repeats whatever expression makes the array. The outer forms carry no such guard, so an
expensive array is exploded with them and the empty rows are dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, array: Column | str, name: str, *keep) -> DataFrame:
    """``keep`` columns plus one row per non-null element."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, array: Column | str, place: str, name: str, *keep) -> DataFrame:
    """``keep`` columns plus one row per element, with its position."""
    return df.select(*keep, F.posexplode_outer(array).alias(place, name)).where(
        F.col(place).isNotNull()
    )


def settled(df: DataFrame, *columns) -> DataFrame:
    """These columns, computed once per row: later filters do not repeat their expressions.

    A filter on a computed column is pushed below the projection that computes it, with a copy of the
    expression for every mention; it is not pushed below a generator.
    """
    return df.select(F.inline_outer(F.array(F.struct(*columns))))


def inline_rows(df: DataFrame, array: Column | str, *keep) -> DataFrame:
    """``keep`` columns plus the fields of each struct; structs are never null."""
    return explode_rows(df, array, "_row", *keep).select(
        *[c for c in keep], "_row.*"
    )
