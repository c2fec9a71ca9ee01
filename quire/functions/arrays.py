"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; in a lambda it would be once per use."""
    return F.transform(F.array(value), body)[0]


def literal_map(values: Mapping[str, str]) -> Column:
    """A constant map; without entries a map of none."""
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def among(value: Column, texts: Iterable[str]) -> Column:
    return value.isin([*texts])


def first_occurrences(values: Column) -> Column:
    """Distinct values in the order of their first place; blank ones are left out."""
    return F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""))
