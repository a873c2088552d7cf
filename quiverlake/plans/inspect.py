"""What a query's physical plan does, for tests and for reading plans: exchanges, pushed filters, columns read, Python stages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_of(df: DataFrame) -> str:
    """The physical plan as text, before anything runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df: DataFrame) -> int:
    """Shuffles; broadcasts do not count."""
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?!SinglePartition)", plan_of(df)))


def pushed_filters(df: DataFrame) -> list[str]:
    """Filters that reach a scan."""
    return [f for found in re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(df)) for f in found.split(", ") if f]


def columns_read(df: DataFrame) -> list[set[str]]:
    """Columns of each scan."""
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$| )", plan_of(df))]


def python_stages(df: DataFrame) -> int:
    return len(re.findall(r"MapInArrow|MapInPandas|FlatMapGroupsIn|FlatMapCoGroupsIn|ArrowEvalPython|BatchEvalPython", plan_of(df)))
