"""What a plan looks like, for tests and for reading."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def pushed_filters(df: DataFrame) -> list[str]:
    """What the scans are asked to filter."""
    return [m.strip() for line in re.findall(r"PushedFilters: \[(.*?)\]\n", plan_text(df)) for m in line.split(", ") if m.strip()]


def operators(df: DataFrame) -> list[str]:
    """Names of the plan's operators, from the top."""
    return re.findall(r"^[\s:+*|-]*(?:\* )?([A-Z]\w+)", plan_text(df).split("\n\n")[0], re.MULTILINE)
