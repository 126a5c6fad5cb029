"""Read physical plans the way a user does: from ``explain`` output."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

# Plan nodes that mean per-row Python or pairwise row production.
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")
PAIRWISE_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def plan_nodes(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    text = plan_text(df, "simple")
    return [n for n in names if n in text]


def read_schemas(df: DataFrame) -> list[str]:
    """The ReadSchema of every file scan in the plan."""
    return re.findall(r"ReadSchema: (struct<[^>]*>)", plan_text(df, "simple"))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(df, "simple"))
