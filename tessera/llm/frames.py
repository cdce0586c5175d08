"""Column helpers for operators that pass their input's columns through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def set_aside(df: DataFrame, *replaced: str) -> tuple[list[Column], list[Column]]:
    """Selections that rename all columns but the ``replaced`` to ``in0``,
    ``in1``, ... and that name them back, so that no name of the input can
    clash with a working column."""
    gone = {c.lower() for c in replaced}
    names = [c for c in df.columns if c.lower() not in gone]
    return ([F.col(quoted(c)).alias(f"in{i}") for i, c in enumerate(names)],
            [F.col(f"in{i}").alias(c) for i, c in enumerate(names)])
