"""Groups that fail by themselves: a group whose function raises gives a row with its error while all others finish."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import kept

LONGEST = 500


def guarded(rows: DataFrame, by: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, kind: str = "bigint") -> DataFrame:
    """applyInPandas over groups of `by`, with two more columns.

    error: null, or in the one row of a group that raised, what it raised (all other columns but `by` are then null).
    seconds: what the group's function took in its worker, in the first of its rows; null in the others.
    A group without resulting rows gives one row of nulls too, so that its time is not lost.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        key, began = pdf[by].iloc[0], time.perf_counter()
        try:
            out, error = run(pdf), None
        except Exception as x:  # noqa: BLE001  # whatever it is, it is told
            out, error = pd.DataFrame(columns=names), f"{type(x).__name__}: {x}"[:LONGEST]
        took = time.perf_counter() - began
        if not len(out):
            return pd.DataFrame({by: [key], **{n: [None] for n in names if n != by}, "error": [error], "seconds": [took]})
        return out[names].assign(error=None, seconds=[took] + [None] * (len(out) - 1))

    full = schema if by in names else f"{by} {kind}, {schema}"
    return rows.groupBy(by).applyInPandas(one, f"{full}, error string, seconds double")


def split(t: DataFrame, name: str, filled: str) -> tuple[DataFrame, DataFrame]:
    """(rows without error, the errors) of a guarded table, which is computed once; `filled` is a column that no real row has null."""
    t = kept(t, name)
    return t.filter(F.col("error").isNull() & F.col(filled).isNotNull()).drop("error", "seconds"), t.filter("error is not null")
