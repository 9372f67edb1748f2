"""Functions on Arrow batches, made when they are used: a worker that imports a module has no session to parse types with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def on_series(kind: str):
    """Of a function of pandas Series, with their type hints, a function of columns."""

    def wrap(f):
        def column(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        column.on_series = f
        return column

    return wrap


def per_value(f, kind: str):
    """Of a function of one value, which gets nulls as None, a function of a column."""

    def each(x: pd.Series) -> pd.Series:
        return pd.Series([f(None if v is None or v is pd.NA else v) for v in x])

    each.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return on_series(kind)(each)
