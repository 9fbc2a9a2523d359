"""Vectors as rows of numpy arrays inside tasks: which take part, how they travel, and their numbers in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.sources.tables import materialise


def whole(vector: str) -> Column:
    """Whether a vector is there and has neither null nor non-finite components; an empty one is whole."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(~bad, F.lit(False))


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written to shared storage with a number of their own, ``row``: repeated rows and null ids stay apart."""
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), label)


def matrix(column: pd.Series, dim: int, kind: type) -> np.ndarray:
    """A column of arrays as a matrix of ``dim`` columns; shorter vectors end in zeros."""
    out = np.zeros((len(column), dim), kind)
    lengths = {len(v) for v in column}
    if len(lengths) == 1 and (n := lengths.pop()):
        out[:, :n] = np.stack(column.to_numpy())
        return out
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def packed(numbers: np.ndarray) -> list[bytes]:
    """Each row's bytes."""
    return [r.tobytes() for r in np.ascontiguousarray(numbers)]


def unpacked(column: pd.Series, dim: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), dim)


def dimension(rows: DataFrame, vector: str) -> int:
    """The length of the longest vector."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0
