"""Turning computed arrays into rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many documents or pairs are Python objects at a time.
AT_ONCE = 8


def row_by_row(work: Callable[..., Any], made: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What ``work`` makes of each row of an Arrow batch. A batch may hold tens of megabytes of text, and as Python objects
    several times as much: only a few rows are such at a time."""
    starts = range(0, len(columns[0]), AT_ONCE)
    parts = [pa.array([work(*row) for row in zip(*[c.slice(at, AT_ONCE).to_pylist() for c in columns])], type=made) for at in starts]
    return pa.concat_arrays(parts) if parts else pa.array([], type=made)


def element_rows(df: DataFrame, keep: Sequence[str | Column], array: Column, *, pos: str = "_pos", item: str = "_item") -> DataFrame:
    """One row per element with its position.

    A plain generator makes the optimizer infer ``size(array) > 0`` and push it
    down, so that a costly array is computed once more below, at worst inside
    the scan's few tasks. The outer form has no such filter; the rows of empty
    arrays are dropped by their missing position.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def struct_rows(df: DataFrame, keep: Sequence[str | Column], array: Column) -> DataFrame:
    """One row per struct of the array, its fields as columns."""
    rows = element_rows(df, keep, array)
    kept = [c for c in rows.columns if c not in ("_pos", "_item")]
    return rows.select(*kept, "_item.*")


def left_join_present(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join whose rows without a key stay out of the exchange: they match
    nothing and would all meet in one task."""
    joined = left.where(F.col(key).isNotNull()).join(right, key, "left").select(*left.columns, *[c for c in right.columns if c != key])
    return joined.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
