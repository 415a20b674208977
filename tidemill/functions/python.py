"""Scalar, aggregate, grouped, cogrouped, batch and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def squash(value: pd.Series) -> pd.Series:
    """x / (1 + |x|)."""
    return value / (1 + value.abs())


@F.pandas_udf(T.DoubleType())
def spread(value: pd.Series) -> float:
    """Largest less smallest, of a group or window."""
    return float(value.max() - value.min())


@F.pandas_udf(T.DoubleType())
def lowest(value: pd.Series) -> float:
    return float(value.min())


@F.pandas_udf(T.DoubleType())
def highest(value: pd.Series) -> float:
    return float(value.max())


def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and largest value (columns low and high) of each key (first column) in each batch."""
    for batch in batches:
        key = batch.schema.names[0]
        got = pa.Table.from_batches([batch]).group_by(key).aggregate([("value", "min"), ("value", "max")]).select([key, "value_min", "value_max"])
        yield from got.rename_columns([key, "low", "high"]).to_batches()


def above_least(group: pd.DataFrame) -> pd.DataFrame:
    """Values of a group less their least."""
    return group.assign(value=group["value"] - group["value"].min())[["event_id", "user_id", "value"]]


def matched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """How many rows either side has for a key."""
    key = (left if len(left) else right)["user_id"].iloc[0]
    return pd.DataFrame({"user_id": [key], "n_left": [len(left)], "n_right": [len(right)]})


def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of positive value."""
    for batch in batches:
        yield batch.filter(pc.greater(batch.column("value"), 0))


@F.udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), T.StructField("letter", T.StringType())]))
class Letters:
    """Letters of a word, each with its place from 1."""

    def eval(self, word: str):
        for k, letter in enumerate(word or "", 1):
            yield k, letter
