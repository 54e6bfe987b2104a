"""Adds a struct column that a Python function computes from one column, in Arrow batches."""

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship


def with_struct(df: DataFrame, column: str, into: str, schema: T.DataType, f: Callable[[Any], Any]) -> DataFrame:
    """df with the column ``into``: f of the column's value. Only that column goes to Python, all others stay in the JVM."""
    ship(df.sparkSession)
    kind = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([f(x) for x in batch.to_pylist()], type=kind)

    return df.withColumn(into, run.asNondeterministic()(F.col(column)))  # else filters on it would be pushed down and run it twice


def with_batch(df: DataFrame, column: str, into: str, schema: T.DataType, f: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """As with_struct, but f gets the column's values of a whole batch as an Arrow array and returns as many."""
    ship(df.sparkSession)

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield f(batch)

    return df.withColumn(into, run.asNondeterministic()(F.col(column)))
