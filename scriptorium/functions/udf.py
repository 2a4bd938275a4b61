"""Arrow UDFs that are made when they are first used: modules can be imported without a session, as on executors.

A batch of Spark's may be 64 MB of text, whose strings, trees and results take many times that as Python objects. So a function gets it
a slice at a time, and only Arrow's columns of the whole batch are held.
"""

from __future__ import annotations

import functools

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of a batch that are Python objects at once.
SLICE_BYTES = 1 << 20


def _column(found: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    if isinstance(found, pd.DataFrame):
        fields = [kind.field(i) for i in range(kind.num_fields)]
        return pa.StructArray.from_arrays([pa.array(found[x.name], x.type, from_pandas=True) for x in fields], fields=fields)
    return pa.array(found, kind, from_pandas=True)


def sliced(f, kind: pa.DataType):
    """A function of pandas columns as one of Arrow's, called for some rows at a time."""

    def run(*columns: pa.Array) -> pa.Array:
        n, size = len(columns[0]), sum(c.nbytes for c in columns)
        step = max(1, n * SLICE_BYTES // max(size, SLICE_BYTES))
        made = [_column(f(*(c.slice(i, step).to_pandas() for c in columns)), kind) for i in range(0, n, step)]
        return pa.concat_arrays(made) if made else pa.array([], kind)

    return run


def vectorised(returns: str):
    def wrap(f):
        @functools.wraps(f)
        def call(*cols):
            return F.arrow_udf(sliced(f, to_arrow_type(DataType.fromDDL(returns))), returns)(*cols)

        return call

    return wrap
