"""Tables that are in memory: pandas, NumPy and Arrow to DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def to_frame(spark: SparkSession, x, names: list[str] | None = None) -> DataFrame:
    """A DataFrame of a pandas, Arrow or two-dimensional NumPy table; NumPy columns are x0, x1 and so on.

    NaN in pandas is missing. Object columns that Arrow cannot type become texts. With names, the table's
    names have to be these, in this order.
    """
    if isinstance(x, DataFrame):
        out = x
    elif isinstance(x, (pa.Table, pa.RecordBatch)):
        out = spark.createDataFrame(x if isinstance(x, pa.Table) else pa.Table.from_batches([x]))
    else:
        if isinstance(x, np.ndarray):
            if x.ndim != 2:
                raise ValueError("X must be two-dimensional")
            x = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])])
        x = x.copy()
        x.columns = [str(c) for c in x.columns]
        if len(set(x.columns)) != len(x.columns):
            raise ValueError("feature names must be unique")
        for c in x.columns:
            if isinstance(x[c].dtype, pd.CategoricalDtype):
                x[c] = x[c].astype(object)
            if x[c].dtype == object:
                try:
                    pa.array(x[c], from_pandas=True)
                except (pa.ArrowInvalid, pa.ArrowTypeError):
                    x[c] = x[c].map(lambda v: None if v is None or v != v else str(v))
        out = spark.createDataFrame(pa.Table.from_pandas(x, preserve_index=False))
    if names is not None and out.columns != list(names):
        raise ValueError(f"feature names should match those seen during fit: {list(names)}")
    return out
