"""In-memory tables and reports."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from arborlake.functions.report import html_table, top
from arborlake.sources.frames import to_frame


def test_tables_in_memory(spark):
    assert to_frame(spark, np.ones((3, 2))).columns == ["x0", "x1"]
    odd = pd.DataFrame({"a": [1.0, np.nan], "b": pd.Categorical(["x", None]), "c": [1, "two"]})
    df = to_frame(spark, odd)
    assert df.filter("a IS NULL").count() == 1 and dict(df.dtypes) == {"a": "double", "b": "string", "c": "string"}
    assert to_frame(spark, pa.table({"a": [1]})).first().a == 1
    with pytest.raises(ValueError, match="two-dimensional"):
        to_frame(spark, np.ones(3))
    with pytest.raises(ValueError, match="unique"):
        to_frame(spark, pd.DataFrame([[1, 2]], columns=["a", "a"]))
    with pytest.raises(ValueError, match="match"):
        to_frame(spark, np.ones((1, 1)), ["y"])


def test_reports(spark):
    assert top(spark.createDataFrame([("a", 0.1), ("b", 0.9)], "feature string, importance double"), 1) == [("b", 0.9)]
    html = html_table(["model", "loss"], [["one", 0.12345], ["two", 0.12349], ["three", 0.2], ["four", None]], {"loss": "min"})
    assert html.count("<b>0.123</b>") == 2 and "<td>0.2</td>" in html
