"""Reading, writing, converting and viewing tables; fitting and predicting from file to file."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.sampling import bernoulli, sample_rows
from arborlake.functions.scalars import significant
from arborlake.operators.forest import ForestClassifier, ForestModel, ForestRegressor

FORMATS = {".csv": "csv", ".parquet": "parquet", ".orc": "orc", ".json": "json", ".arrow": "arrow", ".feather": "arrow"}


def format_of(path: str) -> str:
    """The format that a path's ending names; CSV where it names none."""
    return next((f for end, f in FORMATS.items() if path.rstrip("/").lower().endswith(end)), "csv")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Names in a CSV file's first line; ValueError for empty and repeated ones, which readers rename silently."""
    line = spark.read.text(path).limit(1).first()
    names = next(csv.reader([line[0]])) if line else []
    if not names or any(not n for n in names) or len(set(names)) != len(names):
        raise ValueError("CSV headers must be non-empty and unique")
    return names


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table by its path's ending. CSV columns are texts; empty ones are null. Columns are found by name."""
    kind = format_of(path)
    if kind == "csv":
        csv_header(spark, path)
        df = spark.read.option("header", True).csv(path)
    elif kind == "arrow":
        import pyarrow.feather

        df = spark.createDataFrame(pyarrow.feather.read_table(path))
    else:
        df = spark.read.format(kind).load(path)
    if columns is None:
        return df
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def write_table(df: DataFrame, path: str) -> None:
    """Writes by the path's ending. Arrow files are single ones, for small tables; the others are folders."""
    kind = format_of(path)
    if kind == "arrow":
        import pyarrow.feather

        pyarrow.feather.write_feather(df.toArrow(), path)
        return
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path))


def numeric_types(df: DataFrame) -> DataFrame:
    """(column, type, bad): bigint where all values are, else double; bad counts values that are not finite numbers.

    One pass for all columns; empty values are null.
    """
    from arborlake.functions.scalars import parsed_number

    parts = []
    for c in df.columns:
        text = F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
        whole = text.isNull() | (text.rlike(r"^[+-]?[0-9]+$") & text.try_cast("bigint").isNotNull())
        bad = text.isNotNull() & F.coalesce(~(F.abs(parsed_number(text)) < float("inf")), F.lit(True))
        parts.append(F.struct(F.lit(c).alias("column"), F.when(F.bool_and(whole), "bigint").otherwise("double").alias("type"), F.sum(bad.cast("long")).alias("bad")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def convert_csv(spark: SparkSession, source: str, target: str) -> None:
    """A numeric CSV file to a typed table; ValueError for values that are not finite numbers."""
    df = read_table(spark, source)
    types = numeric_types(df).collect()
    if bad := [r["column"] for r in types if r["bad"]]:
        raise ValueError(f"column {bad[0]!r} has a nonnumeric or non-finite value")
    write_table(df.select(*(F.when(F.col(f"`{r['column']}`") != "", F.col(f"`{r['column']}`")).cast(r["type"]).alias(r["column"]) for r in types)), target)


def view_csv(spark: SparkSession, path: str, columns: list[str] | None = None, *, rows: int | None = None, start: int = 0, end: int | None = None, sample: str | None = None, seed: int = 0) -> str:
    """A compact view: varying columns as CSV with short numbers, then constants.

    sample is a row count or a percentage. What is shown comes to the driver, so a large file needs rows,
    start and end, or sample.
    """
    if rows == 0:
        raise ValueError("rows must be positive")
    if rows and sample:
        raise ValueError("rows and sample cannot be used together")
    if sample and (start or end is not None):
        raise ValueError("start and end cannot be used with sample")
    if end is not None and end <= start:
        raise ValueError("end must be greater than start")
    names = csv_header(spark, path)
    if unknown := [c for c in columns or [] if c not in names]:
        raise ValueError(f"unknown column {unknown[0]!r}")
    df = spark.read.option("header", True).option("nullValue", "\0").option("emptyValue", "").csv(path).select(*(columns or names)).na.fill("")
    total = df.count()
    if not total:
        raise ValueError("CSV contains no data rows")
    placed = df.withColumn("_at", F.monotonically_increasing_id())  # file order within one read
    if sample:
        if sample.endswith("%"):
            share = float(sample[:-1])
            if not 0 < share <= 100:
                raise ValueError("sample percentage must be in (0, 100]")
            found = bernoulli(placed, share / 100, seed, "view", "_at").orderBy("_at").collect()
            head = f"{len(found)} rows sampled at {significant(share, 4)}% from {total}\n"
        else:
            if int(sample) < 1:
                raise ValueError("sample row count must be positive")
            found = sample_rows(placed, int(sample), seed, "view", "_at").orderBy("_at").collect()
            head = f"{len(found)} randomly sampled rows from {total}\n"
    else:
        until = min(x for x in (end, start + rows if rows else None, total) if x is not None)
        found = placed.orderBy("_at").offset(start).limit(max(0, until - start)).collect()
        head = f"rows {start}..{start + len(found)} from {total}\n" if start or end is not None else f"first {len(found)} rows from {total}\n" if rows else ""
    return head + shown([r[:-1] for r in found], columns or names)


def shown(rows: list[tuple], names: list[str]) -> str:
    kinds = [kind([r[i] for r in rows]) for i in range(len(names))]
    constant = [i for i in range(len(names)) if rows and all(r[i] == rows[0][i] for r in rows)]
    varying = [i for i in range(len(names)) if i not in constant]
    out = io.StringIO()
    if varying:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow([names[i] for i in varying])
        writer.writerows([shortened(names[i], r[i], kinds[i]) for i in varying] for r in rows)
    else:
        out.write("No varying columns\n")
    if constant:
        out.write("Constants:\n" + "".join(f"{names[i]}={shortened(names[i], rows[0][i], kinds[i])}\n" for i in constant))
    return out.getvalue()


def _whole(v: str) -> bool:
    return v.lstrip("+-").isdigit() and v.isascii() and -(2**63) <= int(v) < 2**63


def _finite(v: str) -> bool:
    try:
        return abs(float(v)) < float("inf") and v == v.strip() and "_" not in v
    except ValueError:
        return False


def kind(values: list[str]) -> str:
    """integer, float or text: what all values that are not empty are."""
    some = [v for v in values if v]
    return "integer" if all(map(_whole, some)) else "float" if all(map(_finite, some)) else "text"


def shortened(name: str, value: str, of: str) -> str:
    if of == "integer" and value:
        return str(int(value))
    if of == "float" and value:
        return significant(float(value), 3 if any(p in name.lower() for p in ("second", "time", "fit", "predict", "proba")) else 4)
    return value


def fit_file(spark: SparkSession, path: str, target: str, *, task: str = "regression", **parameters) -> ForestModel:
    """A forest from a file: all columns but the target; dates only where date_columns names them."""
    df = read_table(spark, path)
    if target not in df.columns:
        raise ValueError(f"unknown target column {target!r}")
    parameters.setdefault("date_columns", {})
    if task == "classification":
        return ForestClassifier(**parameters).fit(df.withColumn(target, F.when(F.col(target).cast("string") != "", F.col(target))), target, detect_dates=False)
    return ForestRegressor(**parameters).fit(df.withColumn(target, F.col(target).try_cast("double")), target, detect_dates=False)


def predict_file(model: ForestModel, source: str, target: str, *, proba: bool = False) -> None:
    """Predictions for a file's rows, found by name: prediction, or proba_<class> for each class."""
    if (format_of(source) == "arrow") != (format_of(target) == "arrow"):
        raise ValueError("input and output must both be Arrow files or neither")
    df = read_table(model.spark, source)
    out = model.transform(df.select(*model.encoder.columns), proba=proba)
    write_table(out.select(*out.columns[len(model.encoder.columns) :]), target)


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's columns; ValueError where right repeats a key or left has one that right lacks."""
    if right.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("the right side repeats keys")
    if left.join(right, keys, "left_anti").limit(1).count():
        raise ValueError("the left side has keys without a match")
    return left.join(right, keys)
