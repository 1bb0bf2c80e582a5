"""Commands: fit, predict, convert, view and export. Run with python -m arborlake.cli, or by spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from arborlake.operators.export import forest_sql
from arborlake.operators.forest import ForestModel
from arborlake.sources import files


def pairs(values: list[str]) -> dict[str, str]:
    """COLUMN=VALUE settings."""
    out = {}
    for v in values:
        name, sign, value = v.partition("=")
        if not sign or not name:
            raise ValueError(f"expected COLUMN=VALUE, got {v!r}")
        out[name] = value
    return out


def cap(value: str) -> int | None:
    return None if value == "none" else int(value)


def share(value: str) -> float | str:
    return value if value == "sqrt" else float(value)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arborlake")
    commands = top.add_subparsers(dest="command", required=True)
    fit = commands.add_parser("fit", help="fit a forest to a file")
    fit.add_argument("input")
    fit.add_argument("--target", required=True)
    fit.add_argument("--task", choices=("regression", "classification"), default="regression")
    fit.add_argument("--output", required=True)
    fit.add_argument("--trees", type=int, dest="n_trees")
    fit.add_argument("--seed", type=int)
    fit.add_argument("--bootstrap-max", type=cap, default=40_000)
    fit.add_argument("--max-features", type=share)
    fit.add_argument("--missing", action="append", default=[], metavar="COLUMN=VALUE")
    fit.add_argument("--date-column", action="append", default=[], metavar="COLUMN=FORMAT")
    fit.add_argument("--allow-new-missing", action="store_true")
    predict = commands.add_parser("predict", help="predict for a file's rows")
    predict.add_argument("model")
    predict.add_argument("input")
    predict.add_argument("output")
    predict.add_argument("--proba", action="store_true")
    convert = commands.add_parser("convert", help="a numeric CSV file to a typed table")
    convert.add_argument("input")
    convert.add_argument("output")
    view = commands.add_parser("view", help="a compact view of a CSV file")
    view.add_argument("input")
    view.add_argument("--columns", nargs="*")
    view.add_argument("--rows", type=int)
    view.add_argument("--start", type=int, default=0)
    view.add_argument("--end", type=int)
    view.add_argument("--sample")
    view.add_argument("--seed", type=int, default=0)
    export = commands.add_parser("export", help="a model as one SQL expression")
    export.add_argument("model")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a command; what it prints is returned too."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    said = ""
    if a.command == "fit":
        given = {"n_trees": a.n_trees, "seed": a.seed, "bootstrap_max": a.bootstrap_max, "missing_values": pairs(a.missing) or None, "date_columns": pairs(a.date_column), "allow_new_missing": a.allow_new_missing}
        if a.max_features is not None:
            given["max_features"] = a.max_features
        files.fit_file(spark, a.input, a.target, task=a.task, **given).save(a.output)
    elif a.command == "predict":
        files.predict_file(ForestModel.load(spark, a.model), a.input, a.output, proba=a.proba)
    elif a.command == "convert":
        files.convert_csv(spark, a.input, a.output)
    elif a.command == "view":
        said = files.view_csv(spark, a.input, a.columns, rows=a.rows, start=a.start, end=a.end, sample=a.sample, seed=a.seed)
    else:
        said = forest_sql(ForestModel.load(spark, a.model))
    if said:
        print(said, end="")
    return said


if __name__ == "__main__":
    main()
