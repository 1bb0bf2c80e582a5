"""Losses and metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mse(y: str, p: str) -> Column:
    return F.avg((F.col(y) - F.col(p)) ** 2)


def negative_rmse(y: str, p: str) -> Column:
    return -F.sqrt(mse(y, p))


def r2(y: str, p: str) -> Column:
    """1 - residual / total squares; NaN where the target does not vary."""
    total = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count(y)
    return F.when(total > 0, 1 - F.sum((F.col(y) - F.col(p)) ** 2) / total).otherwise(F.lit(float("nan")))


def accuracy(label: str, predicted: str) -> Column:
    return F.avg((F.col(label) == F.col(predicted)).cast("int"))


def brier(probs: str, true_probability: Column) -> Column:
    """Mean of sum p^2 - 2 p_true + 1; of a class that the model has not seen p_true is 0."""
    squares = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p * p)
    return F.avg(squares - 2 * F.coalesce(true_probability, F.lit(0.0)) + 1)


def log_loss(true_probability: Column, least: float = 1e-15) -> Column:
    return -F.avg(F.log(F.greatest(F.least(true_probability, F.lit(1.0 - least)), F.lit(least))))


def macro_f1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(macro_f1): the mean over all classes that occur or are predicted."""
    cells = df.groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array("t", "p")).alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), "n")
    per = sides.groupBy("c").agg(F.sum("hit").alias("twice"), F.sum("n").alias("total"))
    return per.agg(F.avg(F.col("twice") / F.col("total")).alias("macro_f1"))


def target_profile(df: DataFrame, label: str) -> DataFrame:
    """Classes, the shares of the largest and the smallest, and the entropy in nats."""
    shares = df.groupBy(label).agg(F.count("*").alias("n"))
    total = shares.agg(F.sum("n").alias("total"))
    per = shares.crossJoin(F.broadcast(total)).select((F.col("n") / F.col("total")).alias("s"))
    return per.agg(F.count("*").alias("classes"), F.max("s").alias("majority"), F.min("s").alias("minority"), (-F.sum(F.col("s") * F.log("s"))).alias("entropy"))


METRICS = {"r2": r2, "rmse": negative_rmse, "accuracy": accuracy}
