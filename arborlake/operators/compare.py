"""Preprocessing as other learners need it, for comparisons: imputation, one-hot, target and ordinal encoding."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def target_means(df: DataFrame, column: str, y: str) -> DataFrame:
    """(column, mean, n): the target's mean for each level."""
    return df.groupBy(column).agg(F.avg(y).alias("mean"), F.count("*").alias("n"))


def ordinal(df: DataFrame, column: str) -> DataFrame:
    """(column, ordinal): levels by their order."""
    return df.select(column).distinct().select(column, (F.dense_rank().over(Window.orderBy(column)) - 1).cast("double").alias("ordinal"))


def comparison_pipeline(df: DataFrame, numbers: list[str], texts: list[str], y: str, *, onehot_max: int = 20) -> Pipeline:
    """Numbers are imputed by their median; texts of at most onehot_max levels become flags, others target means."""
    stages = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"_i_{c}" for c in numbers])]
    levels = df.agg(*(F.count_distinct(c).alias(c) for c in texts)).first()
    few, many = [c for c in texts if levels[c] <= onehot_max], [c for c in texts if levels[c] > onehot_max]
    stages += [StringIndexer(inputCol=c, outputCol=f"_s_{c}", handleInvalid="keep") for c in texts]
    if few:
        stages.append(OneHotEncoder(inputCols=[f"_s_{c}" for c in few], outputCols=[f"_o_{c}" for c in few], dropLast=False))
    if many:
        stages.append(TargetEncoder(inputCols=[f"_s_{c}" for c in many], outputCols=[f"_t_{c}" for c in many], labelCol=y, targetType="continuous", handleInvalid="keep"))
    columns = [f"_i_{c}" for c in numbers] + [f"_o_{c}" for c in few] + [f"_t_{c}" for c in many]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")])
