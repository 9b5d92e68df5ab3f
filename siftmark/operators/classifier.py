"""A topic classifier trained and applied with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import words
from siftmark.operators.joins import join_checked


def class_weights(train: DataFrame) -> DataFrame:
    """(label, weight): rows over classes times the class's rows."""
    counts = train.groupBy("label").agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes")).alias("t"))
    return counts.withColumn("t", totals.scalar()).select(
        "label", (F.col("t.rows") / (F.col("t.classes") * F.col("n"))).alias("weight")
    )


def train_classifier(
    train: DataFrame, features: int = 4096, rounds: int = 15, weighted: bool = False
) -> PipelineModel:
    """Hashed TF-IDF and multinomial logistic regression on (content, label)."""
    rows = train.select(F.col("label").cast("double").alias("label"), words(F.col("content")).alias("words"))
    regression = LogisticRegression(featuresCol="features", maxIter=rounds, regParam=0.01, family="multinomial")
    if weighted:
        balance = class_weights(rows)  # one row per class
        # a class per row; the number of classes is bounded by what the model can tell apart
        rows = join_checked(rows, balance, ["label"])
        regression = regression.setWeightCol("weight")
    stages = [
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        regression,
    ]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``pred`` and ``logits`` to (content, ...)."""
    scored = model.transform(df.withColumn("words", words(F.col("content"))))
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("pred"),
        vector_to_array("rawPrediction").alias("logits"),
    )
