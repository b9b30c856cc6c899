"""Models trained once on a table and applied as transformations."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.sources.tables import scratch_path


def vector_column(df: DataFrame, array: str, name: str) -> DataFrame:
    """``df`` with an array of numbers as a vector as long as its longest row; missing and null entries are 0."""
    width = df.agg(F.max(F.size(array))).first()[0] or 0
    filled = F.transform(F.sequence(F.lit(1), F.lit(max(width, 1))), lambda i: F.coalesce(
        F.try_element_at(F.col(array), i).cast("double"), F.lit(0.0)))
    return df.withColumn(name, array_to_vector(filled))


def classify(df: DataFrame, features: list[str], label: str, trees: int = 10, seed: int = 42) -> DataFrame:
    """Rows with a random-forest ``prediction``; one forest is trained for the whole table."""
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, seed=seed)
    trained = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), forest]).fit(df)
    # A stored model carries no training summary, which would tie the tasks to the session.
    path = scratch_path(df.sparkSession, "forest")
    trained.write().save(path)
    scored = PipelineModel.load(path).transform(df)
    return scored.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop(
        "_features", "rawPrediction", "probability")


def train_classifier(df: DataFrame, features: list[str], label: str, path: str) -> None:
    """Fit a binary logistic pipeline and store it under a path."""
    stages = [VectorAssembler(inputCols=features, outputCol="_features"),
              LogisticRegression(featuresCol="_features", labelCol=label, probabilityCol="_probability", maxIter=20)]
    Pipeline(stages=stages).fit(df).write().overwrite().save(path)


def predict(df: DataFrame, path: str) -> DataFrame:
    """Rows with the stored model's ``prediction`` and the probability of class 1."""
    scored = PipelineModel.load(path).transform(df)
    return scored.withColumn("score", vector_to_array("_probability")[1]).drop("_features", "rawPrediction", "_probability")


def linear_model(df: DataFrame, features: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Least-squares fit: (coefficients with the fit's summary, rows with ``prediction``)."""
    assembled = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    model = LinearRegression(featuresCol="_features", labelCol=label, solver="normal").fit(assembled)
    facts = [("intercept", float(model.intercept)), *zip(features, map(float, model.coefficients)),
             ("r2", float(model.summary.r2)), ("rmse", float(model.summary.rootMeanSquaredError))]
    path = scratch_path(df.sparkSession, "line")
    model.write().save(path)
    fitted = LinearRegressionModel.load(path).transform(assembled).drop("_features")
    return df.sparkSession.createDataFrame(facts, "term string, value double"), fitted
