"""Models on small tables whose answer is known."""

import pytest
from pyspark.sql import functions as F

from lakewright.operators import ml
from lakewright.plans import load_plans
from tests.conftest import DATA


@pytest.fixture(scope="module")
def points(spark):
    """Class 1 lies above x = 10, far from class 0."""
    x = F.when(F.col("id") % 2 == 0, F.col("id") % 5).otherwise(F.col("id") % 5 + 20).cast("double")
    return spark.range(200).select("id", x.alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 2).cast("double").alias("label"))


def test_vectors_are_taken_whole(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([7.0],), (None,)], "v array<double>")
    got = [list(r.vector) for r in ml.vector_column(df, "v", "vector").collect()]
    assert got == [[1.0, 2.0, 3.0, 4.0, 5.0], [7.0, 0.0, 0.0, 0.0, 0.0], [0.0] * 5]


def test_forest_separates_classes(points):
    scored = ml.classify(points, ["a", "b"], "label")
    assert scored.count() == 200 and scored.where("prediction <> label").isEmpty()
    assert scored.where("confidence < 0.5 OR confidence > 1").isEmpty()


def test_stored_model_is_applied(points, tmp_path):
    path = str(tmp_path / "model")
    ml.train_classifier(points, ["a", "b"], "label", path)
    scored = ml.predict(points, path)
    assert scored.where("prediction <> label").isEmpty()
    assert scored.where("label = 1 AND score <= 0.5").isEmpty()


def test_linear_model_finds_the_plane(points):
    df = points.withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 5)
    terms, fitted = ml.linear_model(df, ["a", "b"], "y")
    got = {r.term: r.value for r in terms.collect()}
    assert got["a"] == pytest.approx(3, abs=1e-6) and got["b"] == pytest.approx(-2, abs=1e-6) and got["intercept"] == pytest.approx(5, abs=1e-5)
    assert fitted.where("abs(prediction - y) > 1e-4").isEmpty()


def test_random_pick_is_a_row_of_the_table(spark, tables):
    picked = load_plans()["topk_random"](spark, DATA)
    assert picked.count() == 1 and picked.join(tables.customer, "c_custkey").count() == 1


def test_every_series_gets_its_forecast(spark, tables):
    got = load_plans()["ts_forecast"](spark, DATA).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("a"), F.max("step").alias("b"))
    kinds = tables.events.groupBy("event_type").agg(F.countDistinct(F.to_date("ts")).alias("days"))
    both = {r.event_type: r for r in got.join(kinds, "event_type").collect()}
    assert len(both) == kinds.count()
    assert all(r.n == r.b == min(-(-r.days * 3 // 10), 12) and r.a == 1 for r in both.values())
