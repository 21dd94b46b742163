"""Predictions in a session that has observed a frame before."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from hexcadence.operators import modelling


@pytest.fixture
def observed(spark):
    watch = Observation()
    spark.range(3).observe(watch, F.count(F.lit(1)).alias("n")).collect()
    assert watch.get == {"n": 3}
    return spark


def _rows(spark):
    x = (F.col("row_id") % 10).cast("double")
    return spark.range(200).withColumnRenamed("id", "row_id").select(
        "row_id", x.alias("x"), (x + F.col("row_id") % 3 >= 6).cast("int").alias("label"), F.lit(1.0).alias("weight")
    )


def test_logistic_predictions_leave_the_driver(observed):
    df = _rows(observed)
    model = modelling.fit(df, ["x"], modelling.logistic("label", 200.0))
    got = modelling.predict(model, df, "label", ["row_id"]).collect()
    assert len(got) == 200
    # The coefficients are those that were fitted.
    plain = modelling.Pipeline(stages=[*model.stages[:1], modelling.logistic("label", 200.0)]).fit(df).stages[-1]
    assert model.stages[-1].coefficients == plain.coefficients and model.stages[-1].intercept == plain.intercept


def test_stacked_predictions_leave_the_driver(observed):
    p = (F.col("row_id") % 10) / F.lit(10.0)
    wide = observed.range(200).withColumnRenamed("id", "row_id").select("row_id", (p + F.col("row_id") % 3 / 10 >= 0.6).cast("int").alias("y_true"), p.alias("y_proba"))
    both = wide.withColumn("model", F.lit("a")).unionByName(wide.withColumn("model", F.lit("b")))
    got = modelling.stack_models(both, both, ["row_id"], ["a", "b"]).collect()
    assert len(got) == 200 and {r.y_stacked for r in got} == {0, 1}
