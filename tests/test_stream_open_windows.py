"""Windows that are open at the end of the available data."""

from pyspark.sql import functions as F

from corpusflow.plans import catalogue, views


def test_no_row_is_outside_the_windows(spark, sf_dir):
    found = catalogue.QUERIES["stream_metrics_all"](spark, sf_dir)
    assert found.agg(F.sum("samples")).first()[0] == views.metrics(spark, sf_dir).count()
