"""A session with the settings that the engine wants."""

from __future__ import annotations

from pyspark.sql import SparkSession

from grovespark.ship import ship

#: AQE re-plans joins by measured sizes; Python data sources get filters pushed down.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "grovespark", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark
