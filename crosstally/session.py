"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Runtime settings, applied to whatever session the caller has.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",  # an overflowing sum is an error, never a wrong number
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose output feeds an aggregation on the same key is split too, at the price of one
    # more shuffle, and only when a partition really is skewed.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Of a JSON object's fields of one name the last counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: For whoever builds the session.  Capturing the Python call site of every column expression
#: costs more than planning does.
LAUNCH_SETTINGS = SETTINGS | {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
