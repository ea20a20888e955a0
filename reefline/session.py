"""The session the engine is meant to run in."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the operators count on; everything else is left to the cluster.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "reefline", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
