"""Sessions with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What results depend on; partition counts and memory are the cluster's matter.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
}


def session(app: str = "lumenql", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SEMANTICS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
