"""Session settings for local work; on a cluster the deployment's own settings stand."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("caselens")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
