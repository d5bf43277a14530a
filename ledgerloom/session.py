"""Spark sessions with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; a cluster's own settings stay unless ``extra`` names them."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName("ledgerloom")
    if master:
        builder = builder.master(master)
        conf |= {"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"}
    s = builder.config(map=conf | (extra or {})).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
