"""A session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tellurion", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, ANSI arithmetic, UTC; anything else as the cluster sets it."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
