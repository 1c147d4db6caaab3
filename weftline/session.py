"""A session with the settings the engine is tuned for."""

from pyspark.sql import SparkSession


def session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins on; conf overrides by name, underscores standing for dots."""
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
