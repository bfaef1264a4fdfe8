"""Session factory with the settings the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results; everything else is left to the cluster.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# AQE sizes the shuffles and splits skewed join partitions at run time, so
# no partition count is fixed here. The scan split is smaller than the default
# because one line of input JSON expands into many nested columns in memory.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "64m",
    # Python call sites are not recorded per expression: the plans here hold
    # thousands of expressions and recording doubles the time to build them.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def build_session(app_name: str = "marklake", master: str | None = None, **conf) -> SparkSession:
    """Return a session carrying the required settings.

    ``conf`` takes extra settings with ``__`` standing for a dot.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SCALE_CONF, **REQUIRED_CONF}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# Other names of the same zone.
UTC_NAMES = ("utc", "etc/utc", "uct", "etc/uct", "gmt", "etc/gmt", "z", "zulu", "etc/zulu", "universal", "+00:00")


def check_session(spark: SparkSession) -> None:
    """Raise when a setting that would change results differs; jobs call it first."""
    for key, wanted in REQUIRED_CONF.items():
        found = spark.conf.get(key)
        same = UTC_NAMES if wanted == "UTC" else (wanted,)
        if found.lower() not in same:
            raise ValueError(f"{key} must be {wanted}, found {found}")
