"""Session builder with the settings every plan here assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(master: str | None = None, app: str = "orrery", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` entries (dots as ``__``) override.

    On a cluster the master, checkpoint folder and partition counts come from
    spark-submit; only what is unset there is set here.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master or "SPARK_MASTER" not in os.environ:
        b = b.master(master or "local[*]")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
