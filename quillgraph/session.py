"""One place for the session settings that the engine wants."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quillgraph", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC. ``partitions`` is for local runs; a cluster keeps its own setting."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
