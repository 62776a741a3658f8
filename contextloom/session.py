"""Sessions with the settings the library is meant for."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

REPO_ROOT = str(Path(__file__).resolve().parents[1])
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def session(name: str = "contextloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by a path of its own."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if REPO_ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *have])
