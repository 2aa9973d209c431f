"""Sessions: settings the engine relies on, and Python workers that can import it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this installation import the package, whatever folder they start in."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    return spark


def session(master: str = "local[*]", partitions: int = 8, **settings: str) -> SparkSession:
    """A session with UTC time, adaptive execution and no UI; ``settings`` use ``_`` for ``.`` in names."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    for key, value in (fixed | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return importable(builder.getOrCreate())
