"""A landing folder of samples as a stream: findings are appended, cells are counted as they come in.

The rules are a stateless projection. Only the cell counts keep state, a row for each model and
condition; with an event-time column and a watermark they are kept by window, and old windows are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions.dialect import SPARK
from sieveloom.operators.evaluate import usable
from sieveloom.operators.lint import lint

SAMPLES = "model string, condition string, sample_id string, kind string, html string, at timestamp"


def landing(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def findings(stream: DataFrame, rules: list | None = None) -> DataFrame:
    return lint(stream, rules, keys=["model", "condition", "sample_id", "at"])


def counts(stream: DataFrame, window: str | None = None, late: str = "1 hour") -> DataFrame:
    """(model, condition, attempted, errored, scored), by window of ``at`` if one is named."""
    keys = ["model", "condition"]
    if window:
        stream, keys = stream.withWatermark("at", late).withColumn("window", F.window("at", window)), ["window", *keys]
    good = (F.col("kind") == "html") & F.expr(usable(SPARK, "coalesce(html, '')"))
    return stream.groupBy(*keys).agg(F.count("*").alias("attempted"), F.count_if(F.col("kind") == "error").alias("errored"), F.count_if(good).alias("scored"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger):
    """Starts a query that writes Parquet; ``trigger`` as ``DataStreamWriter.trigger`` takes it (``availableNow=True`` unless given)."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
