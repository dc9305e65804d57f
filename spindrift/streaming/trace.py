"""Run logs as a stream (an addition: the same summary as the batch one, kept per window)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.runs import EVENT_SCHEMA

STREAM_SCHEMA = EVENT_SCHEMA + ", at timestamp"


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(STREAM_SCHEMA).json(folder)


def token_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(text, done) records of newline-delimited JSON files; bad lines are dropped."""
    rows = spark.readStream.text(folder).select(F.from_json("value", "text string, done boolean").alias("r"))
    return rows.where("r.text IS NOT NULL OR r.done IS NOT NULL").select("r.text", F.coalesce("r.done", F.lit(False)).alias("done"))


def counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(run_id, window, kind, n, passed) per run, window and kind; closed windows only."""
    kept = events.withWatermark("at", late)
    passed = F.count_if((F.col("kind") == "check") & (F.lower(F.expr("data['ok']")) == "true"))
    return kept.groupBy("run_id", F.window("at", window).alias("window"), "kind").agg(F.count(F.lit(1)).alias("n"), passed.alias("passed"))
