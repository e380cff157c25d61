"""Streams: events by channel, and metrics a minute."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.errors import ValidationError

CHANNEL = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")


def minute_rollup(events: DataFrame, by: list[str], value: str, error: str | None = None, approximate: int | None = None) -> DataFrame:
    """A row a minute and key: count, mean, nearest-rank percentiles, and with ``error`` how often that condition holds.

    Exact percentiles keep the distinct values of a group; with ``approximate`` (the accuracy of a sketch of that many entries)
    a group of any size takes bounded memory, as an endless stream needs. Works on batches and, in update mode, on streams.
    """
    at = F.date_trunc("minute", F.col("ts")).alias("minute")
    if approximate:
        ranks = F.percentile_approx(value, [0.5, 0.95, 0.99], approximate)
    else:
        ranks = F.expr(f"percentile_disc(array(0.5D, 0.95D, 0.99D)) WITHIN GROUP (ORDER BY `{value}`)")
    errors = [F.count_if(F.expr(error)).alias("errors")] if error else []
    rows = events.groupBy(at, *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), ranks.alias("ranks"), *errors)
    return rows.select("minute", *by, "n", "mean", *[F.col("ranks")[k].alias(p) for k, p in enumerate(("p50", "p95", "p99"))], *(["errors"] if error else []))


def merged_rollup(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Two rollups as one: counts and errors add up, means are weighed by them, percentiles are the new ones where there are such."""
    both = old.withColumn("_later", F.lit(0)).unionByName(new.withColumn("_later", F.lit(1))).groupBy("minute", *by)
    errors = [F.sum("errors").alias("errors")] if "errors" in old.columns else []
    mean = F.sum(F.col("mean") * F.col("n")) / F.sum("n")
    ranks = [F.max_by(p, "_later").alias(p) for p in ("p50", "p95", "p99") if p in old.columns]
    return both.agg(F.sum("n").alias("n"), mean.alias("mean"), *ranks, *errors)


class MetricsSink:
    """Rollups in a folder, a version a flush; a late minute is merged into what the folder has of it, and minutes older than ``days`` go."""

    def __init__(self, spark: SparkSession, folder: str, by: list[str], days: int | None = None) -> None:
        self.spark, self.folder, self.by, self.version, self.days = spark, folder.rstrip("/"), by, 0, days

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/v={self.version}") if self.version else None

    def flush(self, rows: DataFrame, batch: int | None = None) -> None:
        """Takes a rollup; also a handler for foreachBatch."""
        old = self.read()
        rows = rows if old is None else merged_rollup(old, rows, self.by)
        if self.days is not None:
            rows = rows.where(F.col("minute") >= F.current_timestamp() - F.make_dt_interval(F.lit(self.days)))
        rows.write.parquet(f"{self.folder}/v={self.version + 1}")
        self.version += 1


def shared_folder(spark: SparkSession) -> str:
    """Where streams keep their state: the session's checkpoint folder, else one beside the warehouse."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"


def stream(spark: SparkSession, path: str, schema, per_trigger: int = 1, only: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream, with ``ts`` as an event time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", only).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(rows: DataFrame, by: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and means a minute with a watermark; a late event counts in its own minute."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("minute"), *by, "n", "mean")


def listen(rows: DataFrame, channel: str, handler: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1 second"):
    """Hands every batch of a channel's events to ``handler``; returns the running query, whose stop() ends it.

    It stays up and looks for events ``every`` so often; with None it ends once all that is there was handed over.
    """
    if not CHANNEL.fullmatch(channel):
        raise ValidationError("a channel is a name of up to 63 characters")
    chosen = rows.where(F.col("event_type") == channel)
    started = chosen.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if every is None else started.trigger(processingTime=every)).start()


def notify(spark: SparkSession, path: str, channel: str, **fields: object) -> None:
    """Adds one event of a channel to the folder that listeners read; ``fields`` are its other columns."""
    if not CHANNEL.fullmatch(channel):
        raise ValidationError("a channel is a name of up to 63 characters")
    schema = spark.read.parquet(path).schema
    unknown = set(fields) - set(schema.names)
    if unknown:
        raise ValidationError(f"unknown event field {sorted(unknown)[0]}")
    values = {"ts": dt.datetime.now(dt.UTC).replace(tzinfo=None)} | fields | {"event_type": channel}
    spark.createDataFrame([tuple(values.get(c) for c in schema.names)], schema).write.mode("append").parquet(path)
