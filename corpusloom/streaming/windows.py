"""Event time windows over a stream of events, with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..plans.staging import Stage

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    # a pattern serves a single file and a folder of files alike
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder.rstrip('/')}/event[s].parquet")


def tumbling(stream: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    return _counted(stream.withWatermark("ts", late), F.window("ts", size))


def sliding(stream: DataFrame, size: str = "1 day", step: str = "12 hours", late: str = "1 day") -> DataFrame:
    return _counted(stream.withWatermark("ts", late), F.window("ts", size, step))


def _counted(stream: DataFrame, window: Column) -> DataFrame:
    out = stream.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run(stream: DataFrame, stage: Stage, name: str, mode: str = "append") -> DataFrame:
    """Run to the present end and read what came out. In append mode windows come out once
    they are closed for good; in complete mode all, as they stand at the end."""
    out, spark = stage.path(name), stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", stage.path(f"{name}-checkpoint")).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out))
    else:
        # a batch that is delivered again writes the same folder again
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    writer.start().awaitTermination()
    df = spark.read.schema(stream.schema).parquet(out)
    return df.select(*stream.columns)


class Progress(StreamingQueryListener):
    """Rows taken in per batch, for a progress display."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, int]] = []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.batches.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
