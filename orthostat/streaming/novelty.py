"""Structured Streaming: incremental novelty per micro-batch and request counts in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import novelty


def request_counts(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """L1 over a stream: (start, n) of event-time windows, with a watermark.

    A timestamp without zone is cast, since watermarks need one with zone (the session's UTC).
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def relations_to_history(stream: DataFrame, history_path: str, checkpoint: str, least_confidence: float = 0.70) -> StreamingQuery:
    """Each micro-batch of relations (item, kind, a, b, confidence) is compared with the stored history; new ones join it.

    The history is a parquet table partitioned by ``batch``; a batch that is replayed after a
    failure overwrites its own partition and is compared with the others only, so that the
    result stays the same.
    """

    def step(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        schema = "item string, kind string, a string, b string, confidence double, batch long"
        try:
            known = spark.read.schema(schema).parquet(history_path).where(F.col("batch") < batch)
        except Exception:  # noqa: BLE001  the first batch finds no table
            known = spark.createDataFrame([], schema)
        own = df.dropDuplicates(["item"])
        fresh = novelty.relation_novelty(own.select("item", "kind", "a", "b"), known.where(F.col("confidence") >= least_confidence)).where("novel")
        rows = own.join(fresh.select("item"), "item", "left_semi").select("item", "kind", "a", "b", "confidence")
        rows.write.mode("overwrite").parquet(f"{history_path}/batch={batch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
