"""Structured Streaming forms: bars, dedupe, sessions, gaps, running ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the event time has a zone, as watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def bars(stream: DataFrame, interval: str, late: str, slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) bars per asset: asset_id, ts, event_id, price, size."""
    at = F.struct("ts", "event_id")
    window = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    return (
        stream.withWatermark("ts", late)
        .groupBy("asset_id", window.alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("trades"))
        .select("asset_id", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "trades")
    )


def deduped(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key; state is dropped behind the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, keys: list[str], gap: str, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").alias("first_at"), "n_events")


def running_ledger(stream: DataFrame) -> DataFrame:
    """A running balance of each account in order of arrival, kept in state: account, seq, cash.

    ``entry`` numbers an account's rows as they came.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        balance, entries = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        rows["balance"] = balance + rows["cash"].cumsum()
        rows["entry"] = entries + 1 + pd.RangeIndex(len(rows)).to_numpy()
        state.update((float(rows["balance"].iloc[-1]), int(rows["entry"].iloc[-1])))
        yield rows[["account", "seq", "cash", "balance", "entry"]]

    return stream.select("account", "seq", "cash").groupBy("account").applyInPandasWithState(fold, "account long, seq long, cash double, balance double, entry long", "balance double, entries long", "append", "NoTimeout")


def to_end(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run over all that is there and read what was written under ``folder``; the driver holds none of it.

    A batch that is run again writes its own folder again. In complete mode the
    last batch is the result.
    """
    out = f"{folder}/out"
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return stream.sparkSession.createDataFrame([], stream.schema)
    rows = stream.sparkSession.read.schema(stream.schema).option("basePath", out)
    return rows.parquet(f"{out}/batch={query.lastProgress['batchId']}" if mode == "complete" else f"{out}/batch=*").select(*stream.columns)
