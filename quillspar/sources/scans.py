"""Scans and generators: catalogues with pruning, typed spools, ordered merges, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def block_range(df: DataFrame, low: int, high: int, markets: Sequence[int] | None = None, tokens: Sequence[str] | None = None) -> DataFrame:
    """Facts of a block range; all predicates reach the Parquet scan."""
    out = df.where(F.col("block_number").between(low, high))
    if markets is not None:
        out = out.where(F.col("market_id").isin(list(markets)))
    return out if tokens is None else out.where(F.lower("token_id").isin([t.lower() for t in tokens]))


def point_in_time(df: DataFrame, cutoff: str, ingest: str = "ingested_at") -> DataFrame:
    """What had been ingested strictly before the cutoff."""
    return df.where(F.col(ingest) < F.lit(cutoff).cast(df.schema[ingest].dataType))


def windows_scan(tape: DataFrame, windows: DataFrame, keys: Sequence[str], x: str, bucket: int) -> DataFrame:
    """Rows inside any of many windows, each once: one scan for all of them.

    Windows are merged, laid out over buckets and equi-joined, so the join is
    neither a range join nor a loop over windows.
    """
    from ..operators.intervals import islands

    merged = islands(windows, keys, "start", "end").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    side = merged.select(*keys, "_bucket", "start", "end")
    return tape.withColumn("_bucket", F.floor(F.col(x) / bucket)).join(side, [*keys, "_bucket"]).where((F.col(x) >= F.col("start")) & (F.col(x) < F.col("end"))).select(*tape.columns)


def ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A total order over all files: the distributed form of a merge of sorted ones."""
    return df.orderBy(*order)


def boundary_chunks(df: DataFrame, boundary: Sequence[str], chunks: int) -> DataFrame:
    """Range partitions in which rows that share a boundary stay together, in order."""
    return df.repartitionByRange(chunks, *boundary).sortWithinPartitions(*boundary)


def json_spool(spark: SparkSession, path: str, typed: T.StructType) -> DataFrame:
    """A line-JSON spool read as text columns and cast; what can't be cast is null.

    Nothing is inferred, so a column that is absent from all rows is still there.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in typed])
    rows = spark.read.schema(raw).json(path)
    return rows.select(*[F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in typed])


def parquet_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of differing columns as one table, with each row's file."""
    return spark.read.option("mergeSchema", True).parquet(*paths).withColumn("source_file", F.col("_metadata.file_path"))


def api_trades(df: DataFrame, start: int, end: int, *, markets: Sequence[int] = (), tokens: Sequence[str] = ()) -> DataFrame:
    """Trades of a source that gives time twice, in seconds and as a timestamp: both bounds are put on the scan, with what a valid trade has."""
    at = lambda seconds: F.timestamp_seconds(F.lit(seconds)).cast(df.schema["trade_time"].dataType)
    out = df.where(F.col("trade_timestamp").between(start, end) & F.col("trade_time").between(at(start), at(end)) & F.col("price").between(0, 1) & (F.col("size") > 0))
    out = out.where(F.col("market_id").isin(list(markets))) if markets else out
    return out.where(F.col("token_id").isin(list(tokens))) if tokens else out


#: Names that raw book rows of either schema go by.
RAW_NAMES = {"kind": ("event_type", "update_type"), "asset_id": ("asset_id", "token_id"), "price": ("price", "px"), "size": ("size", "qty")}


def raw_books(parts: Sequence[DataFrame], kinds: Sequence[str]) -> DataFrame:
    """Raw book rows of any known schema as one, of the asked kinds; the filter is put on each part's own column."""
    out = None
    for part in parts:
        own = {name: next(a for a in aliases if a in part.columns) for name, aliases in RAW_NAMES.items()}
        rows = part.where(F.col(own["kind"]).isin(list(kinds))).select(*[F.col(c).alias(name) for name, c in own.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


_LEVELS = "array<struct<price:string,size:string>>"
MESSAGE = f"event_type string, asset_id string, timestamp string, side string, price string, size string, bids {_LEVELS}, asks {_LEVELS}, price_changes array<struct<asset_id:string,side:string,price:string,size:string>>"


def book_messages(df: DataFrame, raw: str) -> DataFrame:
    """Messages of a book feed, a row a level: kind (snapshot, delta, trade), token, side, price, size and place in the message.

    Items without a token, a known side or numbers are left out, as is what isn't JSON.
    """
    m = df.withColumn("_m", F.from_json(raw, MESSAGE))
    side = lambda s: f"case upper({s}) when 'BUY' then 'BID' when 'SELL' then 'ASK' end"
    row = lambda kind, token, s, x, i: f"named_struct('kind', '{kind}', 'token_id', {token}, 'side', {s}, 'price', try_cast({x}.price as decimal(11,10)), 'size', try_cast({x}.size as decimal(26,10)), 'place', {i})"
    levels = lambda name, s: f"transform(coalesce(_m.{name}, array()), (x, i) -> {row('snapshot', '_m.asset_id', repr(s), 'x', 'i')})"
    items = f"""case _m.event_type when 'book' then concat({levels('bids', 'BID')}, {levels('asks', 'ASK')})
        when 'price_change' then transform(coalesce(_m.price_changes, array()), (x, i) -> {row('delta', 'x.asset_id', side('x.side'), 'x', 'i')})
        when 'last_trade_price' then array({row('trade', '_m.asset_id', side('_m.side'), '_m', '0')}) end"""
    rows = m.select(*df.columns, F.expr("try_cast(_m.timestamp as bigint)").alias("event_ms"), F.explode(F.expr(items)).alias("x")).select(*df.columns, "event_ms", "x.*")
    return rows.where("token_id is not null and side is not null and price is not null and size is not null")


def hours(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.sql(f"select explode(sequence(timestamp_ntz '{start}', timestamp_ntz '{end}', interval 1 hour)) as hour")


def sample_grid(spark: SparkSession, low: int, high: int, step: int) -> DataFrame:
    """low, low + step, ... and high itself, each once."""
    return spark.range(low, high + 1, step).withColumnRenamed("id", "x").union(spark.range(high, high + 1)).distinct()


def universe(df: DataFrame, *, title: str, pattern: str | None = None, like: str | None = None, settled: bool | None = None) -> DataFrame:
    """Markets by title pattern and state."""
    out = df if pattern is None else df.where(F.col(title).rlike(pattern))
    out = out if like is None else out.where(F.col(title).ilike(like))
    return out if settled is None else out.where(F.col("settled") == settled)
