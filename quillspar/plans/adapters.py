"""The test tables as the engine's inputs, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import PRICE, SIZE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints: trade_id, market_id, asset_id, block, block_time, side, price, size."""
    value = F.col("value")
    price = (F.least(value.cast("decimal(10,2)"), F.lit(500).cast("decimal(10,2)")) * F.lit("0.002").cast("decimal(4,3)")).cast(PRICE)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trade_id"), (F.col("user_id") % 4).alias("market_id"), F.col("user_id").alias("asset_id"), F.col("event_id").alias("block"), F.col("ts").alias("block_time"),
        F.when(F.col("event_type").isin("purchase", "click", "signup"), "BUY").otherwise("SELL").alias("side"), price.alias("price"), value.cast(SIZE).alias("size"),
    )


TAPE = """tape as (select event_id as trade_id, user_id % 4 as market_id, user_id as asset_id, event_id as block, ts as block_time,
    case when event_type in ('purchase', 'click', 'signup') then 'BUY' else 'SELL' end as side,
    cast(least(cast(value as decimal(10,2)), cast(500 as decimal(10,2))) * cast(0.002 as decimal(4,3)) as decimal(11,10)) as price,
    cast(value as decimal(26,10)) as size from events)"""


def raw_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills with duplicates: part of the lines come again with a later ingest and another size."""
    line = table(spark, sf_dir, "lineitem")
    price = ((F.col("l_partkey") % 102).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(PRICE)
    base = line.select(
        F.col("l_orderkey").alias("tx_hash"), F.col("l_linenumber").cast("long").alias("log_index"), (F.col("l_partkey") % 7).alias("market_id"), F.col("l_partkey").alias("token_id"), F.col("l_suppkey").alias("maker"),
        (F.col("l_suppkey") + 1).alias("taker"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3).alias("side_code"), price.alias("price"), F.col("l_quantity").cast(SIZE).alias("size"),
        F.col("l_orderkey").alias("block_number"), F.col("l_shipdate").alias("ingested_at"), F.col("l_shipdate").alias("block_time"),
    )
    again = base.where("tx_hash % 10 = 0").withColumn("size", (F.col("size") + 1).cast(SIZE)).withColumn("ingested_at", F.col("ingested_at") + F.expr("interval 1 day"))
    return base.unionByName(again)


FILLS = """fills0 as (select l_orderkey as tx_hash, cast(l_linenumber as bigint) as log_index, l_partkey % 7 as market_id, l_partkey as token_id, l_suppkey as maker, l_suppkey + 1 as taker,
    case when l_returnflag = 'A' then 1 when l_returnflag = 'R' then 2 else 3 end as side_code,
    cast(cast(l_partkey % 102 as decimal(5,0)) * cast(0.01 as decimal(3,2)) as decimal(11,10)) as price, cast(l_quantity as decimal(26,10)) as size,
    l_orderkey as block_number, l_shipdate as ingested_at, l_shipdate as block_time from lineitem),
fills as (select * from fills0 union all select tx_hash, log_index, market_id, token_id, maker, taker, side_code, price, cast(size + 1 as decimal(26,10)), block_number, ingested_at + interval 1 day, block_time from fills0 where tx_hash % 10 = 0),
canon as (select * exclude (rn) from (select *, row_number() over (partition by tx_hash, log_index, market_id, token_id, maker, taker, side_code order by ingested_at desc, size desc) as rn from fills) where rn = 1)"""


def over_blocks(spark: SparkSession, sf_dir: str, df: DataFrame, key: str) -> DataFrame:
    """``df`` with a block of the whole tape for each row, as ``at``."""
    last = table(spark, sf_dir, "events").agg(F.coalesce(F.max("event_id"), F.lit(0).cast("long")).alias("_last"))
    return df.crossJoin(F.broadcast(last)).withColumn("at", F.col(key) % (F.col("_last") + 1)).drop("_last")  # one row


#: The same in SQL.
AT = "o_orderkey % ((select coalesce(max(event_id), 0) from events) + 1)"


def replay_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders over the whole tape: arrival and deadline in blocks, limits around the middle, four kinds of time in force."""
    o = over_blocks(spark, sf_dir, table(spark, sf_dir, "orders"), "o_orderkey")
    users = 15
    asset = F.col("o_custkey") % users
    limit = F.when(F.col("o_orderkey") % 2 == 0, F.lit("0.30")).otherwise(F.lit("0.05")).cast(PRICE)
    return o.select(
        F.col("o_orderkey").alias("order_index"), (asset % 4).alias("market_id"), asset.alias("asset_id"), F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"), limit.alias("limit_price"),
        (F.col("o_custkey") % 40 + 1).cast(SIZE).alias("size"), F.col("at").alias("arrival"), (F.col("at") + 20 + F.col("o_custkey") % 200).alias("deadline"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", "FOK").when(F.substring("o_orderpriority", 1, 1) == "2", "IOC").otherwise("GTC").alias("tif"), (F.col("o_custkey") % 90).cast(SIZE).alias("queue_ahead"),
    )


ORDERS = f"""ords as (select o_orderkey as order_index, (o_custkey % 15) % 4 as market_id, o_custkey % 15 as asset_id, case when o_orderkey % 2 = 0 then 'BUY' else 'SELL' end as side,
    cast(case when o_orderkey % 2 = 0 then 0.30 else 0.05 end as decimal(11,10)) as limit_price, cast(o_custkey % 40 + 1 as decimal(26,10)) as size, {AT} as arrival, {AT} + 20 + o_custkey % 200 as deadline,
    case when o_orderpriority like '1%' then 'FOK' when o_orderpriority like '2%' then 'IOC' else 'GTC' end as tif, cast(o_custkey % 90 as decimal(26,10)) as queue_ahead from orders)"""


def plan(query, sql: str | None, exact: str = ""):
    """A query and its SQL twin; the columns named in ``exact`` are worked out in decimals and given as doubles."""
    names = exact.split()
    if not names:
        return query, sql

    def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("double") for c in names})

    return plain, sql and f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in names)}) from ({sql})"


def near(query, sql: str, columns: str, places: int = 7):
    """A query and its SQL twin; the doubles named in ``columns`` come from sums in no fixed order and are given to ``places``."""
    names = columns.split()
    # a double rounded through a decimal is the same in both engines; adding 0 makes -0 a 0
    rounded = lambda spark, sf_dir: (lambda df: df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in names}))(query(spark, sf_dir))
    return rounded, f"select * replace ({', '.join(f'round({c}, {places}) + 0.0::double as {c}' for c in names)}) from ({sql})"
