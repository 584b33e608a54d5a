"""The market projection of the driver's tables: one tape of quotes and trades a symbol, and level updates of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.sources.tables import table

#: The same projections for the SQL oracles, as the start of a WITH list.
EV_SQL = """with ev as (
  select event_id, cast(user_id % 4 as bigint) as symbol_id, epoch_us(ts) as local_ts_us,
    case when event_type in ('purchase','signup','error') then 1 else 0 end as is_trade,
    case event_type when 'purchase' then 1 when 'signup' then -1 else 0 end as side_code,
    1000 + (event_id * 31) % 37 as best_bid_tick,
    1000 + (event_id * 31) % 37 + 1 + (event_id % 3) as best_ask_tick,
    cast(1 + event_id % 9 as double) as bid_sz, cast(1 + event_id % 7 as double) as ask_sz,
    1000 + (event_id * 17) % 41 as price_tick, value as amount, event_type
  from events)"""
L2_SQL = """with l2 as (
  select local_ts_us, side, price_tick, max(amount) as amount from (
    select epoch_us(l_shipdate) as local_ts_us,
      case when l_orderkey % 2 = 0 then 'bid' else 'ask' end as side,
      case when l_orderkey % 2 = 0 then 900 + l_partkey % 90 else 1000 + l_partkey % 90 end as price_tick,
      case when l_linenumber = 1 then 0.0::double else l_quantity end as amount
    from lineitem) u group by local_ts_us, side, price_tick)"""


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes (is_trade 0) and trades (1) with one row an event."""
    e, kind = F.col("event_id"), F.col("event_type")
    bid = 1000 + (e * 31) % 37
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 4).cast("long").alias("symbol_id"),
        micros("ts").alias("local_ts_us"),
        F.when(kind.isin("purchase", "signup", "error"), 1).otherwise(0).alias("is_trade"),
        F.when(kind == "purchase", 1).when(kind == "signup", -1).otherwise(0).alias("side_code"),
        bid.alias("best_bid_tick"),
        (bid + 1 + e % 3).alias("best_ask_tick"),
        (1 + e % 9).cast("double").alias("bid_sz"),
        (1 + e % 7).cast("double").alias("ask_sz"),
        (1000 + (e * 17) % 41).alias("price_tick"),
        F.col("value").alias("amount"),
        "event_type",
    )


def l2_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level updates, one absolute size for each batch, side and level; size 0 deletes."""
    even = F.col("l_orderkey") % 2 == 0
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            micros("l_shipdate").alias("local_ts_us"),
            F.when(even, "bid").otherwise("ask").alias("side"),
            (F.when(even, 900).otherwise(1000) + F.col("l_partkey") % 90).alias("price_tick"),
            F.when(F.col("l_linenumber") == 1, F.lit(0.0)).otherwise(F.col("l_quantity")).alias("amount"),
        )
        .groupBy("local_ts_us", "side", "price_tick")
        .agg(F.max("amount").alias("amount"))
    )
