"""Scans, sinks and checks: operators 1 to 21, 28, 95, 171, 174 and 175."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tidebook.plans.common import r6, sql6
from tidebook.plans.registry import query
from tidebook.session import shared_dir
from tidebook.sources import tape
from tidebook.sources.market import EV_SQL, events
from tidebook.sources.tables import table


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_trades", f"""{EV_SQL} select event_id as source_row, local_ts_us, side_code, round_even(amount / 0.25, 0)::bigint + 1 as price_tick, {sql6("amount", "amount")} from ev where is_trade = 1""")
def csv_trades(spark, sf_dir):
    """Trades written as CSV under other names, read again with aliases, sides and ticks decoded: operators 1, 3 to 7 and 9."""
    ev = events(spark, sf_dir).where("is_trade = 1")
    path = _path(spark, "trades-csv")
    side = F.when(F.col("side_code") > 0, "buy").when(F.col("side_code") < 0, "sell").otherwise("unknown")
    ev.select(F.col("local_ts_us").alias("local_timestamp"), side.alias("side"), (F.col("amount") + 0.25).alias("price"), "amount", F.col("event_id").alias("raw_source_row"), F.lit("").alias("price_tick")).write.option("header", True).csv(path)
    kinds = {"local_timestamp": "bigint", "local_ts_us": "bigint", "side": "string", "price": "double", "amount": "double", "raw_source_row": "bigint", "price_tick": "bigint"}
    got = tape.with_source_rows(tape.read_csv(spark, path, kinds))
    return got.select("source_row", tape.first_alias(got, "local_ts_us").alias("local_ts_us"), tape.side_code(got).alias("side_code"), tape.price_ticks(got, 0.25).alias("price_tick"), r6("amount", "amount"))


@query("parquet_projection", "select event_id, value from events where event_id >= 100 and event_id < 200")
def parquet_projection(spark, sf_dir):
    """Two columns and a range of rows, both pushed to the scan: operators 2, 13 and 14."""
    return table(spark, sf_dir, "events").select("event_id", "value").where("event_id >= 100 and event_id < 200")


@query("tape_saved", f"{EV_SQL} select symbol_id, event_id, local_ts_us, is_trade, {sql6('amount', 'amount')} from ev")
def tape_saved(spark, sf_dir):
    """A table saved in order with a manifest, loaded with a full check: operators 10 to 12 and 15 to 19."""
    ev = events(spark, sf_dir).select("symbol_id", "event_id", "local_ts_us", "is_trade", "amount")
    path = _path(spark, "tape")
    tape.save_table(ev, path, "tape", ["local_ts_us", "event_id"])
    return tape.load_table(spark, path)[0].withColumn("amount", r6("amount"))


@query("manifest_summary", f"{EV_SQL} select count(*) as n_rows, min(local_ts_us) as first_ts, max(local_ts_us) as last_ts, 4 as n_columns from ev")
def manifest_summary(spark, sf_dir):
    """Operators 15 and 118."""
    body = tape.manifest(events(spark, sf_dir).select("symbol_id", "event_id", "local_ts_us", "is_trade"), "tape", ["local_ts_us", "event_id"])
    return spark.range(1).select(F.lit(body["rows"]).cast("long").alias("n_rows"), F.lit(body["first"][0]).cast("long").alias("first_ts"), F.lit(body["last"][0]).cast("long").alias("last_ts"), F.lit(len(body["schema"])).alias("n_columns"))


def _listed(name: str, tick: str | None, step: str, least: str | None, orders: list[str], kinds: list[str], contract: str = "PERPETUAL") -> dict:
    """A symbol as an exchange lists it; filters may lack."""
    filters = [{"filterType": "LOT_SIZE", "stepSize": step, "minQty": step, "maxQty": "2500"}]
    filters += [{"filterType": "PRICE_FILTER", "tickSize": tick, "minPrice": tick, "maxPrice": "90000"}] if tick else []
    filters += [{"filterType": "MIN_NOTIONAL", "notional": least}] if least else []
    return {"symbol": name, "baseAsset": name[:-4], "quoteAsset": "COIN", "marginAsset": "COIN", "contractType": contract, "status": "TRADING", "orderTypes": orders, "timeInForce": kinds, "filters": filters}


_INFO = json.dumps({"symbols": [
    _listed("TIDECOIN", "0.0005", "0.25", "12.5", ["MARKET", "LIMIT"], ["GTX", "GTC"]),
    _listed("EBBCOIN", "0.03", "2", None, ["LIMIT"], ["GTX"]),
    _listed("SURFCOIN", None, "0.004", "7", ["LIMIT"], ["GTC", "GTX"]),
    _listed("MOONCOIN", "0.01", "1", "9", ["MARKET"], ["GTX"]),
    _listed("REEFCOIN", "0.01", "1", "9", ["LIMIT"], ["GTC"]),
    _listed("KELPCOIN", "0.2", "1", "9", ["LIMIT"], ["GTX"], "NEXT_MONTH"),
]})


@query("exchange_rules", "select * from (values ('TIDECOIN', 0.0005::double, 0.25::double, 12.5::double), ('EBBCOIN', 0.03, 2, null), ('SURFCOIN', null, 0.004, 7)) t(symbol, tick_size, step_size, min_notional)")
def exchange_rules(spark, sf_dir):
    """Operators 20 and 171."""
    got = tape.exchange_rules(spark.range(1).select(F.lit(_INFO).alias("value")))
    return got.select("symbol", *(F.col(c).cast("double").alias(c) for c in ("tick_size", "step_size", "min_notional")))


@query("rule_compatibility", """with x as (select round(l_extendedprice, 2)::decimal(18,2) as p, l_quantity::decimal(18,2) as q from lineitem)
select 'price' as rule, count(*) as n_rows, coalesce(sum(case when p % 0.05 <> 0 then 1 else 0 end), 0)::bigint as n_off from x union all select 'qty', count(*), coalesce(sum(case when q % 2 <> 0 then 1 else 0 end), 0)::bigint from x""")
def rule_compatibility(spark, sf_dir):
    """Prices and quantities off the exchange's grid, in exact decimals: operators 117 and 175."""
    x = table(spark, sf_dir, "lineitem").select(F.round("l_extendedprice", 2).alias("p"), F.col("l_quantity").alias("q"))
    return tape.grid_violations(x, {"price": ("p", "0.05"), "qty": ("q", "2")})


@query("report_csv", f"{EV_SQL} select event_type, count(*) as n, {sql6('avg(amount)', 'mean')} from ev group by event_type")
def report_csv(spark, sf_dir):
    """A report written as CSV and read again: operator 21."""
    path = _path(spark, "report")
    got = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("amount").alias("mean"))
    got.write.option("header", True).csv(path)
    return tape.read_csv(spark, path, {"event_type": "string", "n": "bigint", "mean": "double"}).withColumn("mean", r6("mean"))


@query("dataset_audit", """select (o_orderkey % 3) as segment, count(*) as n_rows, count(*) filter (o_totalprice is null) as n_null, min(o_orderkey) as first_row, max(o_orderkey) as last_row, count(distinct o_orderkey) = count(*) as unique_rows from orders group by 1""")
def dataset_audit(spark, sf_dir):
    """Rows, nulls and key ranges of each segment: operator 174."""
    d = table(spark, sf_dir, "orders")
    return d.groupBy((F.col("o_orderkey") % 3).alias("segment")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_totalprice").isNull()).alias("n_null"), F.min("o_orderkey").alias("first_row"), F.max("o_orderkey").alias("last_row"), (F.count_distinct("o_orderkey") == F.count("*")).alias("unique_rows"))
