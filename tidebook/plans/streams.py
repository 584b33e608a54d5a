"""Streams that are run to their end over the driver's tables: section 2.11 and operator 126."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidebook.operators import folds
from tidebook.plans import flows, labels
from tidebook.plans.common import H12, r6
from tidebook.plans.registry import oracle_sql, query
from tidebook.session import shared_dir
from tidebook.sources.market import EV_SQL, events
from tidebook.streaming.folds import stream_fold

_GRID_SQL = oracle_sql()["decision_grid"]
_LABELS = oracle_sql()["label_forward_returns"]


@query("label_maturation", f"select event_id, symbol_id, local_ts_us, {', '.join(f'ret_{h}_bps' for h in labels.HORIZONS)} from ({_LABELS}) t where ret_24h_bps is not null")
def label_maturation(spark, sf_dir):
    """Labels given out as they mature are the batch's labels that are complete: operator 126."""
    decided = labels.decisions(spark, sf_dir).select("event_id", F.lit(True).alias("decides"))
    q = labels.quotes(spark, sf_dir).join(decided, "event_id", "left").withColumn("decides", F.coalesce("decides", F.lit(False)))
    got = folds.matured_labels(q, ["symbol_id"], labels.DELAY, labels.HORIZONS)
    return got.select("event_id", "symbol_id", "local_ts_us", *(r6(f"ret_{h}_bps", f"ret_{h}_bps") for h in labels.HORIZONS))


def _replayed(spark, df, name: str, parts: int = 3):
    """A stream that gets the rows in as many micro-batches as there are parts of time."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    span = df.agg(F.min("local_ts_us"), F.max("local_ts_us")).first()
    cuts = [span[0] + (span[1] - span[0]) * i // parts for i in range(parts)] + [span[1] + 1]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        df.where(F.col("local_ts_us").between(a, b - 1)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(spark, stream, name: str):
    """The rows that a stream gives until its source is read to the end."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("stream_decision_grid", _GRID_SQL)
def stream_decision_grid(spark, sf_dir):
    """The scheduler over a stream gives the batch's grid."""
    tape = _replayed(spark, events(spark, sf_dir), "stream-tape")
    out = stream_fold(tape, flows.BY, ["local_ts_us", "is_trade", "event_id"], lambda: folds.Scheduler(0, 2**62), folds.GRID)
    return _drained(spark, out, "stream-grid")


@query("stream_windows", f"""{EV_SQL} select symbol_id, (local_ts_us // {H12}) * {H12} as window_start, count(*) as n from ev group by 1, 2
having (local_ts_us // {H12}) * {H12} + {H12} <= (select max(local_ts_us) from ev)""")
def stream_windows(spark, sf_dir):
    """Tumbling windows with a watermark: a window is given out once time has passed its end."""
    ev = events(spark, sf_dir).select("symbol_id", "local_ts_us").orderBy("local_ts_us")
    tape = _replayed(spark, ev, "stream-events").withColumn("at", F.timestamp_micros("local_ts_us")).withWatermark("at", "0 seconds")
    out = tape.groupBy("symbol_id", F.window("at", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return _drained(spark, out.select("symbol_id", F.unix_micros("w.start").alias("window_start"), "n"), "stream-windows")
