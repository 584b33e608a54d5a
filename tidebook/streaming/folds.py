"""The batch folds as stateful stream operators: the same state machines, with their state in the state store.

Within a micro-batch a key's rows are sorted; across micro-batches time must not fall, and a row that comes late is an error,
as it is in batch. Watermarked windows and joins use Spark's own operators and need nothing here.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidebook.session import ship_package

_STATE = T.StructType([T.StructField("machine", T.BinaryType()), T.StructField("last", T.BinaryType())])
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """Steps a machine over each key's rows and keeps it between micro-batches."""

    def __init__(self, by: list[str], order: list[str], make: Callable[[], object], names: list[str]):
        self.by, self.order, self.make, self.names = by, order, make, names

    def init(self, handle) -> None:
        self.state = handle.getValueState("fold", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        machine, last = self.make(), None
        if self.state.exists():
            kept = self.state.get()
            machine, last = pickle.loads(kept[0]), pickle.loads(kept[1])
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        found = []
        for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
            at = tuple(row[c] for c in self.order)
            if last is not None and at < last:
                raise ValueError(f"a row at {at} comes after {last}")
            last = at
            found.extend({**dict(zip(self.by, key, strict=True)), **r} for r in machine.step(row))
        self.state.update((pickle.dumps(machine), pickle.dumps(last)))
        yield pd.DataFrame(found, columns=self.names)

    def close(self) -> None:
        pass


def stream_fold(stream: DataFrame, by: list[str], order: list[str], make: Callable[[], object], out: T.StructType) -> DataFrame:
    """What ``make()``'s machine emits over each key of a stream, in append mode; the session's state store becomes RocksDB."""
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = T.StructType([*(stream.schema[c] for c in by), *out.fields])
    return stream.groupBy(*by).transformWithStateInPandas(FoldProcessor(by, order, make, schema.names), schema, "append", "none")
