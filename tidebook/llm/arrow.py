"""Arrow plumbing of the per-document operators.

A *document function* gets the texts of some rows and returns new columns for the same rows, in order. ``map_rows``
keeps the other columns as they are, so a row never leaves its partition and nothing is shuffled.

Columns travel under plain names, so any name will do: one with dots, or one that a result also has. In the latter case
the result takes the name and the input's column goes by the same with ``_input`` behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.session import ship_package

#: Bytes of text, and rows, that a document function is given at once, unless one document alone has more.
CHUNK_BYTES, CHUNK_ROWS = 256_000, 1_000


def col(name: str) -> Column:
    """The column of exactly this name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def apart(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with ``_input`` behind it as often as it takes to differ from all that are taken."""
    used = {x.lower() for x in taken}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_input"
        used.add(n.lower())
        out.append(n)
    return out


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def texts_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each starts (one entry more than texts). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text each, or one row."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, done = 0, 0
    while start < n:
        stop = min(max(start + 1, int(np.searchsorted(ends, done + most, side="right"))), start + CHUNK_ROWS)
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def map_rows(df: DataFrame, text: str, keep: list[str], make: Callable[[], Callable[[pa.RecordBatch], dict]], fields: list[T.StructField], most: int = CHUNK_BYTES) -> DataFrame:
    """``keep`` columns of ``df`` and the columns that the document function returns, row by row.

    ``make`` runs once in each task and returns the document function, so that costly set-up (tokenizers, models)
    is paid once a task.
    """
    ship_package(df.sparkSession)
    read = list(dict.fromkeys([*keep, text]))
    names = [*apart(keep, [f.name for f in fields]), *(f.name for f in fields)]
    out = T.StructType([T.StructField(f"k{i}", f.dataType, f.nullable) for i, f in enumerate([*(df.schema[c] for c in keep), *fields])])
    arrow = to_arrow_schema(out, timezone="UTC") if any(isinstance(f.dataType, T.TimestampType) for f in out.fields) else to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in chunks(batch.rename_columns(read), text, most):
                work = work or make()
                got = work(part)
                columns = [*(part.column(c) for c in keep), *(got[f.name] for f in fields)]
                typed = [pa.array(x, t) if not isinstance(x, pa.Array) else x if x.type == t else x.cast(t) for x, t in zip(columns, arrow.types, strict=True)]
                yield pa.RecordBatch.from_arrays(typed, schema=arrow)

    return df.select(*(col(c).alias(f"c{i}") for i, c in enumerate(read))).mapInArrow(run, out).toDF(*names)


def map_out(df: DataFrame, text: str, read: list[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], out: T.StructType, most: int = CHUNK_BYTES) -> DataFrame:
    """Like ``map_rows``, but the function returns a batch of any number of rows with the columns of ``out``."""
    ship_package(df.sparkSession)
    read = list(dict.fromkeys([*read, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in chunks(batch.rename_columns(read), text, most):
                work = work or make()
                if (got := work(part)) is not None and got.num_rows:
                    yield got

    return df.select(*(col(c).alias(f"c{i}") for i, c in enumerate(read))).mapInArrow(run, out)
