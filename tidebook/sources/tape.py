"""Sources and sinks of the tape: CSV with aliases, checks, ordered Parquet tables with manifests, exchange rules."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.kernels import to_tick
from tidebook.session import written

#: The names that a column may have in files, in the order in which they count.
ALIASES = {
    "local_ts_us": ("local_ts_us", "local_timestamp"),
    "ts_us": ("ts_us", "timestamp"),
    "source_row": ("raw_source_row", "source_row"),
}


def read_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV files with a header as columns of the given names and types; a column that a file lacks is null.

    Columns are found by each file's own header, so files may order them as they like: those of one header are read
    together. Headers are read by the driver, a line a file. Types are decoded strictly.
    """
    plain = spark.read.option("header", True)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for f in sorted(plain.csv(path).inputFiles()):
        by_header.setdefault(tuple(plain.csv(f).columns), []).append(f)
    parts = []
    for header, files in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        found = plain.option("mode", "FAILFAST").schema(schema).csv(files)
        parts.append(found.select(*((F.col(f"`{c}`") if c in header else F.lit(None).cast("string")).alias(c) for c in columns)))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns])).select(*(decode(F.col(c), t).alias(c) for c, t in columns.items()))
    return union_sources(parts).select(*(decode(F.col(c), t).alias(c) for c, t in columns.items()))


def decode(text: Column, kind: str) -> Column:
    """A number, or a boolean, from text: empty text is null, and what isn't of the kind is an error."""
    trimmed = F.nullif(F.trim(text), F.lit(""))
    if kind == "string":
        return trimmed
    if kind == "boolean":
        low = F.lower(trimmed)
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).when(low.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), low)))
    value = trimmed.try_cast(kind)
    return F.when(trimmed.isNull(), F.lit(None)).when(value.isNull(), F.raise_error(F.concat(F.lit(f"not a {kind}: "), trimmed)).cast(kind)).otherwise(value)


def first_alias(df: DataFrame, name: str, required: bool = True) -> Column:
    """The first alias with a value in each row; an error in rows without any, if the column is required."""
    present = [F.col(f"`{a}`") for a in ALIASES[name] if a in df.columns]
    if not present:
        if required:
            raise ValueError(f"no column for {name}: one of {', '.join(ALIASES[name])} is needed")
        return F.lit(None)
    value = F.coalesce(*present)
    return F.when(value.isNull(), F.raise_error(F.lit(f"a row has no {name}"))).otherwise(value) if required else value


def side_code(df: DataFrame) -> Column:
    """1 for buys, -1 for sells, 0 for unknown, from a code where there is one, else from the side's name."""
    code = F.col("side_code") if "side_code" in df.columns else F.lit(None)
    name = F.lower("side") if "side" in df.columns else F.lit(None).cast("string")
    return F.coalesce(code.cast("int"), F.when(name == "buy", 1).when(name == "sell", -1).when(name.isin("unknown", ""), 0))


def price_ticks(df: DataFrame, tick_size: float) -> Column:
    """The tick given in the file, else that of the price; at least 1."""
    given = F.col("price_tick").cast("long") if "price_tick" in df.columns else F.lit(None).cast("long")
    tick = F.coalesce(given, to_tick("price", tick_size))
    return F.when(tick >= 1, tick).otherwise(F.raise_error(F.lit("a price is below one tick")).cast("long"))


def with_source_rows(df: DataFrame) -> DataFrame:
    """``df`` with a source row id: as given, else a contiguous number from 0 in the order of files by name and of rows in them.

    ``df`` comes from files. A row's place is its file, its block there and its position in the block; blocks are counted,
    and each starts where those before it end.
    """
    given = first_alias(df, "source_row", False).cast("long")
    if not any(a in df.columns for a in ALIASES["source_row"]):
        laid = written(df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at")), "source-rows")
        blocks = laid.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
        before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
        starts = blocks.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
        return laid.join(F.broadcast(starts), ["__file", "__block"]).withColumn("source_row", F.col("__start") + F.col("__at") - F.col("__first")).drop("__file", "__block", "__at", "__first", "__start")
    return df.withColumn("source_row", given)


def write_ordered(df: DataFrame, path: str, order: list[str], rows_per_file: int = 131_072) -> None:
    """A Parquet table in ranges of the order, sorted, so that readers prune files by their least and largest keys."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(path)


def content_hash(df: DataFrame, columns: list[str] | None = None) -> str:
    """A digest of all rows that doesn't depend on their order: sums of two independent hashes, and the schema."""
    names = columns or df.columns
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(2**31 - 1)).cast("long"))
    row = df.agg(F.count("*").alias("n"), part(1).alias("a"), part(2).alias("b")).first()
    schema = json.dumps([[n, df.schema[n].dataType.simpleString()] for n in names])
    return hashlib.sha256(json.dumps([row["n"], row["a"], row["b"], schema]).encode()).hexdigest()


def canonical_json(payload) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), allow_nan=False)


def manifest(df: DataFrame, name: str, key: list[str], **more) -> dict:
    """What a reader checks a table by: rows, first and last key, schema and content, with the manifest's own hash."""
    row = df.agg(F.count("*").alias("n"), F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).first()
    body = {"name": name, "rows": row["n"], "first": list(row["lo"]) if row["lo"] else None, "last": list(row["hi"]) if row["hi"] else None, "schema": [[f.name, f.dataType.simpleString()] for f in df.schema], "content": content_hash(df), **more}
    return body | {"sha256": hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text beside a table, through the cluster's file system."""
    spark.range(1).coalesce(1).select(F.lit(text).alias("value")).write.mode("errorifexists").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def save_table(df: DataFrame, path: str, name: str, key: list[str], **more) -> dict:
    """A table and its manifest; the manifest comes last, so that a table without one isn't complete."""
    write_ordered(df, f"{path}/rows", key)
    body = manifest(df.sparkSession.read.parquet(f"{path}/rows"), name, key, **more)
    write_text(df.sparkSession, f"{path}/manifest", canonical_json(body))
    return body


def load_table(spark: SparkSession, path: str, full: bool = True) -> tuple[DataFrame, dict]:
    """A table with its manifest, checked by its schema, or in full by its content."""
    body = json.loads(read_text(spark, f"{path}/manifest"))
    own = hashlib.sha256(canonical_json({k: v for k, v in body.items() if k != "sha256"}).encode()).hexdigest()
    df = spark.read.parquet(f"{path}/rows")
    if own != body["sha256"] or [[f.name, f.dataType.simpleString()] for f in df.schema] != body["schema"]:
        raise ValueError(f"the manifest of {path} doesn't fit the table")
    if full and content_hash(df) != body["content"]:
        raise ValueError(f"the rows of {path} have changed")
    return df, body


_FILTER = T.StructType([T.StructField(n, T.StringType()) for n in ("filterType", "tickSize", "minPrice", "maxPrice", "stepSize", "minQty", "maxQty", "notional")])
EXCHANGE_INFO = T.StructType([T.StructField("symbols", T.ArrayType(T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("symbol", "baseAsset", "quoteAsset", "marginAsset", "contractType", "status")),
    T.StructField("orderTypes", T.ArrayType(T.StringType())), T.StructField("timeInForce", T.ArrayType(T.StringType())), T.StructField("filters", T.ArrayType(_FILTER)),
])))])


def exchange_rules(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Rules of each tradable perpetual symbol in exchange-information payloads, numbers as exact decimals.

    Symbols must be perpetual and take post-only limit orders (LIMIT with GTX).
    """
    s = payloads.select(F.explode(F.from_json(column, EXCHANGE_INFO)["symbols"]).alias("s")).select("s.*")
    s = s.where((F.col("contractType") == "PERPETUAL") & F.array_contains("orderTypes", "LIMIT") & F.array_contains("timeInForce", "GTX"))
    pick = lambda kind, name: F.get(F.filter("filters", lambda f: f["filterType"] == kind), F.lit(0))[name].cast("decimal(38,18)")
    return s.select(
        "symbol", "status", "baseAsset", "quoteAsset", "marginAsset",
        pick("PRICE_FILTER", "tickSize").alias("tick_size"), pick("PRICE_FILTER", "minPrice").alias("min_price"), pick("PRICE_FILTER", "maxPrice").alias("max_price"),
        pick("LOT_SIZE", "stepSize").alias("step_size"), pick("LOT_SIZE", "minQty").alias("min_qty"), pick("LOT_SIZE", "maxQty").alias("max_qty"),
        pick("MIN_NOTIONAL", "notional").alias("min_notional"),
    )


def grid_violations(df: DataFrame, checks: dict[str, tuple[str, str]]) -> DataFrame:
    """(rule, n_rows, n_off) for each rule of (column, step): rows whose exact decimal isn't a whole number of steps."""
    counts = [F.sum(F.when(F.col(c).cast("decimal(38,18)") % F.lit(step).cast("decimal(38,18)") != 0, 1).otherwise(0)).cast("long").alias(f"o_{r}") for r, (c, step) in checks.items()]
    row = df.agg(F.count("*").alias("n"), *counts)
    return row.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col("n").alias("n_rows"), F.col(f"o_{r}").alias("n_off")) for r in checks))).alias("x")).select("x.*")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
