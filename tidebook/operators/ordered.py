"""Operators on ordered streams that stay parallel however few symbols there are.

A symbol's tape is cut into slices of time. Windows with a bounded look-back run inside a slice, to which the rows of the
look-back before it are copied; running values (as-of, cumulative sums) run inside a slice and take what came before it
from a table with one row for each symbol and slice. So no task holds a whole symbol, and the shuffle moves each row once,
or twice near the edge of a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a slice, unless a caller knows better.
SLICE_US = 86_400_000_000


def key2(ts: str = "local_ts_us", is_trade: str = "is_trade") -> Column:
    """Order of events at one timestamp: quotes before trades. A frame over it never sees what comes later."""
    return 2 * F.col(ts) + F.col(is_trade)


def slice_of(ts: str, slice_us: int = SLICE_US) -> Column:
    return F.floor(F.col(ts) / slice_us).cast("long")


def with_lookback(df: DataFrame, ts: str, lookback_us: int, slice_us: int = SLICE_US) -> DataFrame:
    """``df`` with ``__slice`` and ``__own``: each row in its slice, and again in those later ones that look back to it."""
    reach = F.sequence(slice_of(ts, slice_us), F.floor((F.col(ts) + lookback_us) / slice_us).cast("long"))
    return df.withColumn("__slice", F.explode(reach)).withColumn("__own", F.col("__slice") == slice_of(ts, slice_us))


class Frames:
    """Look-back frames of a slice, as columns that cost the same whatever the frames hold.

    Every frame is the difference of two that only grow: all rows up to the current one, and all rows before the frame
    begins. Both are kept up to date row by row. A frame of ``us`` has both its ends and, at its later end, all rows of
    the same order; ``tie`` orders these.
    """

    def __init__(self, by: list[str], tie: str):
        self.base = Window.partitionBy(*by, "__slice").orderBy("__order")
        self.rows = Window.partitionBy(*by, "__slice").orderBy("__order", tie)
        self.back = Window.partitionBy(*by, "__slice").orderBy(F.desc("__order"), F.desc(tie))
        self.key = F.struct("__order", tie)
        self.by = by
        self.upto = self.base.rangeBetween(Window.unboundedPreceding, 0)

    def before(self, us: int):
        return self.base.rangeBetween(Window.unboundedPreceding, -2 * us - 1)

    def count(self, condition: Column, us: int) -> Column:
        one = F.when(condition, 1).otherwise(0)
        return F.sum(one).over(self.upto) - F.coalesce(F.sum(one).over(self.before(us)), F.lit(0))

    def total(self, value: Column | str, us: int) -> Column:
        """The sum of a frame, nulls left out: exactly 0 where it has nothing but zeros, whatever came before it."""
        value = F.col(value) if isinstance(value, str) else value
        value = F.coalesce(value.cast("double"), F.lit(0.0))
        whole = F.sum(value).over(self.upto) - F.coalesce(F.sum(value).over(self.before(us)), F.lit(0.0))
        return F.when(self.count(value != 0, us) > 0, whole).otherwise(F.lit(0.0))

    def first(self, us: int) -> Column:
        """What ``carried`` named, at the first row of a frame: the row behind the last one before it."""
        return F.coalesce(F.max_by("__next", self.key).over(self.before(us)), F.col("__head"))

    def last(self, value: Column | str) -> Column:
        """The value at the last row of a frame."""
        return F.max_by(value, self.key).over(self.upto)

    def block(self, us: int) -> Column:
        """Numbers stretches as long as a frame: a frame that ends in one begins in it or in the one before."""
        return F.floor(F.col("__order") / (2 * us + 1)).cast("long")

    def in_block(self, block: str, falling: bool = False):
        """All rows of the same stretch up to the current one, or from it on."""
        return Window.partitionBy(*self.by, "__slice", block).orderBy(F.desc("__order") if falling else "__order")


def range_features(df: DataFrame, by: list[str], ts: str, order: Column, lookback_us: int, make, slice_us: int = SLICE_US, tie: str = "event_id", prepare=None, carried: list[str] | None = None) -> DataFrame:
    """``df`` with columns over bounded look-back frames.

    ``make`` gets the ``Frames``, in the order of ``order`` (twice the timestamp, plus what ranks events at one timestamp),
    and returns the new columns by name. ``prepare`` may first add columns to the laid out rows; ``carried`` names those
    that ``Frames.first`` looks up.
    """
    laid = with_lookback(df, ts, lookback_us, slice_us).withColumn("__order", order)
    frames = Frames(by, tie)
    if prepare:
        laid = prepare(laid, frames)
    if carried:
        laid = laid.withColumns({"__next": F.lead(F.struct(*carried)).over(frames.rows), "__head": F.first(F.struct(*carried)).over(frames.rows)})
    return laid.withColumns(make(frames)).where("__own").drop("__slice", "__own", "__order", "__next", "__head")


def _carried(rows: DataFrame, slices: DataFrame, by: list[str], value: Column, order: Column) -> DataFrame:
    """The last value before each slice: one row for each symbol and slice."""
    last = rows.groupBy(*by, "__slice").agg(F.max_by(value, order).alias("__last"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.join(last, [*by, "__slice"], "left").withColumn("__before", F.last("__last", ignorenulls=True).over(before)).select(*by, "__slice", "__before")


def asof_join(probes: DataFrame, facts: DataFrame, by: list[str], probe_key: tuple[str, str], fact_key: tuple[str, str], values: list[str], slice_us: int = SLICE_US) -> DataFrame:
    """Each probe with the values of the latest fact whose (timestamp, sequence) is at most the probe's.

    Keys are pairs of columns, compared in order. Facts that tie with a probe count. Values are null before the first fact.
    """
    (pt, ps), (ft, fs) = probe_key, fact_key
    value = F.struct(*values)
    left = probes.select(*by, F.col(pt).alias("__t"), F.col(ps).alias("__s"), F.lit(1).alias("__kind"), F.struct("*").alias("__row"), F.lit(None).cast(facts.select(value.alias("v")).schema["v"].dataType).alias("__v"))
    right = facts.select(*by, F.col(ft).alias("__t"), F.col(fs).alias("__s"), F.lit(0).alias("__kind"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), value.alias("__v"))
    both = left.unionByName(right).withColumn("__slice", slice_of("__t", slice_us))
    so_far = Window.partitionBy(*by, "__slice").orderBy("__t", "__s", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__found", F.last("__v", ignorenulls=True).over(so_far)).where("__kind = 1")
    slices = both.select(*by, "__slice").distinct()
    carry = _carried(right.withColumn("__slice", slice_of("__t", slice_us)), slices, by, F.col("__v"), F.struct("__t", "__s"))
    found = inside.join(carry, [*by, "__slice"], "left").withColumn("__found", F.coalesce("__found", "__before"))
    return found.select("__row.*", *(F.col(f"__found.{v}").alias(v) for v in values))


def at_or_after(probes: DataFrame, facts: DataFrame, by: list[str], probe_key: tuple[str, str], fact_key: tuple[str, str], value: str, name: str, slice_us: int = SLICE_US) -> DataFrame:
    """Each probe with the fact at its timestamp, if one has a sequence up to the probe's (the last such), else the first later one.

    Facts of the probe's own timestamp that all come after it are passed over; of a later timestamp the first fact is taken.
    """
    (pt, ps), (ft, fs) = probe_key, fact_key
    opening = facts.groupBy(*by, F.col(ft).alias("__ft")).agg(F.min_by(value, F.struct(fs, value)).alias("__open"))
    kind = opening.schema["__open"].dataType
    left = probes.select(*by, F.col(pt).alias("__t"), F.lit(0).alias("__kind"), F.struct("*").alias("__row"), F.lit(None).cast(kind).alias("__v"))
    right = opening.select(*by, F.col("__ft").alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col("__open").alias("__v"))
    both = left.unionByName(right).withColumn("__slice", -slice_of("__t", slice_us))
    # in falling time, a probe comes after all later facts; those at its own timestamp are settled by sequence below
    so_far = Window.partitionBy(*by, "__slice").orderBy(F.desc("__t"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__later", F.last("__v", ignorenulls=True).over(so_far)).where("__kind = 0")
    slices = both.select(*by, "__slice").distinct()
    carry = _carried(right.withColumn("__slice", -slice_of("__t", slice_us)), slices, by, F.col("__v"), -F.col("__t"))
    later = inside.join(carry, [*by, "__slice"], "left").select("__row.*", F.coalesce("__later", "__before").alias("__later"))
    exact = facts.select(*(F.col(b).alias(f"__{b}") for b in by), F.col(ft).alias("__ft"), F.col(fs).alias("__fs"), F.col(value).alias("__fv"))
    same = (F.col(pt) == F.col("__ft")) & (F.col("__fs") <= F.col(ps))
    for b in by:
        same &= F.col(b) == F.col(f"__{b}")
    columns = [*probes.columns, "__later"]
    tied = later.join(exact, same, "left").groupBy(*columns).agg(F.max_by("__fv", F.struct("__fs", "__fv")).alias("__exact"))
    return tied.select(*probes.columns, F.coalesce("__exact", "__later").alias(name))


def first_from(probes: DataFrame, facts: DataFrame, by: list[str], probe_ts: str, fact_key: tuple[str, str], value: str, name: str, slice_us: int = SLICE_US) -> DataFrame:
    """Each probe with the first fact whose timestamp is at least the probe's, by the facts' (timestamp, sequence); null after the last."""
    ft, fs = fact_key
    opening = facts.groupBy(*by, F.col(ft).alias("__t")).agg(F.min_by(value, F.struct(fs, value)).alias("__v"))
    left = probes.select(*by, F.col(probe_ts).alias("__t"), F.lit(1).alias("__kind"), F.struct("*").alias("__row"), F.lit(None).cast(opening.schema["__v"].dataType).alias("__v"))
    right = opening.select(*by, "__t", F.lit(0).alias("__kind"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), "__v")
    both = left.unionByName(right).withColumn("__slice", -slice_of("__t", slice_us))
    so_far = Window.partitionBy(*by, "__slice").orderBy(F.desc("__t"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__later", F.last("__v", ignorenulls=True).over(so_far)).where("__kind = 1")
    slices = both.select(*by, "__slice").distinct()
    carry = _carried(right.withColumn("__slice", -slice_of("__t", slice_us)), slices, by, F.col("__v"), -F.col("__t"))
    return inside.join(carry, [*by, "__slice"], "left").select("__row.*", F.coalesce("__later", "__before").alias(name))


def running_sum(df: DataFrame, by: list[str], ts: str, order: list[str], value: Column, name: str, slice_us: int = SLICE_US) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, in the order of ``ts`` and then ``order``."""
    laid = df.withColumn("__slice", slice_of(ts, slice_us)).withColumn("__value", value)
    inside = Window.partitionBy(*by, "__slice").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    sums = laid.groupBy(*by, "__slice").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    out = laid.withColumn("__inside", F.sum("__value").over(inside)).join(offset, [*by, "__slice"])
    return out.withColumn(name, F.col("__inside") + F.col("__offset")).drop("__slice", "__value", "__inside", "__offset")


def merge_streams(quotes: DataFrame, trades: DataFrame, by: list[str], ts: str, seq: str, trades_first: bool = False, slice_us: int = SLICE_US) -> DataFrame:
    """Both streams in one order with a contiguous ``event_seq`` from 0; at one timestamp the tie policy decides."""
    first, second = (trades, quotes) if trades_first else (quotes, trades)
    both = first.withColumn("__rank", F.lit(0)).unionByName(second.withColumn("__rank", F.lit(1)), allowMissingColumns=True)
    out = running_sum(both, by, ts, ["__rank", seq], F.lit(1), "__n", slice_us)
    return out.withColumn("event_seq", F.col("__n") - 1).drop("__n", "__rank")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], lo: str, hi: str, ts: str, bucket_us: int) -> DataFrame:
    """Pairs with ``lo < ts <= hi``: an equal join on the symbol and buckets of time, then the exact range.

    A left row is copied to each bucket that its interval meets, a right row stands in one, so no pair comes twice.
    """
    at = F.sequence(F.floor(F.col(lo) / bucket_us).cast("long"), F.floor(F.col(hi) / bucket_us).cast("long"))
    spread = left.where(F.col(lo) < F.col(hi)).withColumn("__bucket", F.explode(at))
    dealt = right.withColumn("__bucket", F.floor(F.col(ts) / bucket_us).cast("long"))
    return spread.join(dealt, [*by, "__bucket"]).where((F.col(ts) > F.col(lo)) & (F.col(ts) <= F.col(hi))).drop("__bucket")


def average_rank(order: list[Column], partition: list[str] | None = None) -> Column:
    """1-based ranks where ties get the mean of theirs."""
    over = Window.partitionBy(*(partition or [])) if partition else Window.partitionBy()
    ties = Window.partitionBy(*(partition or []), *order)
    return F.rank().over(over.orderBy(*order)) + (F.count("*").over(ties) - 1) / 2


def order_violations(df: DataFrame, by: list[str], key: list[str], strict: bool, arrival: str) -> DataFrame:
    """(rows, violations) a symbol: rows whose key falls, or with ``strict`` doesn't rise, in the order of arrival."""
    w = Window.partitionBy(*by).orderBy(arrival)
    now, before = F.struct(*key), F.lag(F.struct(*key)).over(w)
    bad = (now <= before) if strict else (now < before)
    return df.withColumn("__bad", F.coalesce(bad, F.lit(False)).cast("int")).groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum("__bad").cast("long").alias("n_violations"))


def previous(df: DataFrame, by: list[str], ts: str, order: list[str], values: list[str], prefix: str = "prev_", slice_us: int = SLICE_US) -> DataFrame:
    """``df`` with the values of the row before, null in the first row of a symbol."""
    laid = df.withColumn("__slice", slice_of(ts, slice_us)).withColumn("__v", F.struct(*values))
    inside = Window.partitionBy(*by, "__slice").orderBy(ts, *order)
    carry = _carried(laid, laid.select(*by, "__slice").distinct(), by, F.col("__v"), F.struct(ts, *order))
    out = laid.withColumn("__lag", F.lag("__v").over(inside)).join(carry, [*by, "__slice"])
    out = out.withColumn("__lag", F.coalesce("__lag", "__before"))
    return out.select(*df.columns, *(F.col(f"__lag.{v}").alias(prefix + v) for v in values))


def last_where(df: DataFrame, by: list[str], ts: str, order: list[str], values: dict[str, Column], slice_us: int = SLICE_US) -> DataFrame:
    """``df`` with running last non-null values, each row included."""
    laid = df.withColumn("__slice", slice_of(ts, slice_us)).withColumns({f"__{k}": v for k, v in values.items()})
    inside = Window.partitionBy(*by, "__slice").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct(ts, *order)
    last = laid.groupBy(*by, "__slice").agg(*(F.max_by(f"__{k}", F.when(F.col(f"__{k}").isNotNull(), key)).alias(f"__l_{k}") for k in values))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*by, "__slice", *(F.last(f"__l_{k}", ignorenulls=True).over(before).alias(f"__b_{k}") for k in values))
    out = laid.withColumns({f"__f_{k}": F.last(f"__{k}", ignorenulls=True).over(inside) for k in values}).join(carry, [*by, "__slice"])
    return out.select(*df.columns, *(F.coalesce(f"__f_{k}", f"__b_{k}").alias(k) for k in values))
