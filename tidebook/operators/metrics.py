"""Statistics, rank metrics and audits as aggregates: map-side partial sums first, one small row a group at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.kernels import c, safe_divide
from tidebook.operators.ordered import SLICE_US  # noqa: F401
from tidebook.session import written


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample variance, least and largest of the values that aren't null."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.min(value).alias("least"), F.max(value).alias("most"))


def running_mean_std(df: DataFrame, by: list[str], value: str, prior: float = 1e-4) -> DataFrame:
    """Mean and population variance after a prior of so many observations with mean 0 and variance 1."""
    got = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = F.col("n") + prior
    mean = F.col("m") * F.col("n") / total
    second = prior * 1.0 + F.col("v") * F.col("n") + F.col("m") * F.col("m") * prior * F.col("n") / total
    return got.select(*by, total.alias("count"), mean.alias("mean"), (second / total).alias("variance"))


def correlations(df: DataFrame, columns: list[str], floor: float = 1e-8) -> DataFrame:
    """(a, b, corr) of all pairs in one pass; null where either deviation is below the floor."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = [F.corr(a, b).alias(f"c_{a}_{b}") for a, b in pairs] + [F.stddev_samp(a).alias(f"s_{a}") for a in columns]
    row = df.agg(*sums)
    cell = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when((F.col(f"s_{a}") > floor) & (F.col(f"s_{b}") > floor), F.lit(1.0) if a == b else F.col(f"c_{a}_{b}")).alias("corr"))
    return row.select(F.explode(F.array(*(cell(a, b) for a, b in pairs))).alias("p")).select("p.*")


def gram(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(i, j, value) of X'X with an intercept, and of X'y with j = -1, over rows without nulls: one pass of sums."""
    ok = c(y).isNotNull()
    for x in xs:
        ok &= c(x).isNotNull()
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    cells = [(i, j, cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))] + [(i, -1, cols[i] * F.col(y)) for i in range(len(cols))]
    row = df.where(ok).agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(f"g{n}") for n, (_, _, v) in enumerate(cells)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{n}").alias("value")) for n, (i, j, _) in enumerate(cells)))).alias("g")).select("g.*")


def ridge(df: DataFrame, xs: list[str], y: str, l2: float = 1e-4, least_rows: int = 2) -> dict | None:
    """Coefficients of a ridge regression on columns scaled by their population deviation, the intercept free of penalty.

    The sums come from one aggregate; the driver solves a system as large as the number of columns.
    """
    import numpy as np

    cells = {(r["i"], r["j"]): r["value"] for r in gram(df, xs, y).collect()}
    k = len(xs) + 1
    n = cells[0, 0]
    if n < least_rows:
        return None
    mean = np.array([cells[0, i] / n for i in range(1, k)])
    var = np.array([cells[i, i] / n for i in range(1, k)]) - mean**2
    std = np.where(np.sqrt(np.maximum(var, 0)) <= 1e-12, 1.0, np.sqrt(np.maximum(var, 0)))
    full = np.array([[cells[min(i, j), max(i, j)] for j in range(k)] for i in range(k)])
    right = np.array([cells[i, -1] for i in range(k)])
    scale = np.eye(k)
    scale[1:, 1:] = np.diag(1 / std)
    scale[0, 1:] = -mean / std
    a = scale.T @ full @ scale + l2 * np.diag([0.0] + [1.0] * (k - 1))
    try:
        w = np.linalg.solve(a, scale.T @ right)
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(a, scale.T @ right, rcond=None)[0]
    return {"n": int(n), "mean": mean.tolist(), "std": std.tolist(), "intercept": float(w[0]), "weights": w[1:].tolist()}


def linear_score(weights: list[float], intercept: float, columns: list[Column]) -> Column:
    """A linear head as one expression: a sum of products, in generated code."""
    total = F.lit(float(intercept))
    for w, x in zip(weights, columns, strict=True):
        total = total + F.lit(float(w)) * x
    return total


def histogram_auc(df: DataFrame, by: list[str], y: str, score: str, bins: int) -> DataFrame:
    """Area under the ROC curve from a histogram of scores: ties within a bin count half."""
    span = df.groupBy(*by).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    joined = df.join(F.broadcast(span), by) if by else df.crossJoin(F.broadcast(span))
    counts = joined.groupBy(*by, at.cast("int").alias("bin")).agg(F.sum(c(y)).alias("pos"), F.sum(1 - c(y)).alias("neg"))
    before = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    part = counts.withColumn("area", F.col("pos") * (F.coalesce(F.sum("neg").over(before), F.lit(0)) + 0.5 * F.col("neg")))
    return part.groupBy(*by).agg(safe_divide(F.sum("area"), F.sum("pos") * F.sum("neg"), float("nan")).alias("auc"))


def value_slices(distinct: DataFrame, value: str, slices: int = 64) -> Column:
    """The slice of a value, in order, so that slices of the distinct values are about as large as one another, however the values lie.

    The bounds, ``slices`` less one at most, come from a sketch and are constants of the plan: every task that runs again cuts alike.
    """
    found = distinct.agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], 10_000)).first()[0]
    bounds = list(dict.fromkeys(found or []))
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(value))) if bounds else F.lit(0)


def sums_below(distinct: DataFrame, value: str, amount: str, name: str) -> DataFrame:
    """``distinct`` with the sum of ``amount`` over all smaller values: by slices, with one small row a slice broadcast."""
    cut = distinct.withColumn("__slice", value_slices(distinct, value))
    before = lambda w: F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = cut.groupBy("__slice").agg(F.sum(amount).alias(amount))
    below = totals.select("__slice", before(Window.orderBy("__slice")).alias("__below"))  # as many rows as there are slices
    inside = cut.withColumn("__inside", before(Window.partitionBy("__slice").orderBy(value)))
    return inside.join(F.broadcast(below), "__slice").withColumn(name, F.col("__below") + F.col("__inside")).drop("__slice", "__below", "__inside")


def exact_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks, from one row for each distinct score."""
    ties = df.where(c(score).isNotNull()).groupBy(score).agg(F.sum(c(y)).alias("pos"), F.sum(1 - c(y)).alias("neg"))
    area = sums_below(ties, score, "neg", "below")
    return area.agg(safe_divide(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))), F.sum("pos") * F.sum("neg"), float("nan")).alias("auc"))


def calibration(df: DataFrame, y: str, p: str, bins: int) -> DataFrame:
    """(bin, n, mean_p, positive_rate) of equal bins of [0, 1], the last closed, empty ones with nulls."""
    got = df.groupBy(F.least(F.floor(c(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(c(y).cast("double")).alias("positive_rate"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "positive_rate")


def classification(df: DataFrame, y: str, p: str, threshold: float = 0.5, eps: float = 1e-12) -> DataFrame:
    """Confusion counts, accuracy, balanced accuracy, log-loss and Brier score."""
    yes, hit = c(y) == 1, c(p) >= threshold
    q = F.least(F.greatest(c(p), F.lit(eps)), F.lit(1 - eps))
    n = lambda cond: F.count_if(cond)
    tp, fp, tn, fn = n(yes & hit), n(~yes & hit), n(~yes & ~hit), n(yes & ~hit)
    return df.agg(
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        F.avg((yes == hit).cast("double")).alias("accuracy"),
        ((safe_divide(tp, tp + fn) + safe_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        F.avg(F.when(yes, -F.log(q)).otherwise(-F.log1p(-q))).alias("log_loss"),
        F.avg((c(p) - c(y)) * (c(p) - c(y))).alias("brier"),
    )


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    e = c(p) - c(y)
    return df.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.corr(p, y).alias("pearson"), F.avg(y).alias("mean_true"), F.avg(p).alias("mean_pred"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, rank) with the mean rank of each distinct value, found from counts of distinct values."""
    counts = df.groupBy(value).agg(F.count("*").alias("__n"))
    return sums_below(counts, value, "__n", "__smaller").select(value, (F.col("__smaller") + (F.col("__n") + 1) / 2).alias(name))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(a, b).where(c(a).isNotNull() & c(b).isNotNull())
    return both.join(average_ranks(both, a, "__ra"), a).join(average_ranks(both, b, "__rb"), b).agg(F.corr("__ra", "__rb").alias("spearman"))


def drift(base: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean_shift, std_ratio, drifted): shifts in base deviations, from 1 on, or a ratio up to 0.5 or from 2 on."""

    def stats(df: DataFrame, tag: str) -> DataFrame:
        row = df.agg(*(x for f in columns for x in (F.avg(f).alias(f"m_{f}"), F.stddev_samp(f).alias(f"s_{f}"))))
        return row.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias(f"mean_{tag}"), F.col(f"s_{f}").alias(f"std_{tag}")) for f in columns))).alias("x")).select("x.*")

    got = stats(base, "a").join(stats(other, "b"), "feature")
    shift = safe_divide(F.col("mean_b") - F.col("mean_a"), "std_a")
    ratio = safe_divide("std_b", "std_a")
    return got.select("feature", shift.alias("mean_shift"), ratio.alias("std_ratio"), ((F.abs(shift) >= 1) | (ratio <= 0.5) | (ratio >= 2)).alias("drifted"))


def tails(df: DataFrame, value: str, percents: list[float]) -> DataFrame:
    """``df`` once for each tail it is in: ``bottom_p`` up to the percentile, ``top_p`` from it on, ends included."""
    cuts = df.agg(F.percentile(value, [x for p in percents for x in (p / 100, 1 - p / 100)]).alias("q"))
    named = []
    for i, p in enumerate(percents):
        named += [F.when(c(value) <= F.col("q")[2 * i], F.lit(f"bottom_{p:g}")), F.when(c(value) >= F.col("q")[2 * i + 1], F.lit(f"top_{p:g}"))]
    return df.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.explode(F.array_compact(F.array(*named)))).drop("q")


def strided(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every k-th row in order, so that at most ``most`` remain; the numbering is by slices of the order's range.

    The slices are written once: bounds drawn anew in a second run would not be those that were counted.
    """
    from pyspark.sql import types as T

    spark = df.sparkSession
    n = df.count()
    k = max(1, -(-n // most))
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "strided")
    numbered = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    start, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, start))
        start += sizes[part]
    offsets = F.broadcast(spark.createDataFrame(starts, T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__start", T.LongType())])))
    return numbered.join(offsets, "__part").where((F.col("__start") + F.col("__i") - 1) % k == 0).drop("__part", "__i", "__start")
