"""Streaming linear heads: standardise on the train split, gradient steps over batches in row order, score, evaluate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.kernels import c, clip, sigmoid
from tidebook.operators.metrics import linear_score
from tidebook.session import written

#: The training rule's rate, penalty, largest gradient, rows of a batch, epochs, and Huber's bend.
RATE, L2, CLIP, BATCH, EPOCHS, HUBER = 0.05, 1e-4, 10.0, 8192, 5, 1.0


def standardiser(train: DataFrame, xs: list[str], floor: float = 1e-12) -> tuple[list[float], list[float]]:
    """Means and sample deviations of the train rows, one aggregate."""
    row = train.agg(*(f for x in xs for f in (F.avg(x), F.stddev_samp(x)))).first()
    mean = [float(row[2 * i] or 0.0) for i in range(len(xs))]
    return mean, [max(float(row[2 * i + 1] or 0.0), floor) for i in range(len(xs))]


def standardised(xs: list[str], mean: list[float], std: list[float], bound: float = 8.0) -> list[Column]:
    return [clip((c(x) - m) / s, -bound, bound) if s > 1e-12 else F.lit(0.0) for x, m, s in zip(xs, mean, std, strict=True)]


def train_head(rows: DataFrame, zs: list[Column], y: str, position: str, kind: str, epochs: int = EPOCHS, batch: int = BATCH) -> tuple[list[float], float]:
    """Weights and intercept of a logistic or Huber head by gradient steps over batches in row order.

    A batch is ``batch`` neighbouring positions. Batches follow each other, since each step needs the last one's weights; the
    gradient of a batch is one aggregate of sums, so a batch of any size is read by all executors and the driver holds only
    as many numbers as there are columns.
    """
    z = rows.select(F.floor(F.col(position) / batch).cast("long").alias("b"), *(v.alias(f"z{i}") for i, v in enumerate(zs)), c(y).cast("double").alias("y")).where("y is not null")
    z = written(z.repartitionByRange("b").sortWithinPartitions("b"), "batches")  # in order, so that a step reads its own files' row groups
    batches = [r["b"] for r in z.select("b").distinct().orderBy("b").toLocalIterator()]
    w, bias = np.zeros(len(zs)), 0.0
    columns = [F.col(f"z{i}") for i in range(len(zs))]
    for _ in range(epochs):
        for b in batches:
            raw = linear_score(w.tolist(), bias, columns)
            error = sigmoid(raw) - F.col("y") if kind == "logistic" else F.least(F.greatest(raw - F.col("y"), F.lit(-HUBER)), F.lit(HUBER))
            got = z.where(F.col("b") == b).withColumn("e", error).agg(F.avg("e"), *(F.avg(F.col("e") * x) for x in columns)).first()
            step = np.array([got[i + 1] for i in range(len(zs))]) + L2 * w
            norm = float(np.sqrt((step**2).sum() + got[0] ** 2))
            shrink = min(1.0, CLIP / norm) if norm > 0 else 1.0
            w, bias = w - RATE * shrink * step, bias - RATE * shrink * got[0]
    return w.tolist(), float(bias)


def evaluated(scored: DataFrame, split: str, y: str, p: str) -> DataFrame:
    """For each split: rows, positives, log loss, Brier score, accuracy, mean score, and the log loss of the split's own base rate."""
    t, q = c(y).cast("double"), F.least(F.greatest(c(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q)))
    rate = F.avg(t)
    base = F.when((rate > 0) & (rate < 1), -(rate * F.log(rate) + (1 - rate) * F.log(1 - rate))).otherwise(F.lit(0.0))
    return scored.groupBy(split).agg(F.count("*").alias("n_rows"), F.sum(t).cast("long").alias("n_positive"), loss.alias("log_loss"), F.avg((q - t) * (q - t)).alias("brier"), F.avg(((q >= 0.5).cast("double") == t).cast("int")).alias("accuracy"), F.avg(q).alias("mean_score"), base.alias("base_log_loss"))
