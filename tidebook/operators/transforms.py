"""What the registry knows of each feature, and the chain that brings raw features to a common scale.

A name says what a feature is: patterns, tried in order, give its source, family, unit, book depth and transform. The chain
first puts a raw value on its scale (expressions), then, for most transforms, takes a z-score against a time-decayed mean
and variance as they stood before the row (a fold, one state a symbol).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.kernels import base_transform
from tidebook.operators.features import FEATURES, windows_of
from tidebook.operators.folds import fold

#: The first pattern that a name has decides. Families and depths may also ask for a source.
SOURCES = (
    ("event_context", r"^log_events"),
    ("cross", r"^(absorption_|ofi_l1_pressure_|trade_side_quote_response_asymmetry)"),
    ("trade", r"^(trade_|zero_tick_|time_since_last_(buy|sell)_trade|max_signed_trade|max_trade_silence_gap|same_side_trade_cluster)"),
    ("book", r""),
)
OWNERS = {"book": "book_state", "trade": "trade_state", "cross": "engine", "event_context": "engine"}
FAMILIES = (
    ("event_context", "event_context", r""), ("price", None, r"^mid_|microprice"), ("ofi_obi", None, r"^obi_|^ofi_"), ("depth", None, r"depth"),
    ("book_dynamics", None, r"^(bid|ask)_l1|depletion|churn|flicker|spread_state_transition"), ("large_trade", None, r"max_signed_trade"),
    ("absorption", None, r"^absorption_"), ("trade_flow", "trade", r""), ("cross_signal", "cross", r""), ("book_level", None, r""),
)
UNITS = (
    ("log1p", r"^log_"), ("microseconds", r"time_since|age_us|silence_gap"), ("bps", r"bps|realized_vol"), ("notional_usd", r"usd|notional"),
    ("ratio", r"imbalance|fraction|entropy|asymmetry|score"), ("count", r"count"), ("rate_per_second", r"per_second|rate|slope"), ("sign", r"sign"), ("score", r""),
)
DEPTHS = (
    (0, "event_context", r""), (0, "trade", r""), (20, "cross", r""), (20, None, r"depth_5bps|within_1bps"), (10, None, r"l10_"),
    (1, None, r"_l1|l1_"), (20, None, r"depth"), (1, None, r""),
)
#: Half-lives of the three speeds in microseconds, rows before the first z-score, the least variance, and bounds.
HALF_LIVES = {"fast": 5_000_000, "medium": 30_000_000, "slow": 120_000_000}
LEAST_ROWS, FLOOR, BOUND = 20, 1e-6, 8.0

_SLOW = "microprice_realized_vol_1000000us"
_QUICK_FAMILIES = {"price", "ofi_obi", "book_dynamics", "trade_flow", "absorption", "cross_signal"}
_STEADY = r"depth_notional|depth_within|max_trade_silence_gap"


@dataclass(frozen=True)
class Spec:
    name: str
    position: int
    source: str
    owner: str
    family: str
    unit: str
    depth: int
    scale: str
    speed: str | None

    @property
    def transform(self) -> str:
        return f"{self.scale}_ewma_{self.speed}" if self.speed else self.scale if self.scale == "ratio_bounded" else f"{self.scale}_no_ewma"


def _pick(name: str, source: str, rules) -> str | int:
    return next(value for value, wanted, pattern in rules if wanted in (None, source) and re.search(pattern, name))


def spec(name: str) -> Spec:
    """All that the registry infers from a feature's name."""
    source = next(v for v, p in SOURCES if re.search(p, name))
    family = _pick(name, source, FAMILIES)
    unit = next(v for v, p in UNITS if re.search(p, name))
    windows = windows_of(name)
    quick = name == "obi_l1" or (name != _SLOW and bool(windows) and min(windows) <= 1_000_000 and family in _QUICK_FAMILIES)
    plain = {"event_context": "log1p_pos", "microseconds": "time_log1p", "sign": "sign"}
    if (scale := plain.get(source) or plain.get(unit)) is not None:
        speed = None
    elif unit == "ratio" or re.search(r"over_depth", name):
        scale, speed = "ratio_bounded", None
    else:
        positive = re.search(r"notional|usd", name) or unit in ("count", "rate_per_second")
        scale = "signed_log1p" if name.startswith("max_signed_trade") else "log1p_pos" if positive else "identity"
        quick = unit == "bps" if scale == "identity" and unit == "bps" else quick and not (scale == "log1p_pos" and re.search(_STEADY, name))
        speed = "slow" if name == _SLOW else "fast" if quick else "medium"
    return Spec(name, FEATURES.index(name), source, OWNERS[source], family, unit, _pick(name, source, DEPTHS), scale, speed)


def specs() -> list[Spec]:
    return [spec(n) for n in FEATURES]


_KERNELS = {"identity": "identity", "log1p_pos": "log1p_pos", "signed_log1p": "signed_log1p", "ratio_bounded": "ratio", "sign": "sign", "time_log1p": "log1p_pos"}


@dataclass
class Decayed:
    """Z-scores of many values at once against decayed moments as they stood before the row; zeros while there are too few."""

    names: list[str]
    half_life: np.ndarray
    least_rows: int = LEAST_ROWS
    rows: int = 0
    last: int = 0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    var: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def step(self, row: dict):
        x = np.array([row[n] for n in self.names], float)
        z = np.zeros(len(x))
        if self.rows == 0:
            self.mean, self.var = x.copy(), np.zeros(len(x))
        else:
            if self.rows >= self.least_rows:
                some = self.var > FLOOR
                z[some] = np.clip((x[some] - self.mean[some]) / np.sqrt(self.var[some]), -BOUND, BOUND)
            a = 1 - np.exp2(-max(0, row["local_ts_us"] - self.last) / self.half_life)
            d = x - self.mean
            self.mean += a * d
            self.var = np.maximum((1 - a) * (self.var + a * d * d), 0.0)
        self.rows, self.last = self.rows + 1, row["local_ts_us"]
        yield {"event_id": row["event_id"], **dict(zip(self.names, z.tolist(), strict=True))}

    def finish(self):
        return ()


def transformed(rows: DataFrame, by: list[str], order: list[str], names: list[str] | None = None, scale: float = 1.0, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(by, event_id, features): each feature through its transform. ``scale`` stretches the half-lives for sparse tapes.

    Non-finite values count as 0. Order is by ``order``, which starts with local_ts_us; rows of one time leave the moments as they are.
    """
    known = [spec(n) for n in (names or FEATURES)]
    based = rows.select(*by, *dict.fromkeys([*order, "event_id"]), *(base_transform(s.name, _KERNELS[s.scale]).alias(s.name) for s in known))
    decayed = [s for s in known if s.speed]
    half = np.array([HALF_LIVES[s.speed] * scale for s in decayed])
    out = T.StructType([T.StructField("event_id", T.LongType()), *(T.StructField(s.name, T.DoubleType()) for s in decayed)])
    moving = [s.name for s in decayed]
    z = fold(based.select(*by, *dict.fromkeys([*order, "event_id"]), *moving), by, order, lambda: Decayed(moving, half, least_rows), out)
    rest = based.select(*by, "event_id", *(s.name for s in known if not s.speed))
    return rest.join(z, [*by, "event_id"]).select(*by, "event_id", *(s.name for s in known))


def diagnostics(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(feature, n_rows, n_nonfinite, n_clipped): values that the scale replaces or bounds."""
    bounds = {"identity": 1e9, "ratio_bounded": 10.0, "sign": 1.0}
    known = [spec(n) for n in (names or FEATURES)]

    def one(s: Spec):
        x = F.col(s.name).cast("double")
        odd = x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
        over = ~odd & (F.abs(x) > bounds[s.scale]) if s.scale in bounds else F.lit(False)
        return F.struct(F.lit(s.name).alias("feature"), F.count("*").alias("n_rows"), F.count_if(odd).alias("n_nonfinite"), F.count_if(over).alias("n_clipped"))

    return rows.agg(F.array(*map(one, known)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
