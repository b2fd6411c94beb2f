"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.config import Metric


def lit_d(value: float) -> Column:
    return F.lit(float(value))


def clip(col: Column, low: float, high: float) -> Column:
    """``col`` limited to [low, high]; NULL stays NULL (plain greatest/least would drop it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, lit_d(low)), lit_d(high)))


def at_least(col: Column, low: float) -> Column:
    return F.when(col.isNotNull(), F.greatest(col, lit_d(low)))


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def finite_or_null(col: Column) -> Column:
    return F.when(is_finite(col), col)


def finite_or_zero(col: Column) -> Column:
    return F.when(is_finite(col), col).otherwise(lit_d(0.0))


def logistic(col: Column) -> Column:
    return lit_d(1.0) / (lit_d(1.0) + F.exp(-col))


def log_add(a: Column, b: Column) -> Column:
    """Stable log(exp(a) + exp(b)); a NULL side counts as log 0."""
    both = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def seconds(samples: Column, rate: Column | float) -> Column:
    """Duration of a number of samples; NULL without a positive rate."""
    rate = rate if isinstance(rate, Column) else lit_d(rate)
    return F.when(rate > 0, samples.cast("double") / rate)


def n_effective(n_windows: Column) -> Column:
    """Independent windows in ``n_windows`` overlapping ones (5 s long, 1 s apart)."""
    return F.greatest(lit_d(1.0), (n_windows.cast("double") + 4.0) / 5.0)


def stabilised_mean(m: Metric) -> Column:
    mean = F.col(m.mean).cast("double")
    if m.transform == "log1p":
        return F.log1p(at_least(mean, 0.0))
    if m.transform == "fisher":
        return F.atanh(clip(mean, -0.999999, 0.999999))
    raise ValueError(f"Unknown metric transform: {m.transform}")


def stabilised_var(m: Metric) -> Column:
    """Variance after the transform, by the delta method."""
    mean, var = F.col(m.mean).cast("double"), at_least(F.col(m.var).cast("double"), 0.0)
    if m.transform == "log1p":
        return var / F.pow(1.0 + at_least(mean, 0.0), 2)
    if m.transform == "fisher":
        c = clip(mean, -0.999999, 0.999999)
        return var * F.pow(1.0 / F.greatest(1.0 - c * c, lit_d(1e-8)), 2)
    raise ValueError(f"Unknown metric transform: {m.transform}")


def preference_probability(diff: Column, margin: float, at_margin: float) -> Column:
    """Chance of being preferred, ``at_margin`` when the scores differ by ``margin``."""
    slope = F.ln(lit_d(at_margin / (1.0 - at_margin))) / margin
    return logistic(clip(slope * diff, -50.0, 50.0))


def safe_name(col: Column) -> Column:
    """File-system-safe form of a key."""
    return F.regexp_replace(col, "[^0-9a-zA-Z._-]+", "_")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def join_warnings(pairs: list[tuple[Column, str]], sep: str = "|") -> Column:
    """Texts of the conditions that hold, joined by ``sep``; empty if none."""
    return F.concat_ws(sep, *[F.when(cond, F.lit(text)) for cond, text in pairs])


def general_number(value: float) -> str:
    return f"{value:g}"
