"""Which way a metric points, from its name (B14) and column auto-selection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.config import RECOMMENDED_FEATURES

# Name fragments of lower-is-better metrics; every other name counts as higher-is-better.
LOWER_IS_BETTER = ("distance", "dist", "l2", "fd", "fad", "kl", "js", "nll", "rmse", "mae", "error", "loss")
# Spellings accepted in an override file.
OVERRIDE_WORDS = {
    "higher": 1, "higher_is_better": 1, "+": 1, "1": 1,
    "lower": -1, "lower_is_better": -1, "-": -1, "-1": -1,
}


def signs_given(overrides: dict | None) -> dict[str, int]:
    """The override table with every entry, word or number, read as +1 or -1; unreadable words are listed in one error."""
    words = {c: v.lower() for c, v in (overrides or {}).items() if isinstance(v, str)}
    if strange := {c: w for c, w in words.items() if w not in OVERRIDE_WORDS}:
        raise ValueError(f"Cannot read these directions: {strange}")
    numbers = {c: -1 if v < 0 else 1 for c, v in (overrides or {}).items() if c not in words}
    return numbers | {c: OVERRIDE_WORDS[w] for c, w in words.items()}


def metric_directions(columns: list[str], overrides: dict | None = None) -> dict[str, int]:
    lower = re.compile("|".join(LOWER_IS_BETTER))
    given = signs_given(overrides)
    return {c: given.get(c, -1 if lower.search(c.lower()) else 1) for c in columns}


def metric_direction(column: str, overrides: dict | None = None) -> int:
    return metric_directions([column], overrides)[column]


def apply_directions(df: DataFrame, columns: list[str], overrides: dict | None = None) -> DataFrame:
    """Flip lower-is-better columns so that more is always better."""
    signs = metric_directions(columns, overrides)
    return df.withColumns({c: F.col(c).cast("double") * F.lit(float(s)) for c, s in signs.items()})


def feature_columns(df: DataFrame, exclude: list[str], prefer_recommended: bool = False) -> list[str]:
    """Numeric columns not in ``exclude``; the recommended set when four or more of it exist."""
    if prefer_recommended:
        found = [c for c in RECOMMENDED_FEATURES if c in df.columns]
        if len(found) >= 4:
            return found
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]
