"""Human scores from nested JSON (A2, A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Members of a score object, in order of preference.
SCORE_FIELDS = ("score", "value", "mos")


def _is_number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")


def _number(v: Column, lenient: bool) -> Column:
    """A number, or NULL; JSON booleans are never numbers, numeric text only when ``lenient``."""
    value = F.try_variant_get(v, "$", "double")
    numeric = F.when(_is_number(v), value)
    if not lenient:
        return numeric
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(numeric, F.when(F.schema_of_variant(v) == "STRING", text.try_cast("double")))


def _score(v: Column, lenient: bool) -> Column:
    direct = _number(v, lenient)
    fields = [F.try_variant_get(v, f"$.{f}", "variant") for f in SCORE_FIELDS]
    inner = [F.when(f.isNotNull(), _number(f, lenient)) for f in fields]
    return F.coalesce(direct, *inner)


def parse_human_scores(docs: DataFrame, layout: str = "subdir_first", lenient: bool = False, text: str = "value") -> DataFrame:
    """(outer-inner exploded) scores of every document: name, subdir, human_score.

    ``docs`` may hold one large object or many small ones; each row is parsed on
    its own. Entries that are not numbers, nor objects holding one, drop out.
    """
    if layout not in ("subdir_first", "device_first"):
        raise ValueError("layout must be device_first or subdir_first")
    outer = docs.select(F.explode(F.from_json(text, "map<string,variant>")).alias("__outer", "__v"))
    inner = outer.select("__outer", F.explode(F.try_variant_get("__v", "$", "map<string,variant>")).alias("__inner", "__leaf"))
    subdir, name = ("__outer", "__inner") if layout == "subdir_first" else ("__inner", "__outer")
    key = (lambda c: F.trim(c)) if lenient else (lambda c: F.col(c))
    return inner.select(
        key(name).alias("name"), key(subdir).alias("subdir"), _score(F.col("__leaf"), lenient).alias("human_score")
    ).filter(F.col("human_score").isNotNull())


def split_overall(scores: DataFrame, overall_key: str = "overall") -> tuple[DataFrame, DataFrame]:
    """Subdir labels and overall labels."""
    overall = scores.filter(F.col("subdir") == overall_key).select("name", F.col("human_score").alias("overall_human_score"))
    return scores.filter(F.col("subdir") != overall_key), overall


def read_human_scores(
    spark: SparkSession, path: str, layout: str = "subdir_first", overall_key: str = "overall", lenient: bool = False
) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.text(path, wholetext=True)
    return split_overall(parse_human_scores(docs, layout, lenient), overall_key)
