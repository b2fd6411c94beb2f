"""Quality rules: exact base rules, then robust multivariate outliers per language and source.

Only DataFrame functions run on the executors. The per-document counts are higher-order
expressions over one text; the minimum-covariance-determinant fit is a chain of small
aggregates, so a source with a third of all rows is only a third of the map side.

Edge cases: a null or blank text has no words and fails the base rules; a null ``lang`` or
``source`` forms a group of its own; repeated rows count as often as they occur; the estimate
of a small group lies near that of its language, and that of a small language near that of all
documents; an empty table gives an empty result. Existing columns never clash: results are either
selected by name or the input row is carried inside a struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.llm.common import stored

BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("x0", "x1", "x2", "x3")
#: Smallest spread of each feature that counts as one; a feature that is constant in most rows has no scatter of its own.
FLOORS = {"x0": 0.05, "x1": 0.05, "x2": 0.1, "x3": 0.1}


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(n >= 3, F.array_sort(windows)).otherwise(F.lit(None))


def _covered(ordered: Column) -> Column:
    twice = F.filter(
        F.transform(
            ordered,
            lambda e, j: F.when(
                (F.coalesce(F.get(ordered, j - 1)["h"] == e["h"], F.lit(False)))
                | (F.coalesce(F.get(ordered, j + 1)["h"] == e["h"], F.lit(False))),
                e["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return F.array_sort(twice)


def _union_length(starts: Column) -> Column:
    steps = F.transform(starts, lambda s, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - s, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def with_text_stats(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the base statistics of ``text`` under the names in ``BASE`` (longs)."""
    t = F.coalesce(text, F.lit(""))
    blank = f"[{BLANKS}]+"
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    out = df.withColumns(
        {
            "__w": F.array_remove(F.split(t, blank), ""),
            "__l": lines,
            "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__s": _repeated(F.col("__w")),
        }
    ).drop("__w", "__l")
    out = out.withColumn("__p", _covered(F.col("__s"))).drop("__s")
    return out.withColumn("n_repeat_words", F.coalesce(_union_length(F.col("__p")), F.lit(0)).cast("long")).drop("__p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_features(df: DataFrame) -> DataFrame:
    """Bounded, roughly symmetric transforms of the statistics; length itself is no sign of quality.

    Logarithm of the mean word length, and square roots of the share of symbols per
    word, of repeated words and of repeated lines.
    """
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns(
        {
            "x0": F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))),
            "x1": F.sqrt(F.least(F.col("n_symbols") / n, F.lit(4.0))),
            "x2": F.sqrt(F.col("n_repeat_words") / n),
            "x3": F.sqrt(F.least(F.col("n_dup_lines") / F.sqrt(n), F.lit(4.0))),
        }
    )


def _chi2_cdf(x: float, d: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(d // 2):
        total += term
        term *= (x / 2) / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, d) < p else (low, mid)
    return high


def _moments(rows: DataFrame, keep: Column) -> DataFrame:
    """Mean and covariance of the kept rows of each group, with a floor on the variances."""
    x = FEATURES
    kept = rows.filter(keep)
    sums = [F.avg(c).alias(f"m_{c}") for c in x]
    cross = [F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(x) for b in x[: i + 1]]
    out = kept.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *sums, *cross)
    return out.withColumns({f"c_{a}_{a}": F.col(f"c_{a}_{a}") + F.lit(FLOORS[a] ** 2) for a in x})


def _cholesky(params: DataFrame, scale: float) -> DataFrame:
    """Lower factor of ``scale`` times the covariance, one column per entry."""
    x, cols = FEATURES, {}
    out = params
    for i, a in enumerate(x):
        for j, b in enumerate(x[: i + 1]):
            v = F.col(f"c_{a}_{b}") * F.lit(scale)
            for k in range(j):
                v = v - F.col(f"l_{a}_{x[k]}") * F.col(f"l_{b}_{x[k]}")
            cols = {f"l_{a}_{b}": F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l_{b}_{b}")}
            out = out.withColumns(cols)
    return out.select("g", *[f"m_{a}" for a in x], *[f"l_{a}_{b}" for i, a in enumerate(x) for b in x[: i + 1]])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    x, z = FEATURES, []
    for i, a in enumerate(x):
        v = F.col(a) - F.col(f"m_{a}")
        for k in range(i):
            v = v - F.col(f"l_{a}_{x[k]}") * z[k]
        z.append(v / F.col(f"l_{a}_{a}"))
    return sum((q * q for q in z[1:]), z[0] * z[0])


def _cut(rows: DataFrame, share: float) -> DataFrame:
    """Per group the end of the distance bin in which the wanted share of rows is reached.

    Bins are 1/32 of an octave, so a group has a few thousand of them at most, however
    many rows it has; counts are combined before the shuffle.
    """
    bins = rows.withColumn("b", F.floor(F.log2(F.col("d2") + F.lit(1e-9)) * 32)).groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy("g")
    run = bins.withColumn("upto", F.sum("n").over(part.orderBy("b"))).withColumn("all", F.sum("n").over(part))
    reached = run.filter(F.col("upto") >= F.ceil(F.col("all") * F.lit(share))).groupBy("g").agg(F.min("b").alias("b"))
    return reached.select("g", F.pow(F.lit(2.0), (F.col("b") + 1) / 32.0).alias("cut"))


def _start(rows: DataFrame) -> DataFrame:
    """First scatter: coordinate-wise medians and absolute deviations, read off counts of fine bins."""
    fine = 2048.0
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.floor(F.col(c) * fine).alias("b")) for c in FEATURES])).alias("e")
    counts = rows.select("g", cells).groupBy("g", "e.c", "e.b").agg(F.count(F.lit(1)).alias("n"))

    def middle(df: DataFrame, value: str, name: str) -> DataFrame:
        part = Window.partitionBy("g", "c")
        run = df.withColumn("upto", F.sum("n").over(part.orderBy(value))).withColumn("all", F.sum("n").over(part))
        return run.filter(F.col("upto") * 2 >= F.col("all")).groupBy("g", "c").agg(F.min(value).alias(name))

    med = middle(counts, "b", "med")
    away = counts.join(med, ["g", "c"]).withColumn("dev", F.abs(F.col("b") - F.col("med"))).groupBy("g", "c", "dev").agg(F.sum("n").alias("n"))
    both = med.join(middle(away, "dev", "mad"), ["g", "c"])
    x = FEATURES
    pick = [F.max(F.when(F.col("c") == a, (F.col("med") + 0.5) / fine)).alias(f"m_{a}") for a in x]
    spread = [F.max(F.when(F.col("c") == a, 1.4826 * F.col("mad") / fine)).alias(f"s_{a}") for a in x]
    out = both.groupBy("g").agg(*pick, *spread)
    zero = {f"c_{a}_{b}": F.lit(0.0) for i, a in enumerate(x) for b in x[:i]}
    return out.withColumns(zero | {f"c_{a}_{a}": F.col(f"s_{a}") ** 2 + F.lit(FLOORS[a] ** 2) for a in x})


#: Bytes up to which a table of groups is broadcast, and the tasks that share a group beyond that.
SMALL, SALTS = 8 << 20, 64


def _with_group(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` with the values of their group from a written table with a row for every group.

    A group may hold any share of the rows (``*`` holds all), so they are never dealt by group
    alone: a table whose size is counted to be small is broadcast, a larger one repeated per salt.
    """
    width = sum(len(f.dataType) if isinstance(f.dataType, T.StructType) else 1 for f in groups.schema)
    if groups.count() * (16 * width + 64) <= SMALL:
        return rows.join(F.broadcast(groups), key)
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"]).drop("__salt")


def _blend(rows: DataFrame, own: str, base: str, prior: float, out: str) -> DataFrame:
    """Adds struct ``out``: the moments ``own`` drawn towards ``base`` as if ``base`` had ``prior`` rows, the distance of the two centers included."""
    n = F.coalesce(F.col(f"{own}.n"), F.lit(0)).cast("double")
    w = n / (n + F.lit(float(prior)))
    mine = lambda c: F.coalesce(F.col(f"{own}.{c}"), F.col(f"{base}.{c}"))
    x = FEATURES
    means = [(w * mine(f"m_{a}") + (1 - w) * F.col(f"{base}.m_{a}")).alias(f"m_{a}") for a in x]
    away = {a: mine(f"m_{a}") - F.col(f"{base}.m_{a}") for a in x}
    cross = [
        (w * mine(f"c_{a}_{b}") + (1 - w) * F.col(f"{base}.c_{a}_{b}") + w * (1 - w) * away[a] * away[b]).alias(f"c_{a}_{b}")
        for i, a in enumerate(x) for b in x[: i + 1]
    ]
    return rows.withColumn(out, F.struct(*means, *cross))


def fit(stats: DataFrame, share: float = 0.75, steps: int = 3, prior: float = 200.0) -> DataFrame:
    """Location and Cholesky factor of each group ``g`` of (language, source).

    Concentration steps: keep the ``share`` of rows nearest by the current distance, take
    their mean and covariance, repeat; then one re-weighting step over the rows inside the
    97.5 % ellipsoid. This is done per (language, source), per language and for all
    documents; then each language's moments are drawn towards those of all, and each source's
    towards those of its language, by ``prior`` rows' worth, so an estimate changes smoothly
    with the size of its group. ``stats`` has the features, ``lang`` and ``source``. Rows that
    failed the base rules take no part.
    """
    d = len(FEATURES)
    levels = F.array(group_key("lang", "source"), group_key("lang"), group_key())
    rows = stats.filter(~base_failed()).select(*FEATURES, F.explode(levels).alias("g"))
    raw = share / _chi2_cdf(chi2_quantile(share, d), d + 2)
    inner = chi2_quantile(0.975, d)
    settled = 0.975 / _chi2_cdf(inner, d + 2)
    params = stored(_cholesky(_start(rows), 1.0))
    for _ in range(steps):
        near = _with_group(rows, params, "g").withColumn("d2", _distance())
        cut = stored(_cut(near.select("g", "d2"), share))
        params = stored(_cholesky(_moments(_with_group(near, cut, "g"), F.col("d2") <= F.col("cut")), raw))
    near = _with_group(rows, params, "g").withColumn("d2", _distance())
    moments = stored(_moments(near, F.col("d2") <= F.lit(inner)))
    held = moments.select("g", F.struct("n", *[c for c in moments.columns if c[:2] in ("m_", "c_")]).alias("p"))
    groups = stats.select("lang", "source").distinct().select(group_key("lang", "source").alias("g"), group_key("lang").alias("g1"), group_key().alias("g2"))
    groups = stored(groups)
    for level, name in (("g", "own"), ("g1", "lang"), ("g2", "all")):
        groups = groups.join(held.toDF(level, name), level, "left")
    # each step is written: the next one names its columns many times
    based = stored(_blend(groups, "lang", "all", prior, "base").select("g", "own", "base"))
    drawn = stored(_blend(based, "own", "base", prior, "p").select("g", "p.*"))
    return stored(_cholesky(drawn, settled))


def group_key(*columns: str) -> Column:
    """Text naming a group; null and the word null stay different."""
    if not columns:
        return F.lit("*")
    return F.concat_ws("/", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns], F.lit(str(len(columns))))


def with_verdict(stats: DataFrame, params: DataFrame, cutoff: float) -> DataFrame:
    """``stats`` with ``base_failed``, ``distance`` and ``kept``.

    Each row is judged by the estimate of its group; where no document passed the base rules there is none.
    """
    names = [c for c in params.columns if c != "g"]
    out = stats.withColumns({"base_failed": base_failed(), "__g": group_key("lang", "source")})
    groups = params.select(F.col("g").alias("__g"), F.struct(*names).alias("__p"))
    out = _with_group(out, groups, "__g").select(*stats.columns, "base_failed", *[F.col(f"__p.{c}").alias(c) for c in names])
    out = out.withColumn("distance", F.sqrt(_distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.lit(cutoff), F.lit(True))
    return out.withColumn("kept", kept).drop(*names)


#: Distance beyond which a document is an outlier: far outside any regular text, so that
#: ordinary variation of a source never costs documents.
CUTOFF = 8.0


def judge(docs: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """doc_id, lang, source, the base statistics, features, ``base_failed``, ``distance`` and ``kept`` per document."""
    slim = docs.select("doc_id", "lang", "source", F.col("text").alias("__t"))
    stats = stored(with_features(with_text_stats(slim, F.col("__t")).drop("__t")))
    return with_verdict(stats, fit(stats, **options), cutoff)


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """The documents that pass, with exactly their own columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    stats = with_text_stats(packed, F.col("row.text")).withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")})
    stats = stored(with_features(stats))
    return with_verdict(stats, fit(stats, **options), cutoff).filter("kept").select("row.*")
