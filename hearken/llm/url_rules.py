"""URL verdicts: a given rule list first, then association rules mined from labelled URLs.

Every URL has at most ``len(POSITIONS)`` tokens: its top-level label, registered domain,
host, first host label, first and second path segment (digits read as 0), file ending and
first query name. FP-growth mines frequent token combinations together with the label from
labelled URLs; a combination becomes a rule for its majority label if support and
confidence suffice and no shorter combination with the same verdict is at least as sure.

Size: a URL holds at most 2^positions combinations, so at most 2^positions / support of
them are frequent, whatever the number of pages. That bound is what lets the mined rules go
to all tasks, as an inverted index from token to rules.

Edge cases: a null url, or one without ``://``, has an empty host and path; it has no
tokens and takes the default verdict; ties between rules go to the higher confidence, then
support, then the combination itself; repeated rows are judged each; with no labelled URL
there are no mined rules; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import ascii_lower, stored

POSITIONS = ("tld", "domain", "host", "sub", "dir", "dir2", "ending", "query")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LABELS = ("allow", "block")


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(rule, verdict) of the longest given rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The tokens of a URL, at most one per position."""
    h, p = host(url), path(url)
    names = F.split(h, "[.]")
    query = F.regexp_extract(rest_of(url), r"^[^?#]*[?]([^=&#]*)", 1)
    shape = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    found = {
        "tld": F.element_at(names, -1),
        "domain": F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), F.lit(2)), "."),
        "host": h,
        "sub": F.when(F.size(names) > 2, F.element_at(names, 1)),
        "dir": shape(F.regexp_extract(p, r"^/([^/]*)", 1)),
        "dir2": shape(F.regexp_extract(p, r"^/[^/]*/([^/]*)", 1)),
        "ending": F.regexp_extract(p, r"[.]([a-zA-Z0-9]{1,5})$", 1),
        "query": query,
    }
    cells = [F.when(F.length(found[n]) > 0, F.concat(F.lit(n + "="), found[n])) for n in POSITIONS]
    return F.when(F.length(h) > 0, F.array_compact(F.array(*cells))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9) -> DataFrame:
    """(tokens, verdict, confidence, n): pruned rules from (tokens, label) rows."""
    rows = stored(labelled.filter(F.size("tokens") > 0).select(F.array_append("tokens", F.concat(F.lit("label="), F.col("label"))).alias("items")))
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = FPGrowth(itemsCol="items", minSupport=support, numPartitions=parts).fit(rows).freqItemsets
    sets = sets.select("freq", F.array_sort(F.filter("items", lambda x: ~F.startswith(x, F.lit("label=")))).alias("tokens"),
                       F.get(F.filter("items", lambda x: F.startswith(x, F.lit("label="))), 0).alias("label"))
    sets = stored(sets.filter(F.size("tokens") > 0))
    whole = sets.filter("label is null").select("tokens", F.col("freq").alias("n"))
    rules = sets.filter("label is not null").join(whole, "tokens").withColumn("confidence", F.col("freq") / F.col("n"))
    rules = rules.filter(F.col("confidence") >= confidence)
    rules = rules.select("tokens", F.substring("label", 7, 100).alias("verdict"), "confidence", F.col("freq").alias("n"))
    return stored(rules)


def pruned(rules: list[tuple[tuple[str, ...], str, float, int]]) -> list[tuple[tuple[str, ...], str, float, int]]:
    """Without the rules that say nothing new: a shorter part has the same verdict and is at least as sure."""
    by_tokens = {(frozenset(t), v): c for t, v, c, _ in rules}
    out = []
    for t, v, c, n in rules:
        part = frozenset(t)
        smaller = ({x for k, x in enumerate(t) if mask >> k & 1} for mask in range(1, (1 << len(t)) - 1))
        if not any(by_tokens.get((frozenset(s), v), -1.0) >= c for s in smaller):
            out.append((tuple(sorted(part)), v, c, n))
    return sorted(out, key=lambda r: (-r[2], -r[3], r[0], r[1]))


def match(rows: DataFrame, rules: list[tuple[tuple[str, ...], str, float, int]], columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` plus ``mined`` (the verdict) and ``mined_from`` (the tokens) of the surest rule whose tokens the row has."""
    index: dict[str, list[int]] = defaultdict(list)
    for k, (t, *_) in enumerate(rules):
        for x in t:
            index[x].append(k)
    index = dict(index)
    need = [len(t) for t, *_ in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, ...], int | None] = {}
        for batch in batches:
            found = []
            for own in batch.column("tokens").to_pylist():
                known = tuple(x for x in own if x in index)
                if known not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    hits = Counter(k for x in known for k in index[x])
                    seen[known] = min((k for k, n in hits.items() if n == need[k]), default=None)
                found.append(seen[known])
            mined = pa.array([None if k is None else rules[k][1] for k in found], pa.string())
            by = pa.array([None if k is None else " ".join(rules[k][0]) for k in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), mined, by], names=[*columns, "mined", "mined_from"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)
    return rows.select(*columns, "tokens").mapInArrow(run, f"{schema}, mined string, mined_from string")


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None,
    support: float = 0.005, confidence: float = 0.9, default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_from (the combination that decided) per page.

    ``labelled`` has (url, label) with the labels allow and block; without it the pages
    that a given rule fits are the labelled ones.
    """
    url = F.col("url")
    own = pages.select("page_id", url, host(url).alias("host"), path(url).alias("path"))
    own = own.withColumns({"given": fitting(F.col("host"), F.col("path"), rules), "tokens": tokens(url)})
    if labelled is None:
        known = own.filter("given is not null").select("tokens", F.col("given.verdict").alias("label"))
    else:
        known = labelled.filter(F.col("label").isin(*LABELS)).select(tokens(F.col("url")).alias("tokens"), "label")
    learned = pruned([(tuple(r.tokens), r.verdict, r.confidence, r.n) for r in mine(known, support, confidence).toLocalIterator()])
    own = own.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.col("given.verdict").alias("said"), "tokens")
    out = match(own, learned, ["page_id", "host", "path", "rule", "said"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "mined", F.lit(default)).alias("verdict"), F.when(F.col("said").isNull(), F.col("mined_from")).alias("mined_from"))
