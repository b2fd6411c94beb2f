"""Benchmark decontamination with a positional inverted index over the training documents.

Only DataFrame functions run on the executors.

The index holds postings (term, document, position). Its terms are pairs of adjacent words
(single words for one-word items): a pair is far rarer than a word, so the lists are short,
and a phrase is the intersection of the offset-adjusted lists of the pairs that cover it.
Only terms of the test set are stored; no other list is ever read. For every window of the
test set the rarest term, by its count in all documents, proposes the places; the lists of
the other terms are then intersected with them at their offsets. Every word of a window
lies in one of its pairs and pairs are compared as words, so matches are exact.

Proximity: with ``slop`` above 0 a place also counts as near if each other term occurs
within ``slop`` positions of where the phrase would have it.

Edge cases: a null or wordless text has no words and no hit; an item without words has no
window; repeated rows get equal results; equal windows of several items hit all of them; a
null item_id goes by the text ``null``; no items or no documents give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.llm.common import ascii_lower, row_key, stored

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _term(first: Column, second: Column) -> Column:
    return F.xxhash64(first, second)


def windows_of(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, win, ws): the windows of every item; ``win`` names a window by its words."""
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w"))
    cut = own.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda s: F.slice(w, s + 1, width))).alias("ws"))
    return cut.select("item", F.array_join("ws", " ").alias("win"), "ws").distinct()


def _terms_of(ws: Column) -> Column:
    """The terms of a window with their offsets; ``cover`` marks those that together hold every word."""
    n = F.size(ws)
    pair = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
        lambda i: F.struct(
            i.alias("off"),
            F.get(ws, i).alias("w1"),
            F.coalesce(F.get(ws, i + 1), F.lit("")).alias("w2"),
            ((i % 2 == 0) | (i == n - 2)).alias("cover"),
        ),
    )
    return pair


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (k_id, k_fp, pos, term) of the wanted terms (w1, w2); an empty w2 asks for single words.

    One pass over the texts. The list of wanted terms is as large as the test set; Spark
    broadcasts it if it is below the broadcast threshold and shuffles both sides if not.
    """
    own = docs.select(*row_key(F.col("doc_id"), F.col("text")), words(F.col("text")).alias("w"))
    at = own.select("k_id", "k_fp", "w", F.posexplode("w").alias("pos", "a"))
    wanted = terms.select("w1", "w2", _term(F.col("w1"), F.col("w2")).alias("term"))

    def look_up(second: Column, asked: DataFrame) -> DataFrame:
        placed = at.select("k_id", "k_fp", "pos", "a", second.alias("b")).filter(F.col("b").isNotNull())
        hit = (_term(F.col("a"), F.col("b")) == F.col("term")) & (F.col("a") == F.col("w1")) & (F.col("b") == F.col("w2"))
        return placed.join(asked, hit).select("k_id", "k_fp", "pos", "term")

    pairs = look_up(F.get("w", F.col("pos") + 1), wanted.filter("w2 <> ''"))
    single = wanted.filter("w2 = ''")
    return pairs if single.isEmpty() else pairs.unionByName(look_up(F.lit(""), single))


def search(postings: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """(k_id, k_fp, win, start, length, exact): the places of every window, exact ones and near ones."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    wins = windows.select("win", "ws").distinct()
    parts = wins.select("win", F.size("ws").alias("length"), F.inline(_terms_of(F.col("ws"))))
    parts = parts.withColumn("term", _term(F.col("w1"), F.col("w2"))).join(counts, "term", "left")
    per = Window.partitionBy("win")
    ranked = parts.withColumns(
        {"rank": F.row_number().over(per.orderBy(F.col("n").asc_nulls_first(), "off")), "rarest": F.min(F.coalesce("n", F.lit(0))).over(per)}
    ).filter("rarest > 0")
    plan = ranked.groupBy("win", "length").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("term", "off"))).alias("rare"),
        F.collect_list(F.when((F.col("rank") > 1) & F.col("cover"), F.struct("off", "term"))).alias("rest"),
    )
    plan = stored(plan.select("win", "length", "rare.term", F.col("rare.off").alias("at"), "rest"))
    places = postings.join(plan, "term").select("k_id", "k_fp", "win", "length", (F.col("pos") - F.col("at")).alias("start"), "rest")
    places = places.filter((F.col("start") >= 0) | F.lit(slop > 0)).distinct()  # repeated rows share their key
    asked = places.select("k_id", "k_fp", "win", "length", "start", F.size("rest").alias("need"), F.explode_outer("rest").alias("r"))
    asked = asked.select("k_id", "k_fp", "win", "length", "start", "need", "r.off", "r.term")
    if slop:
        asked = asked.withColumn("shift", F.explode(F.sequence(F.lit(-slop), F.lit(slop))))
    else:
        asked = asked.withColumn("shift", F.lit(0))
    asked = asked.withColumn("pos", F.col("start") + F.col("off") + F.col("shift"))
    done = asked.filter("need = 0").select("k_id", "k_fp", "win", "length", "start").distinct().withColumn("exact", F.lit(True))
    met = asked.filter("need > 0").join(postings, ["k_id", "k_fp", "term", "pos"])
    found = met.groupBy("k_id", "k_fp", "win", "length", "start", "need").agg(
        F.size(F.collect_set(F.when(F.col("shift") == 0, F.col("off")))).alias("same"), F.size(F.collect_set("off")).alias("some")
    )
    exact = (F.col("same") == F.col("need")).alias("exact")
    kept = found.filter(F.greatest("same", "some") == F.col("need"))
    return done.unionByName(kept.select("k_id", "k_fp", "win", "length", "start", exact))


def hits(docs: DataFrame, items: DataFrame, slop: int = 0, width: int = WIDTH) -> DataFrame:
    """(k_id, k_fp, n_hit, n_items, items_sha256, n_near) of the documents with a match."""
    windows = stored(windows_of(items, width))
    terms = windows.select(F.inline(_terms_of(F.col("ws")))).select("w1", "w2").distinct()
    postings = stored(build_index(docs, stored(terms)))
    places = stored(search(postings, windows, slop))
    exact = places.filter("exact")
    spans = exact.select("k_id", "k_fp", "start", "length").distinct()
    hit = spans.select("k_id", "k_fp", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hit = hit.groupBy("k_id", "k_fp").agg(F.count(F.lit(1)).alias("n_hit"))
    named = exact.join(windows.select("win", "item"), "win").select("k_id", "k_fp", "item").distinct()
    named = named.groupBy("k_id", "k_fp").agg(F.sort_array(F.collect_list("item")).alias("items"))
    named = named.select("k_id", "k_fp", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = hit.join(named, ["k_id", "k_fp"])
    if not slop:
        return out.withColumn("n_near", F.lit(0).cast("long"))
    near = places.filter("not exact").groupBy("k_id", "k_fp").agg(F.count_distinct("win").alias("n_near"))
    return out.join(near, ["k_id", "k_fp"], "full")


def contamination(docs: DataFrame, items: DataFrame, slop: int = 2, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (windows met nearby, not exactly) per document."""
    found = stored(hits(docs, items, slop, width))
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(found, ["k_id", "k_fp"], "left").select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without a benchmark window, with exactly their own columns."""
    found = stored(hits(docs, items, 0, width).select("k_id", "k_fp"))
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.struct(*docs.columns).alias("row"))
    return rows.join(found, ["k_id", "k_fp"], "left_anti").select("row.*")
