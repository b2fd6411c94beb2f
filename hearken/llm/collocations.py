"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

Texts become pieces (between sentence marks and line ends) of words. Every word starts a
suffix, cut after ``longest`` words, at the end of its piece and before the first word that
is too rare for any phrase. A task merges equal suffixes of its rows, then the suffixes are
routed by their leading words: a range partitioning over (first word, second word, ...) of
measured size, so a leading word that opens a third of all phrases is spread
over many tasks.

Each task sorts pointers to its suffixes to the full depth: partitions are split around a
pivot word into less, equal and greater, the small ones all at a time; an equal partition is a phrase,
its size the phrase's count, and it goes on with the next word; partitions smaller than the
least count are abandoned, at any depth. Only the prefixes of a task's first and last suffix
can go on in other tasks; their counts are emitted in any case and summed, so all counts are
exact.

A word of a language is one 64-bit number, its hash; the whole vocabulary is tested for two
words with one number, and another seed is taken if there are any. Rare words are known from
the vocabulary's map-side combined counts. Suffix tasks test them in a bit set of fixed size
(2 ** ``bits``), which may take a rare word for a frequent one, never the reverse; that costs
rows and changes no result.

The score of a phrase is the least, over its cuts in two parts, of twice its count over the
sum of its parts' counts, in whole millionths. Parts meet their counts by their words, with
short parts, which many phrases share, spread over a salt.

Edge cases: a null text is empty, a null language is ``und``; words are split at blanks and
tabs only, and letters A-Z are lower-cased; repeated rows count as often as they occur;
ties are ordered by the phrase's bytes; an empty table gives an empty result; further
columns are ignored. Memory is bounded by ``chunk`` bytes of text (or one text) and by
``rows`` suffixes a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.llm.common import stored

NO_LANGUAGE = "und"
#: Bytes that end a word, and those that end a piece too.
BLANKS, MARKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: How many tasks share the phrases that have one part of one word, or of two.
SALTS = {1: 64, 2: 8}


def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.zeros(256, dtype=np.int8), np.arange(256, dtype=np.uint8)
    kind[list(BLANKS)], kind[list(MARKS)] = 1, 2
    lower[65:91] += 32
    return kind, lower


KIND, LOWER = _byte_table()


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word number at each place, piece number at each place) of texts, one after the other."""
    whole = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts.cast(pa.binary())), b"\n")[0].as_py()
    raw = np.frombuffer(whole, dtype=np.uint8)
    kind = KIND[raw]
    inside = kind == 0
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if len(raw) else np.empty(0, dtype=np.int64)
    if not len(starts):
        return [], np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = pa.py_buffer(LOWER[raw[inside]].tobytes())
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), letters])
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.large_string()).to_pylist(), coded.indices.to_numpy(), piece


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of about ``chunk`` bytes, or of one longer text."""
    for batch in batches:
        some = max(1, batch.num_rows * chunk // max(batch.nbytes, 1))
        for a in range(0, batch.num_rows, some):
            rows = batch.slice(a, some)
            for lang in pc.unique(rows.column("lang")).to_pylist():
                yield lang, rows.column("text").filter(pc.equal(rows.column("lang"), lang))


def numbers(lang: str, words: list[str], seed: int) -> np.ndarray:
    """The number of each word of a language; never 0."""
    found = (xxhash.xxh3_64_intdigest(f"{lang} {w}", seed) or 1 for w in words)
    return np.fromiter(found, dtype=np.uint64, count=len(words)).view(np.int64)


def _vocabulary(chunk: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _chunks(batches, chunk):
            words, at, _ = words_of(texts)
            n = np.bincount(at, minlength=len(words))
            columns = [pa.array(numbers(lang, words, seed)), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "word", "n"])

    return run


def suffixes_of(at: np.ndarray, piece: np.ndarray, usable: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, counts): the distinct suffixes of two or more usable words as word numbers + 1, 0 after their end."""
    goes = np.zeros(len(at), dtype=bool)
    goes[:-1] = (piece[1:] == piece[:-1]) & usable[at[1:]]
    starts = np.flatnonzero(goes & usable[at])
    if not len(starts):
        return np.empty((0, longest), dtype=np.int32), np.empty(0, dtype=np.int64)
    whole = np.zeros((len(starts), longest), dtype=np.int32)
    whole[:, 0] = at[starts] + 1
    key, size, base = whole[:, 0].astype(np.int64), len(usable) + 1, len(usable) + 1
    more = np.ones(len(starts), dtype=bool)
    for k in range(1, longest):
        more &= goes[np.minimum(starts + k - 1, len(at) - 1)]
        whole[more, k] = at[starts[more] + k] + 1
        if size * base >= 1 << 63:  # number the distinct prefixes, so that a key never outgrows 64 bits
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key, size = key * base + whole[:, k], size * base
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    return whole[order[first]], np.diff(first, append=len(order))


def _suffixes(chunk: int, longest: int, bits: int, flags: bytes, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(flags, dtype=np.uint8), bitorder="little").astype(bool)
        for lang, texts in _chunks(batches, chunk):
            words, at, piece = words_of(texts)
            ids = numbers(lang, words, seed)
            found, n = suffixes_of(at, piece, known[ids & ((1 << bits) - 1)], longest)
            spelt = np.concatenate([[0], ids])
            columns = [pa.array(spelt[found[:, k]]) for k in range(longest)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=[*(f"w{k}" for k in range(longest)), "n"])

    return run


def three_way(keys: np.ndarray, counts: np.ndarray, least: int, large: int = 4096) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(a row of each, depth, counts) of the prefixes that occur ``least`` times or more; key 0 is the end of a suffix.

    Multikey quicksort of row pointers: partitions of more than ``large`` pointers are split
    one by one, the others all at a time.
    """
    todo, small = [(np.arange(len(keys)), 0)], []
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= large:
            small.append((rows, depth))
            continue
        own = keys[rows, depth]
        pivot = own[len(own) // 2]
        equal = rows[own == pivot]
        total = counts[equal].sum()
        parts = [(rows[own < pivot], depth), (rows[own > pivot], depth)]
        if pivot and total >= least:
            yield equal[:1], depth + 1, np.array([total])
            if depth + 1 < keys.shape[1]:
                parts.append((equal, depth + 1))
        todo.extend((r, d) for r, d in parts if len(r) and counts[r].sum() >= least)
    small = [p for p in small if len(p[0])]
    if small:
        yield from _split_all(keys, counts, least, small)


def _split_all(keys: np.ndarray, counts: np.ndarray, least: int, parts: list[tuple[np.ndarray, int]]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """The rest of the sort: ``part`` numbers the open partition of each pointer, ``depth`` is the key that a partition is split by."""
    rows, depth = np.concatenate([r for r, _ in parts]), np.array([d for _, d in parts])
    part = np.repeat(np.arange(len(parts)), [len(r) for r, _ in parts])
    while len(rows):
        sizes = np.bincount(part, minlength=len(depth))
        starts = np.cumsum(sizes) - sizes
        pivot = keys[rows[starts + sizes // 2], depth]
        own = keys[rows, depth[part]]
        split = pivot[part]
        side = (own >= split).astype(np.int64) + (own > split)
        target = 3 * part + side
        weight = counts[rows]
        total = np.bincount(target, weights=weight, minlength=3 * len(depth)).astype(np.int64)
        equal = np.arange(3 * len(depth)) % 3 == 1
        depths = np.repeat(depth, 3) + equal
        alive = (total >= least) & ~(equal & (np.repeat(pivot, 3) == 0))
        # pointers of abandoned partitions go before the others are put in order
        stay = alive[target]
        rows, target = rows[stay], target[stay]
        rows = rows[np.argsort(target, kind="stable")]
        room = np.bincount(target, minlength=3 * len(depth))
        first = np.cumsum(room) - room
        for d in np.unique(depths[alive & equal]):
            some = np.flatnonzero(alive & equal & (depths == d))
            yield rows[first[some]], int(d), total[some]
        deeper = alive & (depths < keys.shape[1])
        part = np.repeat(np.arange(3 * len(depth)), room)
        stay = deeper[part]
        rows, part, depth = rows[stay], (np.cumsum(deeper) - 1)[part[stay]], depths[deeper]


def _counted(least: int, longest: int) -> Callable:
    """(ids, n) of a task's range of suffixes; prefixes at its two ends in any case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"w{k}" for k in range(longest)]
        held = [np.stack([b.column(n).to_numpy() for n in (*names, "n")], axis=1) for b in batches if b.num_rows]
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        keys, counts = rows[:, :longest], rows[:, longest]
        ends: dict[tuple, int] = {}
        for best in (np.min, np.max):
            inside = np.arange(len(keys))
            prefix: tuple = ()
            for k in range(longest):
                value = best(keys[inside, k])
                prefix += (int(value),)
                inside = inside[keys[inside, k] == value]
                if k and value:
                    ends[prefix] = int(counts[inside].sum())
        out = list(ends.items())
        for at, depth, n in three_way(keys, counts, least):
            if depth > 1:
                out.extend((p, c) for p, c in zip(map(tuple, keys[at, :depth].tolist()), n.tolist()) if p not in ends)
        ids = pa.array([list(p) for p, _ in out], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n in out], pa.int64())], names=["ids", "n"])

    return run


def vocabulary(texts: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """(id, lang, word, n) of all words, and the first seed that gives each word a number of its own."""
    for seed in count():
        tallies = texts.mapInArrow(_vocabulary(chunk, seed), "id long, lang string, word string, n long")
        words = stored(tallies.groupBy("id", "lang", "word").agg(F.sum("n").alias("n")))
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed


def bit_set(ids: DataFrame, bits: int) -> bytes:
    """2 ** ``bits`` bits, set where the last ``bits`` bits of some id say; of this size however many ids there are."""
    slot = F.col("id").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    buckets = ids.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("flags")
    )
    flags = bytearray(1 << (bits - 3))
    for r in buckets.collect():
        at = (r["bucket"] - 1) * 4096
        flags[at : at + 4096] = r["flags"]
    return bytes(flags)


def phrases(docs: DataFrame, least: int = 30, longest: int = 4, bits: int = 24, chunk: int = 12 << 20, rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(ids, a) of all phrases of up to ``longest`` words with ``least`` or more occurrences, and the vocabulary (id, lang, word, n)."""
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, seed = vocabulary(texts, chunk)
    frequent = words.filter(F.col("n") >= least)
    keys = [f"w{k}" for k in range(longest)]
    schema = ", ".join(f"{k} long" for k in keys) + ", n long"
    found = stored(texts.mapInArrow(_suffixes(chunk, longest, bits, bit_set(frequent, bits), seed), schema))
    parts = max(found.count() // rows + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    partial = found.repartitionByRange(parts, *keys).mapInArrow(_counted(least, longest), "ids array<long>, n long")
    summed = partial.groupBy("ids").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    return stored(summed.unionByName(frequent.select(F.array("id").alias("ids"), F.col("n").alias("a")))), words


def salts(size: Column) -> Column:
    return F.when(size == 1, F.lit(SALTS[1])).when(size == 2, F.lit(SALTS[2])).otherwise(F.lit(1))


def sorted_side(table: DataFrame) -> DataFrame:
    """``table`` for a join by sorting both sides: the planner sizes exploded rows by the file before, and would broadcast 64 copies of a vocabulary."""
    return table.hint("merge")


def cohesion(found: DataFrame) -> DataFrame:
    """Every phrase of two words or more with its weakest cut: ids, a, l, r, score."""
    long = found.filter(F.size("ids") > 1)
    cuts = long.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    rest = F.size("ids") - F.col("k")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.slice("ids", F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), F.slice("ids", F.col("k") + 1, rest).alias("part")),
    )
    asked = cuts.select("ids", "a", "k", F.inline(sides))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("ids"), salts(F.size("part"))).cast("int"))
    known = found.select(F.col("ids").alias("part"), F.col("a").alias("f"), F.explode(F.sequence(F.lit(0), salts(F.size("ids")) - 1)).alias("salt"))
    met = asked.join(sorted_side(known), ["part", "salt"])
    own = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    by_cut = met.groupBy("ids", "a", "k").agg(own(0).alias("l"), own(1).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = by_cut.withColumn("twice", F.lit(2_000_000).cast("decimal(7,0)") * wide("a")).withColumn("both", wide("l") + wide("r"))
    scored = scored.withColumn("score", F.expr("twice div both"))
    return scored.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("ids", "a", "cut.l", "cut.r", "cut.score")


def not_absorbed(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """Without phrases that a longer one contains which occurs at least ``percent`` as often."""
    size = F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("size")
    inner = candidates.filter(F.size("ids") > 2).select("ids", "a", size)
    inner = inner.withColumn("first", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("size") + 1)))
    longer = inner.select(F.slice("ids", F.col("first"), F.col("size")).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("whole"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    met = candidates.join(sorted_side(longer), "ids", "left")
    return met.filter(F.col("whole").isNull() | (F.lit(100) * wide("whole") < F.lit(percent) * wide("a"))).drop("whole")


def spelt(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with its language and text in place of ids; words of many phrases are spread over a salt."""
    salt = F.pmod(F.xxhash64("ids"), F.lit(SALTS[1])).cast("int")
    asked = found.select("ids", F.posexplode("ids").alias("place", "id"), salt.alias("salt"))
    known = words.select("id", "lang", "word", F.explode(F.sequence(F.lit(0), F.lit(SALTS[1] - 1))).alias("salt"))
    met = asked.join(sorted_side(known), ["id", "salt"]).groupBy("ids").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    text = met.select("ids", "lang", F.array_join(F.transform("w", lambda w: w["word"]), " ").alias("phrase"))
    return found.join(sorted_side(text), "ids").drop("ids")


def mine(docs: DataFrame, most: int = 2000, least: int = 30, percent: int = 80) -> DataFrame:
    """The first ``most`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    found, words = phrases(docs, least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = spelt(not_absorbed(stored(cohesion(found)), percent), words.filter(F.col("n") >= least))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
