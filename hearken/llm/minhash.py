"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets.

Two permutations make every coordinate of a signature: the first scrambles the shingle
universe, the second is shifted circularly by one more step for each coordinate and its
minimum taken. Both are bijections of the 64-bit ring. Signatures are cut into bands;
documents that share a band are candidates.

Links are confirmed exactly, and components need only enough links to hold together:

1. documents with equal sets are one class (map-side combined), whatever their number;
2. in each band bucket every class is compared with one leader, the member that shares its
   bands with most others. Large groups of copies come together with as many comparisons
   as members;
3. in buckets that still span several components, pairs across components are compared by
   signature, block against block inside tasks. For every class and other component only
   the likeliest partner comes out and is confirmed;
4. a class that still has a plausible partner in another component is compared with that
   whole component by full sets, again block against block.

So no plausible pair across components stays untested: a link is lost only if its pair
shares no band, or agrees in fewer coordinates than ``AGREE``; at a similarity of exactly
0.8 the chances are 5e-8 and at most 8e-6 (binomial tails), and less above.

Edge cases: a text without words has an empty set and is linked with nothing; null texts
count as empty; a null doc_id never represents a group that has an id; repeated rows are
copies; an empty table gives an empty result. Memory of a task holds one batch of texts
or two blocks of signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import join_hot, row_key, stored
from hearken.llm.components import components

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
AGREE = 82
BLOCK = 512
SETS = 128
CACHE = 300_000
U = np.uint64
SHIFT = U(0x9E3779B97F4A7C15)


def _first(x: np.ndarray) -> np.ndarray:
    """First permutation of the 64-bit ring: odd multiplications and shifts, each of which is a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Minimum over the set of the second permutation, shifted by k steps of the ring for coordinate k."""
    steps = np.arange(coordinates, dtype=U) * SHIFT
    best = np.full(coordinates, U(0xFFFFFFFFFFFFFFFF))
    placed = _first(shingles)
    for at in range(0, len(placed), 256):
        x = placed[at : at + 256, None] + steps
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(29)
        np.minimum(best, x.min(axis=0), out=best)
    return best


class Shingler:
    """Shingle sets of texts; word hashes are kept in a table of bounded size."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def words(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known, out = self.known, np.empty(len(found), dtype=U)
        if len(known) > CACHE:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        out[:] = list(map(known.__getitem__, found))
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of all word shingles; a shorter text is one shingle; no words, no shingle."""
        w = self.words(text)
        if not len(w):
            return w
        k = min(self.width, len(w))
        h = np.full(len(w) - k + 1, U(k))
        for i in range(k):
            h = _first((h ^ w[i : len(w) - k + 1 + i]) * U(0xFF51AFD7ED558CCD) + U(i + 1))
        return np.unique(h)


SIGNED = "k_id long, k_fp long, doc_id long, cls string, n_shingles long, bands array<long>, sig binary"


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            cols = {n: batch.column(n) for n in ("k_id", "k_fp", "doc_id")}
            out = {"cls": [], "n_shingles": [], "bands": [], "sig": []}
            for text in batch.column("text"):
                s = shingle(text.as_py())
                out["n_shingles"].append(len(s))
                if not len(s):
                    for n in ("cls", "bands", "sig"):
                        out[n].append(None)
                    continue
                coordinates = signature(s)
                out["cls"].append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                bands = coordinates.reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=U) + U(1)
                for r in range(ROWS):
                    key = _first(key * U(0xFF51AFD7ED558CCD) ^ bands[:, r])
                out["bands"].append(key.view(np.int64))
                out["sig"].append((coordinates >> U(17)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*cols.values(), pa.array(out["cls"], pa.string()), pa.array(out["n_shingles"], pa.int64()),
                 pa.array(out["bands"], pa.list_(pa.int64())), pa.array(out["sig"], pa.binary())],
                names=[*cols, *out],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sets = [shingle(t.as_py()) for t in batch.column("text")]
            names = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cls", "set"]
            )

    return run


def keyed(docs: DataFrame) -> DataFrame:
    ident = F.col("doc_id").cast("long")
    return docs.select(*row_key(ident, F.col("text")), ident.alias("doc_id"), "text")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets meet the threshold. Pairs of a common leader are split by Spark's skew join."""
    left = sets.select(F.col("cls").alias("u"), F.col("set").alias("su"))
    right = sets.select(F.col("cls").alias("v"), F.col("set").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    joined = pairs.join(left, "u").join(right, "v").withColumn("both", both)
    return joined.filter(100 * F.col("both") >= percent * (F.size("su") + F.size("sv") - F.col("both"))).select("u", "v")


def _to_leader(buckets: DataFrame) -> DataFrame:
    """Pairs of each member and the leader of its bucket, where both are in different components.

    The leader is the member that shares its bands with most others, the middle of a group of copies.
    """
    first = F.max(F.struct("fame", F.col("cls").alias("v"), F.col("root").alias("r"))).alias("lead")
    lead = buckets.groupBy("bucket").agg(first)
    pairs = buckets.join(lead, "bucket").filter("root <> lead.r").select(F.least("cls", "lead.v").alias("u"), F.greatest("cls", "lead.v").alias("v"))
    return pairs.distinct()


def _plausible(buckets: DataFrame) -> DataFrame:
    """(x, root, y): for members of a bucket and every other component in it whose signatures could belong to linked sets, the likeliest partner.

    Members outside the bucket's largest component are compared with all members, each pair
    only in the first bucket that it shares, told by the keys of the buckets themselves: the
    bytes of a signature can agree in a band without a common bucket. Both sides are cut into
    blocks, so a bucket of any size is many bounded tasks.
    """
    part = buckets.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = part.groupBy("bucket").agg(
        F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")
    ).filter("parts > 1").select("bucket", "most.root", F.col("all") - F.col("most.n"), "all").toDF("bucket", "main", "few", "all")
    sized = buckets.join(main, "bucket").withColumns(
        {"nl": _blocks("few", BLOCK), "nr": _blocks("all", BLOCK), "row": F.struct("cls", "root", "n_shingles", "sig", "bands")}
    )
    ask = sized.filter("root <> main").select("bucket", "band", _block("cls", "nl").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), "row")
    told = sized.select("bucket", "band", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), _block("cls", "nr").alias("j"), "row")
    keys = ["bucket", "band", "i", "j"]
    a = ask.groupBy(*keys).agg(F.collect_list("row").alias("a"))
    b = told.groupBy(*keys).agg(F.collect_list("row").alias("b"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for band, left, right in zip(batch.column("band").to_pylist(), batch.column("a"), batch.column("b")):
                x, y = left.as_py(), right.as_py()
                sx, sy = (np.frombuffer(b"".join(r["sig"] for r in z), dtype=np.uint8).reshape(len(z), -1) for z in (x, y))
                bx, by = (np.array([r["bands"] for r in z], dtype=np.int64) for z in (x, y))
                nx, ny = (np.array([r["n_shingles"] for r in z]) for z in (x, y))
                ry = np.array([r["root"] for r in y])
                for k in range(len(x)):
                    at = np.flatnonzero((np.minimum(nx[k], ny) * 5 >= np.maximum(nx[k], ny) * 4) & (ry != x[k]["root"]))
                    same = (sy[at] == sx[k]).sum(axis=1)
                    at, same = at[same >= AGREE], same[same >= AGREE]
                    here = (by[at] == bx[k]).argmax(axis=1) == band
                    best: dict[str, tuple[int, str]] = {}
                    for m, n in zip(at[here], same[here]):
                        best[ry[m]] = max(best.get(ry[m], (0, "")), (int(n), y[m]["cls"]))
                    out += [(x[k]["cls"], r, n, c) for r, (n, c) in best.items()]
            cols = list(zip(*out)) or [[]] * 4
            types = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["x", "root", "n", "y"])

    met = a.join(b, keys).select("band", "a", "b").mapInArrow(meet, "x string, root string, n int, y string")
    return met.groupBy("x", "root").agg(F.max(F.struct("n", "y")).alias("b")).select("x", "root", "b.y")


def _blocks(count: str, size: int) -> Column:
    return F.ceil(F.col(count) / size).cast("int")


def _block(name: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(name), F.col(blocks)).cast("int")


def _size_class(n: Column) -> Column:
    """Sets that can be linked are at most one class apart."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(1.25)))).cast("int")


def _with_component(wanted: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between each x of ``wanted`` (x, root) and the members of that component, all of them compared by full sets.

    Members of a component are blocked by size class and hash, the askers by hash; an asker
    meets only blocks of sizes near its own. A block gives at most one link per asker.
    """
    sized = sets.select("cls", "set", F.size("set").alias("n"), _size_class(F.size("set")).alias("c"))
    asked = wanted.groupBy("root").agg(F.count(F.lit(1)).alias("askers"))
    members = roots.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    size = stored(asked.join(members, "root").select("root", "members", "askers", _blocks("members", SETS).alias("nr"), _blocks("askers", SETS).alias("nl")))
    of = lambda n: size.select("root", "nr", "nl", F.col(n).alias("n"))
    told = join_hot(roots, of("members"), "root", roots.count()).join(sized, "cls").select(
        "root", "c", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), _block("cls", "nr").alias("j"), F.struct("cls", "set").alias("row")
    )
    ask = join_hot(wanted, of("askers"), "root", wanted.count()).join(sized.withColumnRenamed("cls", "x"), "x").select(
        "root", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"), _block("x", "nl").alias("i"), "nr", F.struct(F.col("x").alias("cls"), "set").alias("row")
    )
    ask = ask.select("root", "c", "i", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), "row")
    keys = ["root", "c", "i", "j"]
    a = ask.groupBy(*keys).agg(F.collect_list("row").alias("a"))
    b = told.groupBy(*keys).agg(F.collect_list("row").alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for left, right in zip(batch.column("a"), batch.column("b")):
                y = right.as_py()
                names = [r["cls"] for r in y]
                members = [np.array(r["set"], dtype=np.int64) for r in y]
                sizes = np.array([len(m) for m in members])
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                flat = np.concatenate(members)
                for row in left.as_py():
                    own = np.sort(np.array(row["set"], dtype=np.int64))
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    both = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
                    hit = np.flatnonzero(100 * both >= percent * (len(own) + sizes - both))
                    if len(hit):
                        p, q = row["cls"], names[hit[0]]
                        u.append(min(p, q))
                        v.append(max(p, q))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], names=["u", "v"])

    return a.join(b, keys).select("a", "b").mapInArrow(compare, "u string, v string")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (cls, root) with the components that ``links`` (u, v) tie together made one."""
    if links.isEmpty():
        return roots
    ends = links.join(roots.toDF("u", "ru"), "u").join(roots.toDF("v", "rv"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    tied = components(ends).select(F.col("id").alias("root"), F.col("root").alias("to"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    moved = stored(sizes.join(tied, "root", "left").select("root", F.coalesce("to", "root").alias("to"), "n"))
    return stored(join_hot(roots, moved, "root", roots.count()).select("cls", F.col("to").alias("root")))


def linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """k_id, k_fp, doc_id, n_shingles, component_id and ``first`` (this row's key represents the component) per document.

    Bands, ``AGREE`` and the size rules are made for 80 percent; above it they lose less, below it they would lose links.
    """
    if percent < 80:
        raise ValueError(f"percent is {percent}; below 80 the bands and size rules would lose links")
    own = keyed(docs)
    signed = stored(own.mapInArrow(_sign(width), SIGNED))
    named = signed.filter(F.col("cls").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "k_id", "k_fp")
    classes = stored(
        named.groupBy("cls").agg(
            F.min(order).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
        )
    )
    member = classes.select("cls", F.posexplode("bands").alias("band", "bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = stored(member.join(shared, "bucket"))
    fame = found.groupBy("cls").agg(F.sum("n").alias("fame"))
    close = classes.join(fame, "cls")
    texts = own.join(close.select("rep.k_id", "rep.k_fp"), ["k_id", "k_fp"], "left_semi").dropDuplicates(["k_id", "k_fp"])
    sets = stored(texts.select("text").mapInArrow(_sets(width), "cls string, set array<long>"))
    state = stored(close.select("cls", "n_shingles", "sig", "bands", "fame"))
    roots = state.select("cls", F.col("cls").alias("root"))
    buckets = found.select("bucket", "band", "cls").join(roots, "cls").join(state.select("cls", "fame"), "cls")
    roots = _merged(roots, stored(_confirm(_to_leader(buckets), sets, percent)))
    buckets = found.select("bucket", "band", "cls").join(roots, "cls").join(state, "cls")
    near = stored(_plausible(buckets))
    if not near.isEmpty():
        pairs = near.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        roots = _merged(roots, stored(_confirm(pairs, sets, percent)))
        ends = near.join(roots.toDF("x", "rx"), "x").join(roots.toDF("y", "ry"), "y")
        open_ = stored(ends.filter("rx <> ry").select("x", F.col("ry").alias("root")).distinct())
        if not open_.isEmpty():
            roots = _merged(roots, stored(_with_component(open_, roots, sets, percent)))
    rooted = classes.select("cls", "rep").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = stored(rooted)
    least = stored(rooted.groupBy("root").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")))
    by_class = join_hot(rooted, least, "root", rooted.count()).select(F.col("cls").alias("c"), "lead")
    out = signed.select("k_id", "k_fp", "doc_id", "n_shingles", "cls").join(by_class, F.col("cls") == F.col("c"), "left")
    own_id = F.when(F.col("lead").isNull(), F.col("doc_id")).when(~F.col("lead.none"), F.col("lead.k_id"))
    alone = F.col("lead").isNull()
    first = alone | ((F.col("lead.k_id") == F.col("k_id")) & (F.col("lead.k_fp") == F.col("k_fp")))
    return out.select("k_id", "k_fp", "doc_id", "n_shingles", own_id.alias("component_id"), first.alias("first"), alone.alias("alone"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per document; kept is false for a row without an id."""
    out = linked(docs, width, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with exactly its own columns; texts without words all stay."""
    keep = linked(docs, width, percent).filter("first").select("k_id", "k_fp", "alone").distinct()
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.struct(*docs.columns).alias("row"))
    kept = rows.join(keep, ["k_id", "k_fp"])
    one = kept.filter(~F.col("alone")).dropDuplicates(["k_id", "k_fp"])
    return one.unionByName(kept.filter("alone")).select("row.*")
