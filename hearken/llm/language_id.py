"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``dims`` signs, drawn from its code point, so that all
tasks know it without a table; the gap between words has one too. An n-gram is the product
of its letters' vectors, each rotated by its place; a text is the sum of its n-grams. The
prototype of a language is the sum over its training texts. Vectors of different n-grams
are nearly orthogonal, so the cosine of a text with a prototype compares their n-gram
frequencies in a fixed number of dimensions.

Sums are exact integers. The prototypes are bundled from counts per (language, n-gram), which
Spark sums map-side, so a language with most rows is no hot spot and the result does not
depend on the order of rows. A prototype is one row per language; languages are the values
of a column and ``most_languages`` bounds them (an error beyond, nothing is cut).

Whole texts are read, folded to lower case. A text of more than ``piece`` letters is
counted in pieces, so its n-grams are never all in memory.

Edge cases: a null text, or one without any letter (Unicode class L), is ``und`` with score
0; training rows without a language are not used; without any training text all rows are
``und``; ties of cosines go to the least language; repeated rows count as often as they
occur; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import stored

GAP = 0
UNKNOWN = "und"
#: Letters that a task keeps the vectors of, and the n-grams that it handles at once.
KEPT_LETTERS, KEPT_GRAMS = 4096, 4096


class Letters:
    """Sign vectors of code points, and which code points are letters."""

    def __init__(self, dims: int, order: int, seed: int):
        self.dims, self.order, self.seed = dims, order, seed
        self.is_letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            if len(self.vectors) >= KEPT_LETTERS:
                self.vectors.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 256, self.dims // 8, dtype=np.uint8)
            self.vectors[code] = (np.unpackbits(bits).astype(np.int8) << 1) - 1
        return self.vectors[code]

    def grams(self, text: str, piece: int) -> Iterator[np.ndarray]:
        """The text's n-grams as rows of code points, ``piece`` at a time; runs of other characters, and both ends, are one gap."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.concatenate([[GAP], np.where(self.is_letter[codes], codes, np.uint32(GAP)), [GAP]]).astype(np.uint32)
        codes = codes[np.concatenate([[True], (codes[1:] != GAP) | (codes[:-1] != GAP)])]
        for a in range(0, len(codes) - self.order + 1, piece):
            yield np.lib.stride_tricks.sliding_window_view(codes[a : a + piece + self.order - 1], self.order)

    def counts(self, text: str, piece: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of a text, as one integer each, and how often they occur; none if it has no letter."""
        codes, n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for grams in self.grams(text, piece):
            own, count = np.unique(packed(grams), return_counts=True)
            codes, n = merged([(codes, n), (own, count)]) if len(codes) else (own, count)
        return (codes, n) if codes.any() else (codes[:0], n[:0])

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams: letters rotated by their distance from the end, multiplied."""
        out = np.ones((len(grams), self.dims), dtype=np.int8)
        for place in range(self.order):
            letters, which = np.unique(grams[:, place], return_inverse=True)
            turned = np.stack([np.roll(self.vector(int(c)), self.order - 1 - place) for c in letters])
            out *= turned[which]
        return out


def packed(grams: np.ndarray) -> np.ndarray:
    """N-grams of up to three code points as one integer each."""
    out = np.zeros(len(grams), dtype=np.int64)
    for place in range(grams.shape[1]):
        out = (out << 21) | grams[:, place]
    return out


def unpacked(codes: np.ndarray, order: int) -> np.ndarray:
    return np.stack([(codes >> (21 * (order - 1 - p))) & ((1 << 21) - 1) for p in range(order)], axis=1)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several texts as one."""
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _tally(dims: int, order: int, seed: int, piece: int) -> Callable:
    """(lang, gram, n) summed over each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(dims, order, seed)
        for batch in batches:
            parts: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                parts.setdefault(lang, []).append(letters.counts(text.as_py(), piece))
            for lang, found in parts.items():
                codes, n = merged(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

    return run


def _bundle(dims: int, order: int, seed: int) -> Callable:
    """(lang, dim, total) of a task's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(dims, order, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, codes, n = np.array(batch.column("lang").to_pylist()), batch.column("gram").to_numpy(), batch.column("n").to_numpy()
            for lang in set(langs.tolist()):
                own = np.flatnonzero(langs == lang)
                total = sums.setdefault(lang, np.zeros(dims, dtype=np.int64))
                for a in range(0, len(own), KEPT_GRAMS):
                    some = own[a : a + KEPT_GRAMS]
                    total += n[some] @ letters.bind(unpacked(codes[some], order))
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims, pa.string()), pa.array(range(dims), pa.int32()), pa.array(total)], names=["lang", "dim", "total"])

    return run


def prototypes(texts: DataFrame, dims: int = 2048, order: int = 3, seed: int = 1, piece: int = 1 << 20, most_languages: int = 1000) -> DataFrame:
    """(lang, vector): the bundled n-grams of the training texts of each language (columns text, lang)."""
    if order > 3 or dims % 8:
        raise ValueError("an n-gram has at most three letters and dims is a multiple of 8")
    known = texts.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    tallies = known.mapInArrow(_tally(dims, order, seed, piece), "lang string, gram long, n long")
    counts = stored(tallies.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    if counts.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    summed = counts.mapInArrow(_bundle(dims, order, seed), "lang string, dim int, total long").groupBy("lang", "dim").agg(F.sum("total").alias("total"))
    pairs = F.array_sort(F.collect_list(F.struct("dim", "total")))
    return stored(summed.groupBy("lang").agg(F.transform(pairs, lambda p: p["total"]).alias("vector")))


def _compare(langs: list[str], matrix: np.ndarray, dims: int, order: int, seed: int, piece: int, names: list[str]) -> Callable:
    """Adds the nearest prototype and its cosine."""
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(dims, order, seed)
        for batch in batches:
            best, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for rows, vectors in _vectors(batch, letters, piece):
                length = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ unit.T) / np.maximum(length, 1e-300)[:, None]
                for row, found in zip(rows, cosines):
                    k = int(found.argmax())
                    best[row], score[row] = langs[k], min(max(found[k], 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(best, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def _vectors(batch: pa.RecordBatch, letters: Letters, piece: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """(rows, vectors) of the texts with letters, in groups of a bounded number of n-grams; a group binds each n-gram once."""

    def group(held: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[list[int], np.ndarray]:
        codes, where = np.unique(np.concatenate([c for _, c, _ in held]), return_inverse=True)
        owner = np.repeat(np.arange(len(held)), [len(c) for _, c, _ in held])
        counts = np.zeros((len(held), len(codes)))
        counts[owner, where] = np.concatenate([n for _, _, n in held])
        exact = np.float32 if counts.sum(axis=1).max() < 1 << 24 else np.float64  # sums of whole numbers stay exact
        total = np.zeros((len(held), letters.dims))
        for a in range(0, len(codes), KEPT_GRAMS):
            bound = letters.bind(unpacked(codes[a : a + KEPT_GRAMS], letters.order)).astype(exact)
            total += counts[:, a : a + KEPT_GRAMS].astype(exact) @ bound
        return [r for r, _, _ in held], total

    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    fill = 0
    for row, text in enumerate(batch.column("text")):
        codes, n = letters.counts(text.as_py() or "", piece)
        if not len(codes):
            continue
        held.append((row, codes, n))
        fill += len(codes)
        if fill > 16 * KEPT_GRAMS or len(held) == 256:
            yield group(held)
            held, fill = [], 0
    if held:
        yield group(held)


def predict(docs: DataFrame, found: DataFrame, keep: tuple[str, ...] = ("doc_id",), dims: int = 2048, order: int = 3, seed: int = 1, piece: int = 1 << 20) -> DataFrame:
    """The columns ``keep`` with lang_pred and score (the cosine, at least 0) of every text."""
    rows = found.orderBy("lang").collect()  # one vector a language, at most ``most_languages``
    langs, matrix = [r["lang"] for r in rows], np.array([r["vector"] for r in rows], dtype=np.float64)
    slim = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keep).schema) + ", lang_pred string, score double"
    if not langs:
        return slim.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return slim.mapInArrow(_compare(langs, matrix, dims, order, seed, piece, list(keep)), schema)


def identify(docs: DataFrame, held_out: str = "held_out") -> DataFrame:
    """doc_id, ``held_out``, lang_pred and score per document; prototypes come from the rows that are not held out."""
    found = prototypes(docs.filter(~F.col(held_out)))
    return predict(docs, found, ("doc_id", held_out))
