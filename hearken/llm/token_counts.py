"""Token counts of whole texts by rank-synchronous merging in arrays.

A text is cut into pre-tokens by the public pattern. The pre-tokens that a worker has not
met are merged together, as one ragged array of symbols: in every step each sequence finds
its pair of lowest rank and merges it (all of its non-overlapping occurrences, from the
left), until no sequence has a mergeable pair. What is left are its tokens. The counts of
pre-tokens are kept in a table of bounded size; that only saves time, any table size gives
the same counts.

Edge cases: a null or empty text has no tokens; special strings inside a text are one token
each, as the library has it by default; a text of any length is counted whole, its
pre-tokens in batches of ``BATCH``; repeated rows are counted each; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.byte_pairs import Vocabulary

BATCH = 20_000
KNOWN = 400_000
NONE = np.iinfo(np.int64).max


def merged_counts(vocabulary: Vocabulary, words: list[bytes]) -> np.ndarray:
    """Number of tokens of each pre-token.

    The symbols of all pre-tokens lie in one array, their owners in another. Sequences
    without a mergeable pair leave the arrays, so the work of a step is that of the rest.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    counts = sizes.copy()
    owner = np.repeat(np.arange(len(words)), sizes)
    symbol = vocabulary.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
    while len(symbol) > 1:
        key = symbol[:-1] * vocabulary.size + symbol[1:]
        at = np.searchsorted(vocabulary.keys, key)
        at[at == len(vocabulary.keys)] = 0
        known = (vocabulary.keys[at] == key) & (owner[:-1] == owner[1:])
        rank = np.where(known, vocabulary.ranks[at], NONE)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.minimum.reduceat(np.r_[rank, NONE], starts)
        lengths = np.diff(np.r_[starts, len(symbol)])
        hit = known & (rank == np.repeat(least, lengths)[:-1])
        places = np.flatnonzero(hit)
        if not len(places):
            break
        # In a run of overlapping pairs (a a a) every second one merges, from the left.
        run = np.r_[True, np.diff(places) > 1]
        first = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - first) % 2 == 0]
        symbol[places] = vocabulary.merged[at[places]]
        stay = np.ones(len(symbol), dtype=bool)
        stay[places + 1] = False
        counts -= np.bincount(owner[places], minlength=len(words))
        live = np.repeat(least < NONE, lengths) & stay
        symbol, owner = symbol[live], owner[live]
    return counts


class Counts:
    """Token counts of texts; remembers those of pre-tokens."""

    _open: dict[str, "Counts"] = {}

    def __init__(self, path: str):
        self.vocabulary = Vocabulary.open(path)
        self.known: dict[str, int] = {}

    @classmethod
    def open(cls, path: str) -> "Counts":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def of(self, texts: list[str]) -> list[int]:
        """Counts of a few texts, their new pre-tokens merged together."""
        known, find = self.known, self.vocabulary.pre.findall
        if len(known) > KNOWN:
            known.clear()
        cut = []
        for text in texts:
            parts = self.vocabulary.parts(text)
            cut.append((sum(i is not None for _, i in parts), [w for p, i in parts if i is None for w in find(p)]))
        new = list({w: None for _, words in cut for w in words if w not in known})
        for a in range(0, len(new), BATCH):
            some = new[a : a + BATCH]
            known.update(zip(some, merged_counts(self.vocabulary, [w.encode("utf-8", "surrogatepass") for w in some]).tolist()))
        return [special + sum(map(known.__getitem__, words)) for special, words in cut]


def _grouped(texts: Iterator[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in groups of about ``most`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts.open(path)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column("text"))
            n = [c for group in _grouped(texts) for c in counts.of(group)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit per document; ``path`` is a byte-level vocabulary file."""
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_.alias("n_bytes"), "text")
    out = slim.mapInArrow(_count(path), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
