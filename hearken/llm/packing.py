"""Token sequences of fixed length by hierarchical residual best-fit packing.

Documents become pieces of at most ``size`` tokens; a task packs its own pieces best-fit,
largest first. Bins that are full but for a few tokens leave at once as sequences. The
others become items of the next round, where neighbouring partitions meet: bins are merged
best-fit into each other, again the full ones leave, until one partition is left.

Two bins over half full never fit into one. Before each round only the bins up to half full
therefore go on, and against them as many fuller ones as can take one, the emptiest first;
all others leave. After best-fit a task has at most one bin up to half full in each ``chunk``
of items, so a round holds at most two bins for each chunk of the one before, at any size of
the input, and none leaves that could have been merged.

Edge cases: a null or empty text is the end-of-document token alone, one piece of length 1;
a document longer than ``size`` is cut from its end, so that only its first piece is short;
repeated rows are packed as often as they occur; a null doc_id stays null; an empty table
gives no sequences. Tokens themselves are not moved: a piece carries its place and
checksum. A retried task packs the same rows, because every round reads a written table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearken.llm.byte_pairs import Vocabulary
from hearken.llm.common import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Runs of blanks that one of the two encoders cannot read; all but the last character of such a run is one pre-token.
LONG_RUN = regex.compile(r"\s{100000,}+")


class Encoder:
    """Ids of whole texts as the library of the vocabulary file gives them, and bytes of ids.

    Special strings in texts are single tokens. Ranks are rebuilt from the vocabulary file
    for a faster encoder of the same pre-tokens and merges; it stops at very long runs of
    blanks, which therefore go to the library itself.
    """

    _open: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        v = Vocabulary.open(path)
        ranks = {v.bytes_of[i]: i for t, i in v.ids.items() if t not in v.special}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=v.special)
        self.library = Tokenizer.from_file(path)

    @classmethod
    def open(cls, path: str) -> "Encoder":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __call__(self, text: str | None) -> np.ndarray:
        text, at, parts = text or "", 0, []
        for run in LONG_RUN.finditer(text):
            # the last character of the run may belong to the word behind it
            end = run.end() - (run.end() < len(text))
            parts.append(self._plain(text[at : run.start()]))
            parts.append(self.library.encode(text[run.start() : end], add_special_tokens=False).ids)
            at = end
        parts.append(self._plain(text[at:]))
        return np.concatenate([np.array(p, dtype="<u4") for p in parts])

    def _plain(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special="all", disallowed_special=())

    def decode(self, ids: list[int]) -> bytes:
        return self.core.decode_bytes(ids)


def pieces_of(ids: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document; only the first may be short."""
    head = len(ids) % size
    cuts = [0, *range(head or size, len(ids) + 1, size)]
    return [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts, cuts[1:])]


def _cut(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder.open(path), np.zeros(1, dtype="<u4")
        for batch in batches:
            rows = [
                (doc.as_py(), i, a, n, crc)
                for doc, text in zip(batch.column("doc_id"), batch.column("text"))
                for i, (a, n, crc) in enumerate(pieces_of(np.concatenate([encode(text.as_py()), end]), size))
            ]
            cols = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers; items in falling size go where the least room is left. Rooms are found by a bit set."""
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    bins: list[list[int]] = []
    free = 0
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[k]
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = size, len(bins)
            bins.append([k])
        left = room - n
        if left:
            rooms[left].append(b)
            free |= 1 << left
    return bins


MEMBER = ("doc_id", "piece", "start", "length", "ids_crc32")
BINS = "sequence_id long, open boolean, fill int, doc_id array<long>, piece array<int>, start array<long>, length array<long>, ids_crc32 array<long>"
ARROW = pa.schema(
    [("sequence_id", pa.int64()), ("open", pa.bool_()), ("fill", pa.int32())]
    + [(n, pa.list_(pa.int32() if n == "piece" else pa.int64())) for n in MEMBER]
)


def _pack(size: int, slack: int, chunk: int, level: int):
    """Best-fit over the rows of a task, ``chunk`` items at a time; the items are pieces or open bins."""

    def emit(items: list[tuple], first: int) -> pa.RecordBatch:
        items.sort(key=lambda r: (-r[0], r[5], r[3]))
        out = []
        for k, members in enumerate(best_fit([r[0] for r in items], size)):
            fill = sum(items[m][0] for m in members)
            joined = [[x for m in members for x in items[m][c]] for c in range(1, len(MEMBER) + 1)]
            out.append((first + k, size - fill > slack, fill, *joined))
        cols = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (level << 56) | (TaskContext.get().partitionId() << 32)
        items: list[tuple] = []
        for batch in batches:
            items.extend(zip(*(batch.column(n).to_pylist() for n in ("fill", *MEMBER))))
            if len(items) >= chunk:
                done = emit(items, name)
                name, items = name + done.num_rows, []
                yield done
        if items:
            yield emit(items, name)

    return run


def pack(docs: DataFrame, path: str, size: int = 2048, slack: int = 4, fan_in: int = 8, chunk: int = 100_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``slack`` is the room that a bin may keep to count as full, ``fan_in`` the number of
    partitions that meet in a round, ``chunk`` the number of items packed together.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(slim.mapInArrow(_cut(path, size), PIECES))
    short = pieces.filter(F.col("length") < size)
    items = short.select(F.col("length").cast("int").alias("fill"), *[F.array(c).alias(c) for c in MEMBER])
    done: list[DataFrame] = []
    level, tasks = 0, items.rdd.getNumPartitions()
    while True:
        packed = stored(items.mapInArrow(_pack(size, slack, chunk, level), BINS))
        left = packed.filter("open")
        small = F.col("fill") * 2 <= size
        count, takers, least = left.agg(F.count(F.lit(1)), F.count_if(small), F.min("fill")).first()
        done.append(packed.filter("not open"))
        if not takers or count == 1 or tasks == 1:
            done.append(left)
            break
        full = left.filter(~small)
        fits = full.filter(F.col("fill") + least <= size)
        # the fill up to which there are as many fuller bins as small ones: one row per fill at most
        fills, among = {}, 0
        for fill, n in fits.groupBy("fill").count().orderBy("fill").collect():
            fills[fill], among = max(0, min(n, takers - among)), among + n
        turn = F.row_number().over(Window.partitionBy("fill").orderBy("sequence_id"))
        quota = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in fills.items() for v in kv]), F.col("fill")), F.lit(0)) if fills else F.lit(0)
        marked = stored(full.withColumn("goes", turn <= quota)) if fills else full.withColumn("goes", F.lit(False))
        done.append(marked.filter("not goes").drop("goes"))
        left = left.filter(small).unionByName(marked.filter("goes").drop("goes"))
        level, tasks = level + 1, -(-tasks // fan_in)
        items = left.select("fill", *MEMBER).coalesce(tasks)
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    ends = F.aggregate("length", F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    laid = bins.withColumn("offset", F.slice(ends, F.lit(1), F.size("length")))
    one = laid.select("sequence_id", F.inline(F.arrays_zip(*MEMBER, "offset")))
    alone = pieces.filter(F.col("length") == size).select(
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), *MEMBER, F.lit(0).cast("long").alias("offset")
    )
    names = [*MEMBER, "sequence_id", "offset"]
    return one.select(*names).unionByName(alone.select(*names))
