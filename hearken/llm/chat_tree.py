"""Conversations as one prefix tree of tokens.

Each turn is formatted as ``<|im_start|>role\\n text <|im_end|>\\n`` (without the blanks).
Inside texts and roles ``<|`` is broken by an escape character, which is escaped itself, so
no text can open or close a turn and every text can be read back.

A node of the tree is a turn together with all turns before it, named by a chain of hashes;
a conversation's path is the names of its nodes, so equal openings share nodes. Different
conversations are sorted by path, which is depth-first order, and streamed: a node is emitted
when a conversation leaves it, so a task holds the nodes of one conversation and a row is
written per node, whatever the number of turns. Every node carries its token ids, its place
in the token stream, the position id of its first token (the tokens of its ancestors come
before it), the loss span, and the interval of the stream that may attend to it: itself and
its descendants, ``[start, visible_until)``. A token thus attends to the earlier tokens of
those nodes whose interval holds it, which are its ancestors and itself. ``intervals`` lists
them for each conversation.

Tasks take ranges of paths. A range begins with the ancestors that it shares with the range
before (rows marked ``again``), so each can be read alone; they are found as the nodes that
are open at the end of a range, merged by name, and left out of the stream and its places.
Copies of a conversation are merged map-side before the sort, and openings are shared by
neighbours in the order, so an opening or a conversation that a third of all rows have is no
hot spot.

Edge cases: null texts and roles are empty; rows of a conversation are ordered by turn, then
role and text, so ties and repeated rows have a defined place; a null conv_id is one
conversation; a conversation must fit one task; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import stored
from hearken.llm.packing import Encoder

START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "␛"
#: Bytes of a node's name.
NAME = 16
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return text.replace(ESCAPE, ESCAPE + "0").replace("<|", f"<{ESCAPE}1|")


def unescape(text: str) -> str:
    return text.replace(f"<{ESCAPE}1|", "<|").replace(ESCAPE + "0", ESCAPE)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", f"{ESCAPE}2")


def unescape_role(role: str) -> str:
    return unescape(role.replace(f"{ESCAPE}2", "\n"))


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns of each conversation in order."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns.alias("turns"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each conversation's path, and the name of its last node."""
    for batch in batches:
        paths, leaves = [], []
        for turns in batch.column("turns"):
            name, path = b"", []
            for turn in turns:
                role, text = turn["role"].as_py().encode(), turn["text"].as_py().encode()
                name = hashlib.sha256(name + len(role).to_bytes(8, "big") + role + text).digest()[:NAME]
                path.append(name)
            paths.append(b"".join(path))
            leaves.append(name)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.binary()), pa.array(leaves, pa.binary())], names=[*batch.schema.names, "path", "leaf"])


class _Open:
    """A node that the conversation at hand passes."""

    __slots__ = ("name", "parent", "depth", "ids", "place", "first_position", "loss_from", "loss_length", "n", "ends", "head")

    def row(self, part: int, stop: int, last: bool) -> tuple:
        return (part, self.place, stop, self.depth, self.name, self.parent, self.ids, len(self.ids), self.first_position, self.loss_from, self.loss_length, self.n, self.ends, self.head, last)


NODES = (
    "part int, place long, stop long, depth int, node binary, parent binary, ids array<int>, length long, first_position long,"
    " loss_from int, loss_length int, n_conversations long, ends boolean, head boolean, last boolean"
)
TYPES = (
    pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(),
    pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(),
)


def _emit(path: str):
    """The nodes of a range of sorted different conversations, each when it is left."""
    names = [x.strip().split(" ")[0] for x in NODES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder.open(path), TaskContext.get().partitionId()
        tail = encode(f"{END}\n").tolist()
        held: list[_Open] = []
        done: list[tuple] = []
        at, first = 0, True

        def leave(depth: int, last: bool = False) -> None:
            while len(held) > depth:
                node = held.pop()
                if held:
                    held[-1].n += node.n
                done.append(node.row(part, at, last))

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [[]] * len(TYPES), TYPES)], names=names)
            done.clear()
            return out

        for batch in batches:
            for chain, turns, n in zip(batch.column("path"), batch.column("turns"), batch.column("n")):
                chain, common = chain.as_py(), 0
                while common < len(held) and chain[common * NAME : (common + 1) * NAME] == held[common].name:
                    common += 1
                leave(common)
                for depth in range(common, len(turns)):
                    role, text = turns[depth]["role"].as_py(), turns[depth]["text"].as_py()
                    head, body = encode(f"{START}{escape_role(role)}\n").tolist(), encode(escape(text)).tolist()
                    node = _Open()
                    node.name, node.parent, node.depth = chain[depth * NAME : (depth + 1) * NAME], held[-1].name if held else None, depth
                    node.ids, node.place = head + body + tail, at
                    node.first_position = held[-1].first_position + len(held[-1].ids) if held else 0
                    node.loss_from, node.loss_length = len(head), len(body) if role == "assistant" else 0
                    node.n, node.ends, node.head = 0, False, first
                    at += len(node.ids)
                    held.append(node)
                held[-1].n, held[-1].ends, first = held[-1].n + n.as_py(), True, False
            yield batch_of()
        leave(0, True)
        yield batch_of()

    return run


@dataclass
class Tree:
    """``nodes`` by (part, place) with those that a part repeats (``again``), and ``members``: (conv_id, leaf)."""

    nodes: DataFrame
    members: DataFrame

    @property
    def stream(self) -> DataFrame:
        """The emitted nodes: node, parent, depth, ids, length, start, first_position, visible_until, loss span, n_conversations."""
        return self.nodes.filter("not again").drop("again", "part", "place", "ends")


def build(rows: DataFrame, path: str) -> Tree:
    schema = "conv_id long, turns array<struct<role:string,text:string>>, path binary, leaf binary"
    whole = stored(turns_of(rows).mapInArrow(_named, schema))
    different = whole.groupBy("path").agg(F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n"))
    ordered = different.repartitionByRange("path").sortWithinPartitions("path")
    laid = stored(ordered.mapInArrow(_emit(path), NODES))
    # Only a range's first and last conversations have nodes in other ranges.
    open_ = laid.filter("head or last").select("node", "part", "place", "stop", "length", "n_conversations")
    home = stored(open_.groupBy("node").agg(F.min("part").alias("home"), F.count(F.lit(1)).alias("parts"), F.sum("n_conversations").alias("n_all")).filter("parts > 1"))
    again = F.coalesce(F.col("part") > F.col("home"), F.lit(False)).alias("again")
    marked = laid.join(home, "node", "left").withColumn("again", again)
    sums = marked.groupBy("part").agg(F.sum("length").alias("all"), F.sum(F.when(F.col("again"), F.col("length")).otherwise(0)).alias("twice"))
    shift, at = {}, 0
    for r in sums.orderBy("part").collect():  # one number per range
        shift[r["part"]] = at - r["twice"]
        at += r["all"] - r["twice"]
    shifts = rows.sparkSession.createDataFrame(list(shift.items()), "part int, shift long")
    placed = marked.join(shifts, "part").withColumns({"start": F.col("place") + F.col("shift"), "stop": F.col("stop") + F.col("shift")})
    # A node of several ranges starts in its first and is visible to the end of its last one.
    spans = placed.filter("home is not null").groupBy("node").agg(F.min_by("start", "part").alias("s"), F.max("stop").alias("e"))
    nodes = placed.join(spans, "node", "left").select(
        "part", "place", "again", "ends", "node", "parent", "depth", "ids", "length", F.coalesce("s", "start").alias("start"), "first_position",
        F.coalesce("e", "stop").alias("visible_until"), "loss_from", "loss_length", F.coalesce("n_all", "n_conversations").alias("n_conversations"),
    )
    return Tree(nodes, whole.select("conv_id", "leaf"))


def _by_leaf(tree: Tree, columns: list[str], read, schema: str) -> DataFrame:
    """``read`` applied to the nodes of every different conversation, with the name of its last node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in schema.split(", ")]
        held: list[dict] = []
        part = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, held = row["part"], []
                del held[row["depth"] :]
                held.append(row)
                if row["ends"]:
                    rows.append((row["node"], *read(held)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), _arrow(schema))], names=names)

    ordered = tree.nodes.select("part", "place", "depth", "node", "ends", *columns).repartition("part").sortWithinPartitions("part", "place")
    return ordered.mapInArrow(run, schema)


def _arrow(schema: str) -> list[pa.DataType]:
    known = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    return [known[x.split(" ")[1]] for x in schema.split(", ")]


def intervals(tree: Tree) -> DataFrame:
    """(conv_id, start, stop): the stream intervals [start, stop) of a conversation's nodes, in order."""

    def read(nodes: list[dict]) -> tuple:
        return [n["start"] for n in nodes], [n["start"] + n["length"] for n in nodes]

    found = _by_leaf(tree, ["start", "length"], read, "leaf binary, start array<long>, stop array<long>")
    return tree.members.join(found, "leaf").drop("leaf")


def _read(path: str):
    def read(nodes: list[dict]) -> tuple:
        decode = Encoder.open(path).decode
        whole = b"".join(decode(n["ids"]) for n in nodes).decode()
        under = "".join(unescape(decode(n["ids"][n["loss_from"] : n["loss_from"] + n["loss_length"]]).decode()) for n in nodes)
        turns, end = [], 0
        for m in TURN.finditer(whole):
            if m.start() != end:
                break
            turns.append((unescape_role(m[1]), unescape(m[2])))
            end = m.end()
        if end != len(whole):
            raise ValueError("a conversation is not a sequence of turns")
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(turns), digest(text), len(under), digest(under), len(whole), sum(len(n["ids"]) for n in nodes)

    return read


READ = "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def read_back(tree: Tree, path: str) -> DataFrame:
    """Digests of every conversation, decoded from the token ids of its nodes; copies are decoded once."""
    found = _by_leaf(tree, ["ids", "loss_from", "loss_length"], _read(path), READ)
    return tree.members.join(found, "leaf").drop("leaf")


def digests(rows: DataFrame, path: str) -> DataFrame:
    tree = build(rows, path)
    return read_back(Tree(stored(tree.nodes), tree.members), path)
