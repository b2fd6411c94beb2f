"""Structure repair of conversations: the cheapest edits, found by an auction shortest-path algorithm.

A conversation is well formed if its roles spell ``(s?(ua)+)?`` (system, user, assistant by
their first letters). The edits of a row are Keep (0), Rerole to user or assistant (3) and
Delete (4, the only one for blank and duplicate rows); an empty user or assistant turn may be
Inserted (3) anywhere; a truncated row that stays adds 3.

These edits are arcs of a lattice whose nodes are (rows done, grammar state). Every node has
a price, never above its distance to the end. The algorithm holds a path: its last node is
either raised to the cheapest ``arc + price`` beyond it and leaves the path (contraction), or
the path is extended by that arc if its price reaches it already. Origins are taken from the
end of the conversation to its start and prices are kept, so a path stops at the first layer
whose prices have converged: a layer costs a bounded number of steps however long the
conversation is. With all prices exact, every tight arc (price = arc + price beyond) lies on
a cheapest path, and following the ASCII-least tight arc gives the least of the cheapest edit
sequences. In every grammar state only one of user and assistant may follow, so the letters
of the edits fix the repaired roles.

Spark deals rows by conversation once. The sorted rows are streamed backwards for the prices
(each row gets its tight arcs for the four states) and forwards for the edits; a task holds
one batch and four prices, never a conversation. Digests are streamed too, as a hash of one
conversation has to be.

Edge cases: null roles and texts are one blank each; a null conv_id is one conversation, a
null turn comes first; rows of one turn are ordered by role and text; a role that begins
with none of s, u, a cannot be kept; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grammar states: nothing yet, after system, after user, after assistant; the first and the last may end.
STATES, ENDS = range(4), (0, 3)
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPEAKER = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
END = ("end", "")

#: (edit letter, cost, leaves the layer, next state)
Arc = tuple[str, int, bool, int]


@lru_cache(maxsize=None)
def arcs(kind: tuple[str, str]) -> tuple[tuple[Arc, ...], ...]:
    """The arcs out of each state of the layer before a row of this (role initial, fault), or after the last row."""
    initial, fault = kind
    out = []
    for q in STATES:
        spoken = FOLLOWS[q, SPEAKER[q]]
        own: list[Arc] = [("I", INSERT, False, spoken)]
        if kind == END:
            own += [("", 0, True, 0)] if q in ENDS else []
        else:
            own.append(("D", DELETE, True, q))
            if fault not in ("blank", "duplicate"):
                more = CUT if fault == "truncated" else 0
                own.append(("R", REROLE + more, True, spoken))
                own += [("K", more, True, FOLLOWS[q, initial])] if (q, initial) in FOLLOWS else []
        out.append(tuple(own))
    return tuple(out)


def auction(layer: tuple[tuple[Arc, ...], ...], beyond: tuple[int, ...]) -> list[int]:
    """Prices of a layer's states, given the converged prices of the next layer."""
    prices = [min(beyond)] * len(layer)
    for origin in range(len(layer)):
        path = [origin]
        while True:
            q = path[-1]
            offer, leaves, nxt = min((cost + (beyond[s] if out else prices[s]), not out, s) for _, cost, out, s in layer[q])
            if prices[q] < offer:
                prices[q] = offer
                if len(path) > 1:
                    path.pop()
            elif not leaves:
                break
            else:
                path.append(nxt)
    return prices


@lru_cache(maxsize=None)
def settle(kind: tuple[str, str], beyond: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Prices before a row, relative to the least, and for each state the ASCII-least tight edits with the state that they lead to."""
    layer = arcs(kind)
    prices = auction(layer, beyond)
    plans = []
    for q in STATES:
        edits, at, gone = "", q, False
        while not gone:
            edit, _, gone, to = min(a for a in layer[at] if prices[at] == a[1] + (beyond[a[3]] if a[2] else prices[a[3]]))
            edits, at = edits + edit, to
        plans.append(f"{edits}{at}")
    least = min(prices)
    return tuple(p - least for p in prices), "|".join(plans)


AFTER, LAST = settle(END, (0,) * 4)

ROWS = "conv_id long, turn long, role string, text string, seen int, initial string, fault string, illegal boolean"
#: The order of rows; equal rows of one turn come as often as they were seen.
UP = ["conv_id", "turn", "role", "text", "seen"]


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, how often role and text were seen so far, role initial, first fault ('' if none) and whether
    the role may not follow the row before. All windows share the conversation's one shuffle.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(solid == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    before = F.lag("initial").over(Window.partitionBy("conv_id").orderBy(*UP[1:]))
    illegal = F.coalesce(~F.concat(before, "initial").isin("su", "ua", "au"), F.lit(False))
    return dealt.withColumn("seen", seen).withColumn("fault", fault).withColumn("initial", initial).withColumn("illegal", illegal)


def _prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's tight edits; rows come from the end of each conversation to its start."""
    conv, beyond = object(), AFTER
    for batch in batches:
        plans = []
        for own, *kind in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "initial", "fault"))):
            if own != conv:
                conv, beyond = own, AFTER
            beyond, plan = settle(tuple(kind), beyond)
            plans.append(plan)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plans, pa.string())], names=[*batch.schema.names, "plan"])


EDITS = "conv_id long, step long, edit string, cost int, turn long, role string, text string, initial string, fault string, illegal boolean"
ARROW = pa.schema(
    [("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("cost", pa.int32()), ("turn", pa.int64()), ("role", pa.string()),
     ("text", pa.string()), ("initial", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_())]
)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each conversation in order; rows come from its start to its end."""
    names = ("conv_id", "turn", "role", "text", "initial", "fault", "illegal", "plan")
    conv, state, step = None, None, 0
    rows: list[tuple] = []

    def apply(edits: str, row: tuple | None) -> None:
        nonlocal state, step
        for edit in edits[:-1]:
            speaker = SPEAKER[state]
            if edit == "I":
                rows.append((conv, step, edit, INSERT, None, ROLE[speaker], "", None, None, None))
                state = FOLLOWS[state, speaker]
            else:
                turn, role, text, initial, fault, illegal = row
                if edit == "R":
                    role = ROLE[speaker]
                cost = DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (CUT if fault == "truncated" else 0)
                rows.append((conv, step, edit, cost, turn, role, text, initial, fault, illegal))
            step += 1
        state = int(edits[-1])

    def finish() -> None:
        if state is not None:
            apply(LAST.split("|")[state], None)

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(ARROW), ARROW)], schema=ARROW)
        rows.clear()
        return batch

    for batch in batches:
        for own, *row, plan in zip(*(batch.column(n).to_pylist() for n in names)):
            if state is None or own != conv:
                finish()
                conv, state, step = own, 0, 0
            apply(plan.split("|")[state], tuple(row))
        yield emit()
    finish()
    yield emit()


def edits(rows: DataFrame) -> DataFrame:
    """One row per edit, in order within each task: conv_id, step, edit (K, R, D or I), its cost, and the row with its repaired role.

    The repaired conversation is what is not deleted, by ``step``. ``initial``, ``fault``
    and ``illegal`` describe the row as it came and are null for inserted turns.
    """
    down = ["conv_id", F.col("turn").desc_nulls_last(), *(F.col(c).desc() for c in UP[2:])]
    columns = [c.split(" ")[0] for c in ROWS.split(", ")]
    priced = faults(rows).select(*columns).sortWithinPartitions(*down).mapInArrow(_prices, f"{ROWS}, plan string")
    return priced.sortWithinPartitions(*UP).mapInArrow(_trace, EDITS)


DIGEST = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class _Conversation:
    """What is counted and hashed while one conversation's edits pass."""

    def __init__(self, conv: int | None):
        self.conv, self.first, self.last, self.turns, self.cost, self.illegal = conv, None, None, 0, 0, 0
        self.count = dict.fromkeys(("", "blank", "duplicate", "truncated"), 0)
        self.audit, self.hash, self.any = bytearray(), hashlib.sha256(), False

    def add(self, edit: str, cost: int, turn: int | None, role: str, text: str, fault: str | None, illegal: bool | None) -> None:
        self.audit += edit.encode()
        self.cost += cost
        if edit != "I":
            self.count[fault] += 1
            self.illegal += illegal
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
        if edit != "D":
            self.hash.update(f"{chr(10) * self.any}{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        n = self.count
        return self.conv, gaps, n["blank"], n["duplicate"], n["truncated"], self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in DIGEST.split(", ")]
    types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
    now, done = None, []

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [[]] * len(names), types)], names=names)
        done.clear()
        return batch

    for batch in batches:
        for conv, *edit in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "edit", "cost", "turn", "role", "text", "fault", "illegal"))):
            if now is None or conv != now.conv:
                done.extend([now.row()] if now else [])
                now = _Conversation(conv)
            now.add(*edit)
        yield emit()
    done.extend([now.row()] if now else [])
    yield emit()


def digests(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """Counts, cost, audit and hash of every conv_id of ``conversations``, from the rows of ``edits`` as they are emitted."""
    own = found.mapInArrow(_digest, DIGEST).withColumnRenamed("conv_id", "own")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(own, ids["conv_id"].eqNullSafe(own["own"]), "left").drop("own")
    nothing = hashlib.sha256().hexdigest()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """The rows with faults planted by the checksum of ``conv_id:turn``: dropped, emptied, without sentence ends, repeated, or made a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))

    def either(when: int, then: Column, other: Column) -> Column:
        return F.when(F.col("hit") == when, then).otherwise(other)

    text = either(1, F.lit(""), either(2, F.regexp_replace("text", "[.!?]", ""), F.col("text")))
    whole = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    made = whole.select("conv_id", "turn", either(4, F.lit("user"), F.col("role")).alias("role"), text.alias("text"), "hit")
    return made.withColumn("copy", F.explode(either(3, F.array(F.lit(0), F.lit(1)), F.array(F.lit(0))))).drop("copy", "hit")
