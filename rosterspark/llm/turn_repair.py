"""Conversation structure repair: the cheapest edits that give well-formed turns.

Roles by their initials must read ``(s?(ua)+)?``: an automaton of four states. A turn is a
4x4 matrix of (cost, audit) from state to state, where an audit is the initials of the
edits: Keep, Rerole (to user or assistant), Delete, and Insert, whose closure stands on
both sides of a turn. Matrices multiply with (+, concatenation) and (minimum by cost, then
by the audit's ASCII), which is associative: of two audits of one stretch with equal costs
neither is a prefix of the other, so that their order survives what is appended.

Turns are dealt out by ranges of (conversation, turn), so that a very long conversation
lies in many partitions. Each task multiplies the turns it holds pairwise, as a tree. A
conversation that no other task can hold is repaired there; of the first and the last one
of a task the product is written with the turns, and products are multiplied along a tree
of ``FAN`` at a time. The audit is then cut by tasks, and the turns of such a conversation
pass through one task as a stream that holds one turn at a time.

Cases: a null role or text is one space; a null conversation is a conversation like others;
null turns come before all others and count in no gap; turns with one number go by role
and text; a row that repeats another in all columns is a duplicate, counted before
the shuffle; other columns are not read; an empty table gives no reports.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import materialise, shuffle_partitions

#: What deleting a turn, giving it another role, inserting one and keeping a truncated one cost.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Products of a conversation that are multiplied in one task.
FAN = 64
#: The states: nothing yet, after a system, a user and an assistant turn. What may follow a state, and where it leads.
USER_FROM, ASSISTANT_FROM = ((0, 2), (1, 2), (3, 2)), ((2, 3),)
STEPS = {"s": ((0, 1),), "u": USER_FROM, "a": ASSISTANT_FROM}
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PLACES = "kind string, conv_id {id}, chunk int, place long, role string, text string, copies long, fault string, edit string"
OUT = PLACES + ", gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, part string"

Element = tuple  # (cost, audit, lengths of the audit in each part)
Matrix = tuple[tuple[Element | None, ...], ...]


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): some turns dropped (no copies), emptied, freed of
    their full stops, repeated or given to the user, by a checksum of conversation and turn."""
    own = F.concat(*[F.coalesce(c, F.lit(" ")) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    kind = F.crc32(own.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in (F.col("role"), F.col("text")))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copies"))


def least(a: Element | None, b: Element | None) -> Element | None:
    return b if a is None else a if b is None else a if a[:2] <= b[:2] else b


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product of two stretches that follow each other."""
    out = []
    for row in a:
        cells: list[Element | None] = [None] * 4
        for x, after in zip(row, b, strict=True):
            if x is not None:
                for j, y in enumerate(after):
                    if y is not None and (cells[j] is None or x[0] + y[0] <= cells[j][0]):
                        cells[j] = least(cells[j], (x[0] + y[0], x[1] + y[1], x[2] + y[2]))
        out.append(tuple(cells))
    return tuple(out)


def product(parts: list[Matrix]) -> Matrix:
    """The product of all parts in order, by pairs."""
    while len(parts) > 1:
        parts = [times(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def matrix(moves: list[tuple[int, int, int, str]]) -> Matrix:
    cells: list[list[Element | None]] = [[None] * 4 for _ in range(4)]
    for i, j, cost, edit in moves:
        cells[i][j] = least(cells[i][j], (cost, edit, ()))
    return tuple(map(tuple, cells))


@lru_cache(maxsize=1)
def insertions() -> Matrix:
    """The closure of inserting turns: nothing, or the cheapest turns between two states."""
    one = matrix([(i, i, 0, "") for i in range(4)] + [(i, j, INSERT, "I") for i, j in USER_FROM + ASSISTANT_FROM])
    return times(times(one, one), one)


@lru_cache(maxsize=64)
def turn_matrix(initial: str, fault: str) -> Matrix:
    """The edits of a turn by its role's initial and its fault."""
    moves = [(i, i, DELETE, "D") for i in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        moves += [(i, j, more, "K") for i, j in STEPS.get(initial, ())]
        moves += [(i, j, REROLE + more, "R") for i, j in USER_FROM + ASSISTANT_FROM]
    return times(times(insertions(), matrix(moves)), insertions())


def cheapest(whole: Matrix) -> Element:
    """From nothing to nothing, or to after an assistant's turn."""
    return least(whole[0][0], whole[0][3])


def fault_of(text: str, seen: bool) -> str:
    said = text.rstrip(BLANKS)
    return "blank" if not said else "duplicate" if seen else "" if said[-1] in ENDS else "truncated"


class Editor:
    """Applies an audit to turns one by one; ``edits`` is what is left of it."""

    def __init__(self):
        self.state, self.edits, self.at = 0, "", 0

    def follow(self, edits: str) -> None:
        self.edits, self.at = edits, 0

    def _added(self, role: str) -> str:
        self.state = next(j for i, j in STEPS[role[0]] if i == self.state)
        return role

    def _wanted(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._added(self._wanted()), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            role = self._wanted() if edit == "R" else role
            self._added(role)
            yield edit, role, text


class Digest:
    """The checksum of repaired turns as they come."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True


class Stretch:
    """What a task knows of the turns of one conversation that it holds."""

    def __init__(self):
        self.matrices: list[Matrix] = []
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last_turn = None
        self.first = self.last = None  # initials of the first and the last role
        self.rows: list[tuple[str, str, int, str]] = []

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> str:
        """Counts a turn and its copies; gives the fault of the first."""
        if not copies:
            return ""
        fault = fault_of(text, seen)
        initial = role[:1]
        if self.first is None:
            self.first = initial
        for k in range(copies):
            own = fault if k == 0 or fault == "blank" else "duplicate"
            if own:
                self.sums[own] += 1
            if self.last is not None:
                self.sums["illegal"] += self.last + initial not in ("su", "ua", "au")
            self.last = initial
            self.matrices.append(turn_matrix(initial, own))
        if turn is not None and turn != self.last_turn:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.sums["turns"] += 1
            self.last_turn = turn
        return fault

    def whole(self) -> Matrix:
        return product(self.matrices) if self.matrices else insertions()

    def summary(self) -> dict:
        return self.sums | {"low": self.low, "high": self.high, "first": self.first, "last": self.last}


def joined(parts: list[dict]) -> dict:
    """One summary of stretches that follow each other; their turns may meet in one number."""
    out = dict(parts[0])
    for p in parts[1:]:
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            out[k] += p[k]
        if out["last"] is not None and p["first"] is not None:
            out["illegal"] += out["last"] + p["first"] not in ("su", "ua", "au")
        if p["low"] is not None:
            out["turns"] -= out["high"] == p["low"]
            out["low"], out["high"] = p["low"] if out["low"] is None else out["low"], p["high"]
        out["first"], out["last"] = p["first"] if out["first"] is None else out["first"], p["last"] if p["last"] is not None else out["last"]
    return out


def counts_of(s: dict, cost: int) -> dict:
    gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
    return {"gaps": gaps, "blank": s["blank"], "duplicate": s["duplicate"], "truncated": s["truncated"], "illegal": s["illegal"], "cost": cost}


class Writer:
    """Rows of a task's result, handed on in batches."""

    def __init__(self, schema: pa.Schema, most: int = 2000):
        self.schema, self.most, self.rows = schema, most, []

    def add(self, kind: str, conv_id, **fields) -> None:
        self.rows.append({"kind": kind, "conv_id": conv_id} | fields)

    def full(self) -> bool:
        return len(self.rows) >= self.most

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in self.rows], f.type) for f in self.schema], schema=self.schema)
        self.rows = []
        return out


def _arrow(kinds: str, id_type: pa.DataType) -> pa.Schema:
    names = [x.split() for x in kinds.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "{id}": id_type, "boolean": pa.bool_()}
    return pa.schema([(n, types[t]) for n, t in names])


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, seen) in order within each partition: equal rows
    as one with its copies, and whether an earlier turn says the same."""
    rows = turns.withColumn("turn", F.when(F.col("copies") > 0, F.col("turn")))
    rows = rows.withColumns({c: F.when(F.col("copies") > 0, F.col(c)).otherwise("") for c in ("role", "text")})
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("same", F.md5("text"))
    # What is said at several turns, and where first; from the input, without its texts.
    said = turns.where("copies > 0").groupBy("conv_id", "role", F.md5("text").alias("same"))
    said = said.agg(F.bool_or(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    said = said.where((F.col("low") < F.col("high")) | (F.col("no_turn") & F.col("low").isNotNull()))
    said = materialise(said.select("conv_id", "role", "same", F.when(~F.col("no_turn"), F.col("low")).alias("first_turn"), F.lit(True).alias("again")), "turns-said-again")
    met = rows.join(said, rows["conv_id"].eqNullSafe(said["conv_id"]) & (rows["role"] == said["role"]) & (rows["same"] == said["same"]), "left")
    seen = F.coalesce(F.col("again") & ~rows["turn"].eqNullSafe(F.col("first_turn")), F.lit(False))
    met = met.select(*[rows[c] for c in ("conv_id", "turn", "role", "text", "copies")], seen.alias("seen"))
    return met.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")


def repair(turns: DataFrame) -> DataFrame:
    """Rows of kind ``report``, one a conversation, and ``turn``, the repaired turns in the
    order of (chunk, place) with the edit that each comes from; written.

    ``turns`` has (conv_id, turn, role, text, copies); a row without copies only names its
    conversation.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    ddl = OUT.replace("{id}", kind)
    done = materialise(ordered(turns).mapInArrow(_repair_partition, ddl), "turns-repaired")
    parts = done.where("kind = 'part'").select("conv_id", "chunk", "part")
    for level in range(1, max(1, math.ceil(math.log(max(2, shuffle_partitions(turns.sparkSession)), FAN))) + 1):
        group = (F.col("chunk") / FAN**level).cast("int")
        parts = parts.groupBy("conv_id", group.alias("group")).applyInPandas(_multiply, f"conv_id {kind}, chunk int, part string")
    heads = parts.groupBy("conv_id").applyInPandas(_cut, ddl)
    rows = heads.unionByName(done.where("kind = 'raw'")).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place")
    long = materialise(rows.mapInArrow(_edit_stream, ddl), "long-turns-repaired")
    return done.where("kind IN ('report', 'turn')").unionByName(long).drop("copies", "fault", "part")


def reports(repaired: DataFrame) -> DataFrame:
    return repaired.where("kind = 'report'").select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, chunk, place, role, text, edit): what is left, in the order of (chunk, place)."""
    return repaired.where("kind = 'turn'").select("conv_id", "chunk", "place", "role", "text", "edit")


def _repair_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations that lie within a sorted partition; of the first and the
    last one, which may go on elsewhere, writes the product and the turns."""
    chunk, out, now, own, at_edge = TaskContext.get().partitionId(), None, None, None, True
    for b in batches:
        if out is None:
            out = Writer(_arrow(OUT, b.schema.field("conv_id").type))
        for conv_id, turn, role, text, copies, seen in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if own is None or conv_id != now:
                if own is not None:
                    _finish(out, now, chunk, own, at_edge)
                    at_edge = False
                now, own = conv_id, Stretch()
            fault = own.add(turn, role, text, copies, seen)
            if copies and at_edge:
                out.add("raw", now, chunk=chunk, place=len(own.matrices), role=role, text=text, copies=copies, fault=fault)
            elif copies:
                own.rows.append((role, text, copies, fault))
            if out.full():
                yield out.batch()
    if own is not None:
        for k, (role, text, copies, fault) in enumerate(own.rows):
            out.add("raw", now, chunk=chunk, place=k, role=role, text=text, copies=copies, fault=fault)
        _finish(out, now, chunk, own, True)
        yield out.batch()


def _finish(out: Writer, conv_id, chunk: int, own: Stretch, at_edge: bool) -> None:
    whole = own.whole()
    if at_edge:
        cells = [[None if x is None else [x[0], x[1], [len(x[1])]] for x in row] for row in whole]
        out.add("part", conv_id, chunk=chunk, part=json.dumps({"chunks": [chunk], "sums": own.summary(), "matrix": cells}))
        return
    cost, audit, _ = cheapest(whole)
    editor, digest, place = Editor(), Digest(), 0
    editor.follow(audit)
    for role, text, copies, _ in own.rows:
        for _ in range(copies):
            for edit, r, t in editor.turn(role, text):
                digest.add(r, t)
                out.add("turn", conv_id, chunk=chunk, place=place, role=r, text=t, edit=edit)
                place += 1
    for edit, r, t in editor.inserted():
        digest.add(r, t)
        out.add("turn", conv_id, chunk=chunk, place=place, role=r, text=t, edit=edit)
        place += 1
    out.add("report", conv_id, chunk=chunk, audit=audit, repaired_sha256=digest.sha.hexdigest(), **counts_of(own.summary(), cost))


def _matrix_of(part: dict) -> Matrix:
    return tuple(tuple(None if x is None else (x[0], x[1], tuple(x[2])) for x in row) for row in part["matrix"])


def _multiply(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """The product of a conversation's parts that follow each other."""
    found = [json.loads(p) for p in parts.sort_values("chunk")["part"]]
    one = {"chunks": sum((p["chunks"] for p in found), []), "sums": joined([p["sums"] for p in found]), "matrix": product([_matrix_of(p) for p in found])}
    return pd.DataFrame({"conv_id": pd.array([key[0]], parts["conv_id"].dtype) if key[0] is not None else [None], "chunk": [one["chunks"][0]], "part": [json.dumps(one)]})


def _cut(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """The audit of a conversation, cut by its parts: a row ahead of each part's turns."""
    found = json.loads(parts["part"].iloc[0])
    cost, audit, lengths = cheapest(_matrix_of(found))
    rows, at = [], 0
    for chunk, n in zip(found["chunks"], lengths, strict=True):
        rows.append({"kind": "head", "conv_id": key[0], "chunk": chunk, "place": -1, "edit": audit[at : at + n]} | counts_of(found["sums"], cost))
        at += n
    frame = pd.DataFrame(rows)
    return frame.reindex(columns=[c.split()[0] for c in OUT.split(", ")]).astype(object).where(lambda f: f.notna(), None)


def _edit_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits conversations turn by turn, behind the heads that hold their audits."""
    out, now, open_ = None, None, None

    def put(found) -> None:
        for edit, role, text in found:
            open_["digest"].add(role, text)
            out.add("turn", now, chunk=open_["chunk"], place=open_["place"], role=role, text=text, edit=edit)
            open_["place"] += 1

    def close() -> None:
        put(open_["editor"].inserted())
        out.add("report", now, chunk=open_["chunk"], audit="".join(open_["audit"]), repaired_sha256=open_["digest"].sha.hexdigest(), **{c: open_[c] for c in COUNTS})

    for b in batches:
        if out is None:
            out = Writer(_arrow(OUT, b.schema.field("conv_id").type))
        for r in b.to_pylist():
            if open_ is None or r["conv_id"] != now:
                if open_ is not None:
                    close()
                now, open_ = r["conv_id"], {"editor": Editor(), "digest": Digest(), "place": 0, "audit": []}
            if r["kind"] == "head":
                put(open_["editor"].inserted())
                open_ |= {c: r[c] for c in COUNTS} | {"chunk": r["chunk"]}
                open_["audit"].append(r["edit"])
                open_["editor"].follow(r["edit"])
                continue
            for _ in range(r["copies"]):
                put(open_["editor"].turn(r["role"], r["text"]))
            if out.full():
                yield out.batch()
    if open_ is not None:
        close()
        yield out.batch()
