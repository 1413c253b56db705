"""Repair of conversation structure by survivor-coalescence Viterbi.

A conversation's rows are taken by turn (nulls first); rows of one turn by role, then the first
TEXT_HEAD characters of the text, then a hash of it. Only ``conv_id``, ``turn``, ``role`` and
``text`` of the input are read; null roles and texts are one space, a null ``conv_id`` is a
conversation of its own. The first fault of a row counts: blank, duplicate (its role and text
stand in an earlier row), truncated (its last character other than white space is none of .!?).

Edits: K keeps a row (0), R changes its role to user or assistant (3), D deletes it (4; blank and
duplicate rows must go), I inserts an empty user or assistant row (3); a truncated row that stays
costs 3 more. The initials of the roles that are left must form ``(s?(ua)+)?``; a role that is
empty or begins otherwise can only be changed or deleted. The cheapest edits win, of equally
cheap ones those whose initials come first in ASCII.

The four states of that pattern keep one survivor each: a leaf of a tree of back pointers whose
nodes count their references. Once all survivors share an ancestor, its edits are final and
leave the tree, so memory follows the unresolved stretch only. Survivors of equal cost are compared
over everything behind their last common ancestor. A state that another one can imitate more
cheaply, whatever follows, is given up, which lets the rest coalesce.

Rows are numbered by a range sort and cut into blocks of BLOCK_ROWS. Conversations inside a
block are solved there. Pieces at its borders, of a conversation of any length, are solved once
for each entry state, and only these tables meet by conversation, where the same search runs over
whole pieces. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.llm.common import release, schema_of
from sidforge.session import discard, materialize

BLOCK_ROWS = 8192
TEXT_HEAD = 64
OUT_ROWS = 4096

# States: nothing yet, after the system's, the user's, the assistant's row.
START, SYSTEM, USER, ASSISTANT = range(4)
TAILS = (START, ASSISTANT)  # where a conversation may end
INSERTS = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
# A row's kind: one letter for its fault and its role's initial.
FAULTS = ("", "truncated", "blank", "duplicate")
INITIALS = "?sua"


def kind_of(fault: int, initial: int) -> str:
    return chr(ord("a") + fault * len(INITIALS) + initial)


def fault_of(kind: str) -> int:
    return (ord(kind) - ord("a")) // len(INITIALS)


def initial_of(kind: str) -> int:
    return (ord(kind) - ord("a")) % len(INITIALS)


def _moves(fault: int, initial: int) -> list[tuple[int, int, str, int]]:
    moves = [(s, s, "D", DELETE) for s in range(4)]
    if fault < 2:
        cut = CUT * fault
        before = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
        moves += [(s, initial, "K", KEEP + cut) for s in before.get(initial, ())]
        moves += [(s, to, "R", REROLE + cut) for to in (USER, ASSISTANT) if to != initial for s in before[to]]
    return moves


MOVES = {kind_of(f, i): _moves(f, i) for f in range(len(FAULTS)) for i in range(len(INITIALS))}


# --- the search ----------------------------------------------------------------------


class _Node:
    """Edits behind a parent; ``refs`` counts children and a survivor that ends here."""

    __slots__ = ("parent", "letters", "depth", "refs", "kids", "tag")

    def __init__(self, parent: _Node | None, letters: str, tag=None):
        self.parent, self.letters, self.tag = parent, letters, tag
        self.depth = len(letters) + (parent.depth if parent else 0)
        self.refs, self.kids = 1, []
        if parent:
            parent.refs += 1
            parent.kids.append(self)


def _release(node: _Node | None) -> None:
    while node:
        node.refs -= 1
        if node.refs:
            return
        parent = node.parent
        if parent:
            parent.kids.remove(node)
        node = parent


def _precedes(a: _Node, letters: str, b: _Node) -> bool:
    """Whether the edits up to ``a``, then ``letters``, come before those up to ``b``."""
    left, right = [letters], []
    while a is not b:
        if a.depth >= b.depth and a.parent:
            left.append(a.letters)
            a = a.parent
        else:
            right.append(b.letters)
            b = b.parent
    return "".join(reversed(left)) < "".join(reversed(right))


class Survivors:
    """The cheapest path into each state, and what they all agree on."""

    def __init__(self, entry: int, inserts_first: bool):
        self.root = _Node(None, "")
        self.at: dict[int, tuple[int, _Node]] = {entry: (0, self.root)}
        self.final: list[_Node] = []  # edits that no longer change
        if inserts_first:
            self._insert(self.at)

    def _offer(self, at: dict, state: int, cost: int, parent: _Node, letters: str, tag=None) -> None:
        held = at.get(state)
        if held and (cost > held[0] or cost == held[0] and not _precedes(parent, letters, held[1])):
            return
        at[state] = cost, _Node(parent, letters, tag)
        if held:
            _release(held[1])

    def _insert(self, at: dict) -> None:
        for source, to in INSERTS:
            if source in at:
                cost, node = at[source]
                self._offer(at, to, cost + INSERT, node, "I")

    def step(self, moves: Iterable[tuple[int, int, str, int]], tags: dict | None = None, inserts: bool = True) -> None:
        at: dict[int, tuple[int, _Node]] = {}
        for source, to, letters, cost in moves:
            if source in self.at:
                before, node = self.at[source]
                self._offer(at, to, before + cost, node, letters, tags and tags[source])
        if inserts:
            self._insert(at)
        for _, node in self.at.values():
            _release(node)
        self.at = at
        self._give_up()
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.final.append(self.root)

    def _give_up(self) -> None:
        costs = {s: c for s, (c, _) in self.at.items()}
        never = 1 << 62
        start, last = costs.get(START, never), costs.get(ASSISTANT, never)
        # What the system's row allows, both others allow at the same cost; so does the
        # start for the assistant's row. The other way a system row must be deleted.
        beaten = {
            SYSTEM: costs.get(SYSTEM, -1) > min(start, last),
            ASSISTANT: last != never and last > start,
            START: start != never and start > last + DELETE,
        }
        for state, worse in beaten.items():
            if worse:
                _release(self.at.pop(state)[1])

    def drain(self) -> list[_Node]:
        final, self.final = self.final, []
        return final

    def path(self, node: _Node) -> list[_Node]:
        """Nodes from behind the final ones to ``node``."""
        out = []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]

    def best(self) -> tuple[int, _Node]:
        ends = [self.at[s] for s in TAILS if s in self.at]
        least = min(c for c, _ in ends)
        ends = [e for e in ends if e[0] == least]
        if len(ends) == 2 and _precedes(ends[1][1], "", ends[0][1]):
            ends.reverse()
        return ends[0]


def _solve(kinds: str) -> str:
    """Edits of a whole conversation."""
    search = Survivors(START, True)
    for kind in kinds:
        search.step(MOVES[kind])
    _, node = search.best()
    return "".join(n.letters for n in [*search.final, *search.path(node)])


SHORT = 24


@lru_cache(1 << 14)  # some 2 MB
def _solve_short(kinds: str) -> str:
    return _solve(kinds)


def solve(kinds: str) -> str:
    return _solve_short(kinds) if len(kinds) <= SHORT else _solve(kinds)


def transfers(kinds: str) -> list[tuple[int, int, int, str]]:
    """``(entry, exit, cost, edits)`` of a piece of a conversation."""
    out = []
    for entry in range(4):
        search = Survivors(entry, False)
        for kind in kinds:
            search.step(MOVES[kind])
        final = "".join(n.letters for n in search.final)
        out += [(entry, s, c, final + "".join(n.letters for n in search.path(m))) for s, (c, m) in search.at.items()]
    return out


def join_pieces(pieces: Iterable[tuple[int, str, list[tuple[int, int, int, str]]]]) -> Iterator[tuple[int, str, int, str]]:
    """``(start, kinds, entry, edits)`` of every piece, from ``(start, kinds, transfers)`` in order."""
    search, held, ahead = Survivors(START, True), {}, ""

    def told(nodes):
        nonlocal ahead
        for node in nodes:
            if node.tag is None:  # inserted before the first row
                ahead += node.letters
                continue
            start, entry = node.tag
            if ahead:
                entry = START
            yield start, held.pop(start), entry, ahead + node.letters
            ahead = ""

    for start, kinds, table in pieces:
        held[start] = kinds
        moves = [(entry, to, letters, cost) for entry, to, cost, letters in table]
        search.step(moves, {s: (start, s) for s in range(4)}, inserts=False)
        yield from told(search.drain())
    yield from told(search.path(search.best()[1]))


def follow(kinds: str, entry: int, edits: str) -> Iterator[tuple[str, int, str, int]]:
    """``(edit, row, kind, state)``: inserts count with the row before, or the first one."""
    state, row = entry, -1
    for edit in edits:
        if edit != "I":
            row += 1
        kind = kinds[max(row, 0)]
        if edit == "K":
            state = initial_of(kind)
        elif edit != "D":
            state = ASSISTANT if state == USER else USER
        yield edit, max(row, 0), kind, state


# --- Spark -----------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with rows dropped, emptied, cut, repeated and rerolled."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    kind = F.col("_kind")
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_kind"))
    new_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.expr("sequence(1, if(_kind = 3, 2, 1))")).alias("_copy")
    hurt = hurt.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), copies
    )
    return hurt.drop("_copy")


def _text_rows(rows: DataFrame) -> DataFrame:
    """Rows in order with their place ``_pos``, written out."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    # The last key tells equal rows apart, so that many of them spread over partitions.
    salted = rows.select("conv_id", "turn", *texts).withColumn("_salt", F.monotonically_increasing_id())
    salted = materialize(salted, "turns")
    keys = ["conv_id", "turn", F.substring("role", 1, TEXT_HEAD), F.substring("text", 1, TEXT_HEAD), F.xxhash64("role", "text"), "_salt"]
    order = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    placed = materialize(order.withColumn("_mid", F.monotonically_increasing_id()), "turns-placed", replaces=salted)
    part, local = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).collect()  # a row per partition
    starts, before = [], 0
    for size in sorted(sizes):
        starts.append((size._part, before))
        before += size._rows
    offsets = placed.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    found = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    out = found.select("conv_id", "turn", "role", "text", (F.col("_start") + local).alias("_pos"))
    out._scratch_path = placed._scratch_path
    return out


def _white(text: str) -> str:
    return f"trim(trailing ' \\t\\n\\u000b\\f\\r' from {text})"


def _kinds(placed: DataFrame) -> DataFrame:
    """``conv_id, _pos, _kind``: everything the search needs of a row."""
    initial = F.expr("instr('sua', left(role, 1))")  # an empty role is found at 1
    initial = F.when(F.col("role") == "", 0).otherwise(initial)
    blank = F.expr(f"{_white('text')} = ''")
    cut = ~F.expr(f"right({_white('text')}, 1) in ('.', '!', '?')")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    small = placed.select("conv_id", "_pos", initial.alias("_initial"), blank.alias("_blank"), cut.alias("_cut"), same.alias("_same"))
    small = materialize(small, "turn-kinds")
    # One row per place, so no key is hot.
    first = small.groupBy("conv_id", "_same").agg(F.min("_pos").alias("_pos")).select("_pos", F.lit(True).alias("_first"))
    fault = F.when(F.col("_blank"), 2).when(F.col("_first").isNull(), 3).when(F.col("_cut"), 1).otherwise(0)
    kind = F.expr("char(97 + _fault * 4 + _initial)")
    marked = small.join(first, "_pos", "left").withColumn("_fault", fault).select("conv_id", "_pos", kind.alias("_kind"))
    marked._scratch_path = small._scratch_path
    return marked


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _pieces(kinds: DataFrame, block_rows: int) -> DataFrame:
    """``conv_id, start, kinds, edits, table``: solved conversations, and tables of open pieces."""
    blocks = kinds.withColumn("_block", F.expr(f"_pos div {block_rows}")).select("_block", "_pos", "conv_id", "_kind")
    blocks = blocks.repartition("_block").sortWithinPartitions("_block", "_pos")

    def runs(rows):
        for (block, conv), group in groupby(rows, key=lambda r: (r[0], r[2])):
            group = list(group)  # of one block
            yield block, conv, group[0][1], "".join(r[3] for r in group)

    def solved(rows):
        before, held = None, None
        for run in runs(rows):
            if held:
                yield answer(held, held[0] != before or run[0] != held[0])
                before = held[0]
            held = run
        if held:
            yield answer(held, True)

    def answer(run, open_end):
        _, conv, start, own = run
        if open_end:
            table = [dict(zip(("entry", "exit", "cost", "edits"), t)) for t in transfers(own)]
            return conv, start, own, None, table
        return conv, start, own, solve(own), None

    key = schema_of(kinds.select("conv_id"))
    table = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))

    def run(batches):
        schema = None
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("conv_id", first.schema.field("conv_id").type), ("start", pa.int64()), ("kinds", pa.string()), ("edits", pa.string()), ("table", table)]
        )
        yield from _batches(solved(_read(_chain(first, batches))), schema)

    out = "start bigint, kinds string, edits string, table array<struct<entry:int,exit:int,cost:bigint,edits:string>>"
    return materialize(blocks.mapInArrow(run, f"{key}, {out}"), "pieces")


def _chain(first, rest):
    yield first
    yield from rest


def _joined(pieces: DataFrame) -> DataFrame:
    """``conv_id, start, kinds, entry, edits`` of every piece."""
    whole = pieces.where("edits is not null").select("conv_id", "start", "kinds", F.lit(START).alias("entry"), "edits")
    parts = pieces.where("edits is null").select("conv_id", "start", "kinds", "table")
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "start")

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("conv_id", first.schema.field("conv_id").type), ("start", pa.int64()), ("kinds", pa.string()), ("entry", pa.int32()), ("edits", pa.string())]
        )

        def rows():
            for conv, group in groupby(_read(_chain(first, batches)), key=lambda r: r[0]):
                tables = ((r[1], r[2], [tuple(t.values()) for t in r[3]]) for r in group)
                for found in join_pieces(tables):
                    yield conv, *found

        yield from _batches(rows(), schema)

    key = schema_of(pieces.select("conv_id"))
    return whole.unionByName(parts.mapInArrow(run, f"{key}, start bigint, kinds string, entry int, edits string"))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The edits of every conversation, in the order of ``start, step``.

    A row each: ``conv_id, start, step, edit, fault, turn, role, text, initial, new_role``. The
    row to which an edit belongs is in ``turn, role, text`` (null for inserts); the repaired
    conversation has ``new_role`` and ``text`` (inserts: empty) of all rows but the deleted.
    """
    placed = _text_rows(rows)
    kinds = _kinds(placed)
    pieces = _pieces(kinds, block_rows)
    discard(kinds)
    joined = _joined(pieces)

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("conv_id", first.schema.field("conv_id").type), ("start", pa.int64()), ("step", pa.int64()), ("_pos", pa.int64()),
             ("edit", pa.string()), ("fault", pa.string()), ("initial", pa.string()), ("_state", pa.int32())]
        )

        def edits():
            for conv, start, own, entry, letters in _read(_chain(first, batches)):
                for step, (edit, row, kind, state) in enumerate(follow(own, entry, letters)):
                    yield conv, start, step, start + row, edit, FAULTS[fault_of(kind)], INITIALS[initial_of(kind)], state

        yield from _batches(edits(), schema)

    key = schema_of(rows.select("conv_id"))
    out = f"{key}, start bigint, step bigint, _pos bigint, edit string, fault string, initial string, _state int"
    edits = materialize(joined.mapInArrow(run, out), "edits", replaces=pieces)
    release(rows.sparkSession)
    inserted = F.col("edit") == "I"
    own = lambda c: F.when(~inserted, F.col(c)).alias(c)
    role = F.when(F.col("edit").isin("R", "I"), F.when(F.col("_state") == USER, "user").otherwise("assistant"))
    new_role = role.when(F.col("edit") == "K", F.col("role"))
    met = edits.join(placed.drop("conv_id"), "_pos")
    return met.select(
        "conv_id", "start", "step", "edit", own("fault"), own("turn"), own("role"), own("text"), own("initial"), new_role.alias("new_role")
    )


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def report(script: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per ``conv_id`` of ``conversations``: faults, cost, edits and repaired digest.

    A digest reads its conversation from end to end, so this goes through one task per
    conversation, row by row; only the counts and the edits are held.
    """
    columns = ["conv_id", "start", "step", "edit", "fault", "turn", "initial", "new_role", "text"]
    named = conversations.select("conv_id").distinct()
    marks = named.selectExpr("conv_id", "-1L as start", "0L as step", *(f"cast(null as string) as {c}" for c in ("edit", "fault")),
                             "cast(null as bigint) as turn", *(f"cast(null as string) as {c}" for c in ("initial", "new_role", "text")))
    rows = script.withColumn("turn", F.col("turn").cast("bigint")).select(*columns).unionByName(marks)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "start", "step")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def digest(conv, group):
        found = dict.fromkeys(counts, 0)
        sha, audit, empty = hashlib.sha256(), [], True
        before = low = high = None
        distinct = 0
        for _, _, _, edit, fault, turn, initial, new_role, text in group:
            if edit is None:
                continue
            audit.append(edit)
            if edit != "I":
                if fault:
                    found[fault] += 1
                if before is not None and not _legal(before, initial):
                    found["illegal"] += 1
                before = initial
                if turn is not None:
                    distinct += turn != high
                    low, high = turn if low is None else low, turn
            found["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            if edit == "D":
                continue
            found["cost"] += CUT * (fault == "truncated")
            sha.update(b"" if empty else b"\n")
            sha.update(new_role.encode())
            sha.update(b":")
            sha.update((text or "").encode())
            empty = False
        if low is not None:
            found["gaps"] = high - low + 1 - distinct
        return conv, *(found[c] for c in counts), "".join(audit), sha.hexdigest()

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("conv_id", first.schema.field("conv_id").type), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())]
        )
        groups = groupby(_read(_chain(first, batches)), key=lambda r: r[0])
        yield from _batches((digest(conv, group) for conv, group in groups), schema)

    key = schema_of(conversations.select("conv_id"))
    longs = ", ".join(f"{c} bigint" for c in counts)
    return rows.mapInArrow(run, f"{key}, {longs}, audit string, repaired_sha256 string")

