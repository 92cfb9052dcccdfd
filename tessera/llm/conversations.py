"""Repair of the structure of conversations: faults, and the cheapest edits that make the roles alternate.

Rows are kept, given another role, deleted, or new ones inserted, so that the initials of the roles read ``(s?(ua)+)?``. The least cost
from each turn and each state of that grammar to the end is found backwards; a walk forwards then takes, among the edits
that keep to the least cost, the one whose letter comes first (Delete, Insert, Keep, Rerole), which gives the
ASCII-least of the cheapest edit strings. The rows that it leaves are put together anew and hashed.

A conversation may hold any share of all rows. Equal rows are counted before anything else (all but the first are
deletions), all rows are numbered by range, and a conversation is cut wherever the number passes a multiple of ``BLOCK``. The
blocks of one that spans several are joined in two light passes over one row a block: backwards by the least cost from each
state to each other, forwards by the state that a walk from each state ends in. A conversation within one block needs
neither. Only the hash, which is sequential, runs over the blocks of a conversation in one task, as a stream.

Defined results: null roles and texts are one space each; a null turn comes first and is no turn of its own in ``gaps``; rows
of one turn are in the order of role and text; a null id is a conversation of its own; an empty role has no initial and
never fits; a conversation without rows has zeros, an empty audit and the hash of the empty string; repeated rows
are duplicates; other columns are dropped, so names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import materialise, table
from tessera.operators.chunk import numbered

#: Rows of a conversation that are worked on together, and bytes of repaired text that are handed on at once.
BLOCK, PIECE_BYTES = 512, 4 << 20
#: States of the grammar: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row that is inserted or given a role leads, and where one kept leads by its initial.
_FILL = (USER, USER, ASSISTANT, USER)
_KEEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
_NO_STATE = (None,) * 4
_NAMES = {USER: "user", ASSISTANT: "assistant"}
RECAST, DROP, ADD, CUT_OFF = 2, 3, 2, 1
#: Least costs at the end of a conversation, where rows may still be inserted; and a cost that no edits have.
FINAL, NEVER = (0, 2 * ADD, ADD, 0), 1 << 60
_LEGAL = {"su", "ua", "au"}


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): each row by a checksum of its place: n is 0 if it is dropped, 2 if repeated; else blanked, its stops taken out, its role set, or left."""
    blank = F.lit(" ")
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    code = F.crc32(place.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return rows.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("n"),
    )


# -- one block of rows ---------------------------------------------------------------------------------
# A row is (initial, must go, cut off, n): its role's initial, whether all of its n equal copies must be deleted
# (else all but the first), and whether it ends without a full stop.


def _before(row: tuple[str, bool, bool, int], after: tuple[int, ...]) -> tuple[int, int, int, int]:
    """Least costs of each state before a row, given those after it."""
    initial, gone, cut, n = row
    copies = DROP * (n if gone else n - 1)
    if gone:
        b = [f + copies for f in after]
    else:
        keep, extra, b = _KEEP.get(initial, _NO_STATE), CUT_OFF * cut, []
        for q in range(4):
            least = min(after[q] + DROP, after[_FILL[q]] + RECAST + extra)
            if keep[q] is not None:
                least = min(least, after[keep[q]] + extra)
            b.append(least + copies)
    user, assistant = min(b[USER], b[ASSISTANT] + ADD), min(b[ASSISTANT], b[USER] + ADD)
    return min(b[START], user + ADD), min(b[SYSTEM], user + ADD), user, assistant


def costs_to_go(rows: list[tuple], end: Iterable[int]) -> list[tuple[int, ...]]:
    """Least costs of each state before each row, and ``end`` after the last."""
    out = [tuple(end)]
    for row in reversed(rows):
        out.append(_before(row, out[-1]))
    return out[::-1]


def walk(rows: list[tuple], costs: list[tuple[int, ...]], state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, place of the row, state after it) from a state on, always the first letter of those that keep to the least cost."""
    for i, (initial, gone, cut, n) in enumerate(rows):
        now, after, extra = costs[i], costs[i + 1], CUT_OFF * cut
        keep = _KEEP.get(initial, _NO_STATE)
        copies = DROP * (n if gone else n - 1)
        while not gone:
            left = now[state] - copies
            if after[state] + DROP == left:
                yield "D", i, state
            elif now[_FILL[state]] + ADD == now[state]:
                state = _FILL[state]
                yield "I", i, state
                continue
            elif keep[state] is not None and after[keep[state]] + extra == left:
                state = keep[state]
                yield "K", i, state
            else:
                state = _FILL[state]
                yield "R", i, state
            break
        for _ in range(n if gone else n - 1):
            yield "D", i, state


def closing(state: int) -> int:
    """Rows to insert at the end of a conversation."""
    return FINAL[state] // ADD


# -- the blocks of all conversations -------------------------------------------------------------------


def _blocks(df: DataFrame, columns: list[str], schema: str, work: Callable[[tuple, list[tuple]], Iterable[tuple]]) -> DataFrame:
    """Run ``work((conv_id, block), rows)`` over the rows of each block in order; it gives rows of ``schema`` without the id, which comes first."""
    ordered = df.select("conv_id", "block", "pos", *columns).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    return _streamed(ordered, 2, schema, work)


def _streamed(ordered: DataFrame, keys: int, schema: str, work) -> DataFrame:
    out = ordered.select("conv_id").limit(0).schema.simpleString().removeprefix("struct<").removesuffix(">") + ", " + schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for whole in batches for at in range(0, whole.num_rows, 256) for row in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True))
        made, size = [], 0
        for key, group in groupby(rows, lambda row: row[:keys]):
            for row in work(key, group):
                made.append((key[0], *row))
                size += 1 + sum(len(x) for x in row if isinstance(x, (bytes, str))) // 1024
                if size > 8192:
                    yield batch(made)
                    made, size = [], 0
        if made:
            yield batch(made)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    arrow = to_arrow_schema(StructType.fromDDL(out))
    types, names = arrow.types, arrow.names
    return ordered.mapInArrow(run, out)


def _facts(row: tuple) -> tuple[str, bool, bool, int]:
    """(initial, must go, cut off, n) of (pos, role initial, blank, first, cut, n, ...)."""
    _, initial, blank, first, cut, n = row[:6]
    return initial, blank or not first, cut, n


_FACTS = ["initial", "blank", "first", "cut", "n"]


def _across(facts: DataFrame) -> DataFrame:
    """(conv_id, block, ending, enter, last): for the blocks of conversations that span several, the costs after the block and the state it is entered in."""
    ends = facts.groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("z")).where("a < z")
    keys = ends.select("conv_id", F.explode(F.sequence("a", "z")).alias("block"), "z")
    inside = facts.join(keys, facts["conv_id"].eqNullSafe(keys["conv_id"]) & (facts["block"] == keys["block"]), "left_semi").select("conv_id", "block", "pos", *_FACTS)

    def joint_costs(key, group):
        rows = [_facts(r[2:]) for r in group]
        by_end = [costs_to_go(rows, (NEVER if q != p else 0 for q in range(4)))[0] for p in range(4)]
        yield key[1], [by_end[p][q] for q in range(4) for p in range(4)]

    joint = materialise(_blocks(inside, _FACTS, "block long, costs array<long>", joint_costs), "block_costs")

    def backwards(key, group):
        end = FINAL
        for _, block, costs in group:
            yield block, list(end), end is FINAL
            end = tuple(min(min(costs[4 * q + p] + end[p] for p in range(4)), NEVER) for q in range(4))

    endings = materialise(_streamed(joint.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")), 1, "block long, ending array<long>, last boolean", backwards), "block_endings")
    beside = inside.join(endings, inside["conv_id"].eqNullSafe(endings["conv_id"]) & (inside["block"] == endings["block"])).select(inside["conv_id"], inside["block"], "pos", *_FACTS, "ending")

    def exits(key, group):
        group = list(group)
        rows = [_facts(r[2:]) for r in group]
        costs, out = costs_to_go(rows, group[0][-1]), []
        for state in range(4):
            at = state
            for _, _, at in walk(rows, costs, state):
                pass
            out.append(at)
        yield key[1], out

    ways = _blocks(beside, [*_FACTS, "ending"], "block long, exits array<int>", exits)

    def forwards(key, group):
        state = START
        for _, block, to in group:
            yield block, state
            state = to[state]

    entered = _streamed(ways.repartition("conv_id").sortWithinPartitions("conv_id", "block"), 1, "block long, enter int", forwards)
    return endings.join(entered, endings["conv_id"].eqNullSafe(entered["conv_id"]) & (endings["block"] == entered["block"])).select(endings["conv_id"], endings["block"], "ending", "enter", "last")


def _repaired_block(key: tuple, group: Iterable[tuple]) -> Iterator[tuple]:
    """Pieces of a block: its number, the piece's, counts over the block (in the first piece), edits, and repaired lines."""
    group = list(group)
    _, _, *first_row = group[0]
    ending, enter, last = first_row[-3:]
    alone = ending is None
    rows = [_facts(r[2:]) for r in group]
    costs = costs_to_go(rows, FINAL if alone else ending)
    state = START if alone else enter
    turns = [r[8] for r in group if r[8] is not None]
    initials = [r[3] for r in group]
    inner = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(n - 1 for _, _, _, n in rows)
    blank = sum(r[7] for r in group if r[4])
    first = [r for r in group if r[5] and not r[4]]
    duplicate = sum(r[7] for r in group) - blank - len(first)
    counts = [blank, duplicate, sum(r[6] for r in first), inner, len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None, initials[0], initials[-1]]
    cost = number = size = 0
    edits: list[str] = []
    lines: list[str] = []

    def piece():
        return key[1], number, *(counts if number == 0 else [None] * len(counts)), cost, "".join(edits), "\n".join(lines).encode()

    for edit, i, state in walk(rows, costs, state):
        edits.append(edit)
        row = group[i]
        if edit == "D":
            cost += DROP
            continue
        cost += {"K": 0, "I": ADD, "R": RECAST}[edit] + (CUT_OFF * row[6] if edit != "I" else 0)
        lines.append(f"{row[9]}:{row[10]}" if edit == "K" else f"{_NAMES[state]}:{'' if edit == 'I' else row[10]}")
        size += len(lines[-1])
        if size > PIECE_BYTES:
            yield piece()
            number, cost, size, edits, lines = number + 1, 0, 0, [], []
    if alone or last:
        for _ in range(closing(state)):
            state = _FILL[state]
            edits.append("I")
            cost += ADD
            lines.append(f"{_NAMES[state]}:")
    yield piece()


def _whole(key: tuple, group: Iterable[tuple]) -> Iterator[tuple]:
    """One row for a conversation from its pieces in order."""
    blank = duplicate = cut = illegal = distinct = cost = 0
    least = most = initial = None
    audit, digest, begun = [], sha256(), False
    for _, _, number, *counts, price, edits, lines in group:
        if number == 0:
            b, d, c, inner, turns, low, high, one, other = counts
            blank, duplicate, cut, illegal, distinct = blank + b, duplicate + d, cut + c, illegal + inner, distinct + turns
            illegal += initial is not None and initial + one not in _LEGAL
            initial = other
            if low is not None:
                distinct -= low == most
                least, most = low if least is None else least, high
        cost += price
        audit.append(edits)
        if lines:
            digest.update(b"\n" * begun + lines)
            begun = True
    yield 0 if least is None else most - least + 1 - distinct, blank, duplicate, cut, illegal, cost, "".join(audit), digest.hexdigest()


_COUNTS = "blank long, duplicate long, cut long, illegal long, turns long, low long, high long, one string, other string"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, copies: str | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation with rows.

    ``rows``: conv_id, turn (whole number), role, text; with ``copies``, a column that says how often a row stands there.
    """
    space = F.lit(" ")
    n = F.lit(1).cast("long") if copies is None else F.col(copies).cast("long")
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), n.alias("n")).where("n > 0")
    once = own.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    placed = numbered(once, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"], "pos")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = placed.groupBy("conv_id", said.alias("said")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    facts = placed.join(firsts, "pos", "left").select(
        "conv_id", F.floor(F.col("pos") / block).cast("long").alias("block"), "pos", F.substring("role", 1, 1).alias("initial"), _blank(F.col("text")).alias("blank"),
        F.coalesce("first", F.lit(False)).alias("first"), (~_blank(F.col("text")) & ~_stopped(F.col("text"))).alias("cut"), "n", "turn", "role", "text",
    )
    facts = materialise(facts, "facts")
    across = _across(facts)
    beside = facts.join(across, facts["conv_id"].eqNullSafe(across["conv_id"]) & (facts["block"] == across["block"]), "left").select(*(facts[c] for c in facts.columns), "ending", "enter", "last")
    pieces = _blocks(beside, [*_FACTS, "turn", "role", "text", "ending", "enter", "last"], f"block long, piece int, {_COUNTS}, cost long, audit string, lines binary", _repaired_block)
    return _streamed(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece"), 1, _RESULT, _whole)


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _stopped(text: Column) -> Column:
    """Whether the last character that is no white space ends a sentence."""
    return text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: faults and cheapest repair of every conversation after damage; those that lose all their rows are empty."""
    rows = table(spark, sf_dir, "conversations")
    done = repair(damage(rows), "n").withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
