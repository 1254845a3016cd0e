"""Repair of a conversation's structure: the cheapest edits, found by a scan of min-plus matrices.

A repaired conversation's role initials are ``(s?(ua)+)?``. The automaton of that has four states (nothing yet, after s, after u,
after a), so each turn is a 4x4 matrix: from state i to state j, the cheapest edit of this turn and the insertions after it, an element
(cost, audit) where audit has a letter for each edit. Elements add by the least (cost, audit) and multiply by summing costs and joining
audits. Both sides distribute: of two elements between the same states over the same turns, one audit can begin with the other only by more
insertions, which cost more. So products are associative and turns can be multiplied in any tree.

Edits: Keep costs 0; Rerole to user or assistant 3; Delete 4; Insert a user or assistant turn without text 3, anywhere. Blank turns
and those whose role and text came before must be deleted; a truncated turn (its last character that is no blank is none of ``.!?``) adds 3 unless
deleted. Of equal costs the audit that is least in ASCII is taken; it fixes the repaired turns.

How it runs: equal rows are counted before they are exchanged, rows are dealt by ranges of (conversation, turn, role, text), and each task
folds its rows to blocks of at most ROWS rows and about BYTES bytes. A conversation inside one block is finished there. Those that are
longer, or at a range's edge, keep a matrix to each block: matrices are multiplied FAN at a time, in as many rounds as it takes, and
the audit is then cut along the blocks, each of which edits its own turns. Copies of a turn are looked up by a digest of role and text (SHA-256) whose keys are salted.

Nulls: a null role or text is one space, a null turn sorts first and counts for no gap, the rows of a null conv_id are one conversation.
Rows of equal turn are in order of role, then text. Repeated rows are duplicates. Text of any length is one turn. A conversation
without rows is not in the result; an empty table gives none. Other columns are ignored. One thing has to fit a row: the audit, a letter a turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialise, parts_for

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\f\r"
#: Rows and bytes of a block, and blocks that are multiplied together.
ROWS, BYTES, FAN = 1024, 1 << 20, 64
#: Parts into which the rows of one role and text are dealt.
SALTS = 16
#: Of roles and texts, the characters that ranges look at.
EDGE = 64

# The semiring and the automaton.

Element = tuple[int, str]
Matrix = tuple[Element | None, ...]
#: The state after an initial, by state; None where it may not stand there.
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_FINAL = (0, 3)


def times(x: Matrix, y: Matrix) -> Matrix:
    out: list[Element | None] = []
    for i in (0, 4, 8, 12):
        for j in range(4):
            best = None
            for k in range(4):
                a, b = x[i + k], y[4 * k + j]
                if a is None or b is None or (best is not None and a[0] + b[0] > best[0]):
                    continue
                new = (a[0] + b[0], a[1] + b[1])
                best = new if best is None or new < best else best
            out.append(best)
    return tuple(out)


def _matrix(edges: list[tuple[int, int | None, Element]]) -> Matrix:
    out: list[Element | None] = [None] * 16
    for i, j, element in edges:
        if j is not None and (out[4 * i + j] is None or element < out[4 * i + j]):
            out[4 * i + j] = element
    return tuple(out)


ONE = _matrix([(i, i, (0, "")) for i in range(4)])
_STEP = _matrix([(i, i, (0, "")) for i in range(4)] + [(i, _AFTER[r][i], (INSERT, "I")) for i in range(4) for r in "ua"])
#: Any number of insertions: no path of the cheapest ones meets a state twice.
CLOSURE = times(_STEP, times(_STEP, _STEP))


@lru_cache(maxsize=16)
def turn_matrix(symbol: str) -> Matrix:
    """Of a turn's initial s, u, a or o (any other), upper case if truncated; x if it must go."""
    edges = [(i, i, (DELETE, "D")) for i in range(4)]
    if symbol != "x":
        more, initial = TRUNCATED * symbol.isupper(), symbol.lower()
        if initial in _AFTER:
            edges += [(i, _AFTER[initial][i], (KEEP + more, "K")) for i in range(4)]
        edges += [(i, _AFTER[r][i], (REROLE + more, "R")) for i in range(4) for r in "ua"]
    return times(_matrix(edges), CLOSURE)


@lru_cache(maxsize=1 << 15)
def _few(symbols: str) -> Matrix:
    return product([turn_matrix(s) for s in symbols])


def product(matrices: list[Matrix]) -> Matrix:
    """The product in order, by halves."""
    if len(matrices) < 2:
        return matrices[0] if matrices else ONE
    half = len(matrices) // 2
    return times(product(matrices[:half]), product(matrices[half:]))


def fold(symbols: str) -> Matrix:
    """The matrix of turns one after the other; those of eight turns are kept."""
    return product([_few(symbols[i : i + 8]) for i in range(0, len(symbols), 8)])


def cheapest(matrix: Matrix) -> Element:
    whole = times(CLOSURE, matrix)
    return min(whole[j] for j in _FINAL if whole[j] is not None)


def edited(letters: str, copies: list[int], at: int) -> tuple[list[int], list[str | None]]:
    """The repaired turns: (row, or -1 where one is inserted), and their roles where they are not the row's own. at: how many of
    user and assistant stand before, -1 where a system turn is still to come."""
    rows, roles, row, left = [], [], -1, 0
    for letter in letters:
        if letter != "I":
            if not left:
                row += 1
                left = copies[row]
            left -= 1
            if letter == "D":
                continue
        rows.append(-1 if letter == "I" else row)
        roles.append(None if letter == "K" else "assistant" if at % 2 else "user")
        at += 1
    return rows, roles


# Rows and blocks.


class Repair(NamedTuple):
    """reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and turns (array of role and text) where all of the conversation
    is in one block, else null. parts: conv_id, part, block, turns of the others, in order of part and block."""

    reports: DataFrame
    parts: DataFrame


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_NARROW = (
    "blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, head string, tail string, first long, last long, rows long, "
    "costs array<long>, audits array<string>"
)
_LEGAL = {"su", "ua", "au"}


def visible(text: Column) -> Column:
    """The text up to its last character that is no blank."""
    return F.rtrim(text, F.lit(BLANKS))


def repair(chats: DataFrame, *, most: int = ROWS, size: int = BYTES) -> Repair:
    """Repairs each conversation of chats(conv_id, turn, role, text), in blocks of at most so many rows and about so many bytes."""
    kind = chats.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    chats = chats.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    said = chats.where(visible(F.col("text")) != "").select("conv_id", digest.alias("digest"), place.alias("place"))
    again = said.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    again = again.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    rows = chats.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("digest", digest).withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    end = visible(F.col("text"))
    fault = F.when(end == "", 3).when(F.coalesce(place > F.col("first"), F.lit(False)), 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    rows = rows.select("conv_id", "turn", "copies", fault.alias("fault"), initial.alias("initial"), "role", "text")
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.left("role", F.lit(EDGE)), F.left("text", F.lit(EDGE))]
    rows = rows.repartitionByRange(parts_for(chats), *key).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = f"conv_id {kind}, part int, block long, whole boolean, {_NARROW}, cost long, audit string, turns array<struct<role: string, text: string, copies: long>>"
    blocks = materialise(rows.mapInArrow(lean(lambda batches: _blocks(batches, most, size)), schema), "repair-blocks")
    whole, rest = blocks.where("whole"), blocks.where("not whole")
    roots = materialise(_roots(rest.select("conv_id", "part", "block", *_names()), kind), "repair-roots")
    counts = [(F.coalesce(F.col("high") - F.col("low") + 1, F.lit(0).cast("long")) - F.col("distinct")).alias("gaps"), *_COUNTS, "cost", "audit"]
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    reports = whole.select("conv_id", *counts, turns.alias("turns"))
    reports = reports.unionByName(roots.select("conv_id", *counts, F.lit(None).cast("array<struct<role: string, text: string>>").alias("turns")))
    return Repair(reports, _parts(rest, roots, kind))


def _names() -> list[str]:
    return [x.split()[0] for x in _NARROW.split(", ")]


def _blocks(batches: Iterator[pa.RecordBatch], most: int, room: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks. The rows of the last block of a batch wait for the next one."""
    from pyspark import TaskContext

    part, first_conv, number, held = TaskContext.get().partitionId(), True, 0, None
    # first_conv: the block belongs to the conversation that the task begins with. number: of the block in its conversation.
    for batch in _ended(batches):
        rows = held if batch is None else batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if rows is None or not rows.num_rows:
            continue
        convs, turns, copies, faults, initials = (rows.column(c).to_pylist() for c in range(5))
        sizes = (pc.add(pc.binary_length(rows.column(5)), pc.binary_length(rows.column(6)))).to_pylist()
        starts, size = [0], 0
        for i in range(rows.num_rows):
            if i > starts[-1] and (convs[i] != convs[i - 1] or i - starts[-1] >= most or size >= room):
                starts.append(i)
                size = 0
            size += sizes[i]
        ends = [*starts[1:], rows.num_rows]
        if batch is not None:
            held = rows.slice(starts[-1])
            starts, ends = starts[:-1], ends[:-1]
        found, take, names, cut = [], [], [], [0]
        for low, high in zip(starts, ends, strict=True):
            last = high == rows.num_rows  # only when the task ends
            same = not last and convs[high] == convs[low]
            alone = not first_conv and not last and not same and number == 0
            block, matrix = _summed(turns[low:high], copies[low:high], faults[low:high], initials[low:high])
            block |= {"conv_id": convs[low], "part": part, "block": number, "whole": alone}
            if alone:
                block["cost"], block["audit"] = cheapest(matrix)
                kept, roles = edited(block["audit"], copies[low:high], -(_length(block["audit"]) % 2))
                take += [None if k < 0 else low + k for k in kept]
                names += roles
            else:
                block |= _stored(matrix)
                take += range(low, high)
                names += [None] * (high - low)
            cut.append(len(take))
            found.append(block)
            number, first_conv = (number + 1, first_conv) if same else (0, False)
        if found:
            yield _block_batch(found, rows, take, names, cut)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _length(audit: str) -> int:
    """Turns of the repaired conversation."""
    return len(audit) - audit.count("D")


def _summed(turns: list, copies: list, faults: list, initials: list) -> tuple[dict, Matrix]:
    """What a block says of its rows, and their matrix."""
    known = [t for t in turns if t is not None]
    symbols, n = [], {0: 0, 1: 0, 2: 0, 3: 0}
    extra = 0
    for c, fault, initial in zip(copies, faults, initials, strict=True):
        symbols.append((initial, initial.upper(), "x", "x")[fault] + "x" * (c - 1))
        n[fault] += c if fault > 1 else 1
        extra += c - 1 if fault < 2 else 0
    illegal = sum(copies) - len(copies) + sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
    block = {
        "blank": n[3], "duplicate": n[2] + extra, "truncated": n[1], "illegal": illegal, "distinct": len(set(known)), "low": min(known, default=None), "high": max(known, default=None),
        "head": initials[0], "tail": initials[-1], "first": turns[0], "last": turns[-1], "rows": sum(copies),
    }
    return block, fold("".join(symbols))


def _stored(matrix: Matrix) -> dict:
    return {"costs": [None if x is None else x[0] for x in matrix], "audits": [None if x is None else x[1] for x in matrix]}


def _block_batch(found: list[dict], rows: pa.RecordBatch, take: list, names: list, cut: list) -> pa.RecordBatch:
    at = pa.array(take, pa.int64())
    roles = pc.coalesce(pa.array(names, pa.string()), rows.column(5).take(at))
    texts = pc.fill_null(rows.column(6).take(at), "")
    turns = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([roles, texts, rows.column(2).take(at)], ["role", "text", "copies"]))
    kinds = {"conv_id": rows.schema.field(0).type, "part": pa.int32(), "whole": pa.bool_(), **_KINDS}
    order = ["conv_id", "part", "block", "whole", *_names(), "cost", "audit"]
    return pa.RecordBatch.from_arrays([pa.array([b.get(c) for b in found], kinds.get(c, pa.int64())) for c in order] + [turns], [*order, "turns"])


_KINDS = {"head": pa.string(), "tail": pa.string(), "audit": pa.string(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}


def _joined(blocks: list[dict]) -> dict:
    """One block of neighbouring ones, in order."""
    out = {c: sum(b[c] for b in blocks) for c in (*_COUNTS, "distinct", "rows")}
    for a, b in zip(blocks, blocks[1:], strict=False):
        out["illegal"] += a["tail"] + b["head"] not in _LEGAL
        out["distinct"] -= a["last"] is not None and a["last"] == b["first"]
    out["low"] = min((b["low"] for b in blocks if b["low"] is not None), default=None)
    out["high"] = max((b["high"] for b in blocks if b["high"] is not None), default=None)
    out |= {"head": blocks[0]["head"], "first": blocks[0]["first"], "tail": blocks[-1]["tail"], "last": blocks[-1]["last"]}
    matrix = product([tuple(None if c is None else (c, a) for c, a in zip(b["costs"], b["audits"], strict=True)) for b in blocks])
    return out | _stored(matrix) | {"matrix": matrix}


def _roots(blocks: DataFrame, kind: str) -> DataFrame:
    """Multiply the blocks of each conversation, FAN at a time."""
    most = blocks.agg(F.max("block")).first()[0] or 0
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    shift = FAN.bit_length() - 1
    names, arrow = _names(), {**_KINDS, "part": pa.int32()}

    def one(table: pa.Table, extra: tuple[str, ...]) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda b: (b["part"], b["block"]))
        out = _joined(rows) | {"part": rows[0]["to_part"] if "to_part" in rows[0] else 0, "block": rows[0].get("to_block", 0)}
        if "cost" in extra:
            out["cost"], out["audit"] = cheapest(out["matrix"])
        wanted = ["part", "block", *names, *extra]
        columns = [table.column("conv_id").slice(0, 1).combine_chunks()] + [pa.array([out[c]], arrow.get(c, pa.int64())) for c in wanted]
        return pa.Table.from_arrays(columns, names=["conv_id", *wanted])

    def smaller(table: pa.Table) -> pa.Table:
        return one(table, ())

    def finished(table: pa.Table) -> pa.Table:
        return one(table, ("cost", "audit"))

    schema = f"conv_id {kind}, part int, block long, {_NARROW}"
    while most:
        blocks = blocks.withColumn("to_part", F.col("part")).withColumn("to_block", F.shiftright("block", shift))
        blocks = blocks.groupBy("conv_id", "to_part", "to_block").applyInArrow(smaller, schema)
        most >>= shift
    while parts > FAN:
        blocks = blocks.withColumn("to_part", F.shiftright("part", shift)).withColumn("to_block", F.col("block"))
        blocks = blocks.groupBy("conv_id", "to_part", "to_block").applyInArrow(smaller, schema)
        parts = -(-parts >> shift)
    return blocks.groupBy("conv_id").applyInArrow(finished, f"{schema}, cost long, audit string")


def _parts(blocks: DataFrame, roots: DataFrame, kind: str) -> DataFrame:
    """Cut each audit along its conversation's blocks, and edit the blocks' turns."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("part", "ascending"), ("block", "ascending")])
        audit = right.column("audit")[0].as_py()
        letters = np.frombuffer(audit.encode(), np.uint8)
        edits = np.append(np.flatnonzero(letters != ord("I")), len(letters))  # an edit of a row each, and the end
        ends = np.cumsum(left.column("rows").to_numpy())
        bounds = np.concatenate([[0], edits[ends[:-1]], [len(letters)]])
        turns = np.concatenate([[0], np.cumsum(letters != ord("D"))])
        pieces = [audit[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        columns = [left.column(c) for c in ("conv_id", "part", "block")]
        return pa.Table.from_arrays([*columns, pa.array(pieces, pa.string()), pa.array(turns[bounds[:-1]] - turns[-1] % 2, pa.int64())], names=["conv_id", "part", "block", "letters", "at"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                turns = batch.column(3)[i].values
                rows, roles = edited(batch.column(4)[i].as_py(), turns.field("copies").to_pylist(), batch.column(5)[i].as_py())
                at = pa.array([None if r < 0 else r for r in rows], pa.int64())
                named = pc.coalesce(pa.array(roles, pa.string()), turns.field("role").take(at))
                new = pa.StructArray.from_arrays([named, pc.fill_null(turns.field("text").take(at), "")], ["role", "text"])
                listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), new)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(3)), listed], ["conv_id", "part", "block", "turns"])

    sizes = blocks.select("conv_id", "part", "block", "rows").groupBy("conv_id")
    letters = sizes.cogroup(roots.select("conv_id", "audit").groupBy("conv_id")).applyInArrow(cut, f"conv_id {kind}, part int, block long, letters string, at long")
    letters = letters.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("block").alias("b"), "letters", "at")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))
    rows = blocks.select("conv_id", "part", "block", "turns").join(letters, same).select("conv_id", "part", "block", "turns", "letters", "at")
    return rows.mapInArrow(lean(edit), f"conv_id {kind}, part int, block long, turns array<struct<role: string, text: string>>")


def lines(turns: Column) -> Column:
    """``role:text`` of each turn, one below the other."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def digests(repaired: Repair) -> DataFrame:
    """The reports with repaired_sha256 in place of turns: of ``lines`` of all a conversation's turns. A digest is computed in order, so
    the blocks of a long conversation pass through one task, which holds a batch of them."""
    import hashlib

    short = repaired.reports.where("turns is not null").withColumn("repaired_sha256", F.sha2(lines(F.col("turns")), 256)).drop("turns")
    kind = repaired.parts.schema["conv_id"].dataType.simpleString()
    parts = repaired.parts.select("conv_id", "part", "block", F.size("turns").alias("n"), lines(F.col("turns")).alias("lines"))
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, pa.array([state.hexdigest()])], ["conv_id", "sha"])

        for batch in batches:
            for i in range(batch.num_rows):
                its = batch.column(0).slice(i, 1)
                if state is None or its[0].as_py() != key[0].as_py():
                    if state is not None:
                        yield done()
                    key, state, begun = its, hashlib.sha256(), False
                if batch.column(3)[i].as_py():
                    state.update((b"\n" if begun else b"") + batch.column(4)[i].as_py().encode())
                    begun = True
        if state is not None:
            yield done()

    found = parts.mapInArrow(run, f"conv_id {kind}, sha string").select(F.col("conv_id").alias("c"), "sha")
    long = repaired.reports.where("turns is null").drop("turns").join(found, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return short.unionByName(long.withColumnRenamed("sha", "repaired_sha256"))


def damage(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of chats, damaged by crc32(``conv_id:turn``) % 20; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "utf-8")) % 20
    rows = chats.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")
