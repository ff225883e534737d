"""Repairing the structure of conversations by the cheapest edits, with an audit of every choice.

A conversation's rows become symbols of role and fault. Edits keep, rerole, delete or insert rows so that the roles read
`(s?(ua)+)?`; each symbol is a min-plus matrix over the four states of that pattern. Equal consecutive symbols collapse
to runs, which matrices and cost vectors cross by cached binary powers; then the choices are unrolled row by row.

Rows are range-sorted over the whole table, so one conversation may lie in many tasks: each task sums its segments up
as matrices, a pass over the segments from the last to the first gives the cost that is left behind each of them, and
segments are unrolled apart for each state that they may start in. Texts are shuffled once, to meet their edits; a task
streams them in order and holds one row and one conversation's edits, which are one string of the result in any case.
A hash over a whole conversation can't be split, so that stream is one task's work even where a conversation is huge.

Cases: null roles and texts, and null ids and turns inside the damage's key, read as one space; a null conv_id is a
conversation of its own; rows of one turn are ordered by role, the first 32 characters of the text and its digest, null
turns first; equal rows are duplicates of the first; an unknown or empty role can't be kept; a conversation without rows
has no edits; very long texts pass whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import gathered, materialise, partitions, rows

#: States: nothing yet, after a system, a user, an assistant row. An insert leads from a state to INSERTED[state].
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = (USER, USER, ASSISTANT, USER)
ROLES = ("s", "u", "a")
#: Costs of the edits; a truncated row that stays adds UNMENDED.
DELETE, INSERT, REROLE, UNMENDED = 2, 5, 1, 5
SOUND, TRUNCATED, GONE = range(3)
NEVER = 1 << 60
#: So many runs of a conversation make one segment at most.
SEGMENT = 1 << 20
Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def symbol(kind: int, fault: int) -> int:
    """kind: 0 to 2 for s, u, a, else 3."""
    return 3 * kind + fault


def kept_to(kind: int, state: int) -> int | None:
    """The state after keeping a row of this role, or None where that is illegal."""
    if kind == 0:
        return SYSTEM if state == EMPTY else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if kind == 2 and state == USER else None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(NEVER, *(x + y for x, y in zip(row, v, strict=True))) for row in a)


def _inserts() -> Matrix:
    one = tuple(tuple(0 if i == j else INSERT if INSERTED[i] == j else NEVER for j in range(4)) for i in range(4))
    return times(times(one, one), times(one, one))


UNIT: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))
INSERTS = _inserts()
#: What is left to pay after the last row.
END: Vector = applied(INSERTS, (0, NEVER, NEVER, 0))


@lru_cache(None)
def power(code: int, k: int) -> Matrix:
    """The matrix of 2^k rows of one symbol."""
    if k:
        return times(power(code, k - 1), power(code, k - 1))
    kind, fault = divmod(code, 3)
    cost = [[NEVER] * 4 for _ in range(4)]
    for q in range(4):
        cost[q][q] = DELETE
        if fault != GONE:
            more = UNMENDED if fault == TRUNCATED else 0
            to = INSERTED[q]
            cost[q][to] = min(cost[q][to], REROLE + more)
            if (to := kept_to(kind, q)) is not None:
                cost[q][to] = min(cost[q][to], more)
    return times(INSERTS, tuple(map(tuple, cost)))


def _bits(length: int) -> Iterator[int]:
    return (k for k in range(length.bit_length()) if length >> k & 1)


def _based(v: Vector) -> tuple[Vector, int]:
    least = min(v)
    return tuple(x - least for x in v), least


@lru_cache(1 << 16)
def before(code: int, length: int, v: Vector) -> tuple[Vector, int]:
    """The cost vector before a run, from the one behind it, as a vector whose least is 0 and that least."""
    for k in _bits(length):
        v = applied(power(code, k), v)
    return _based(v)


@lru_cache(1 << 16)
def _grown(flat: Vector, code: int, length: int) -> tuple[Vector, int]:
    m: Matrix = tuple(flat[i : i + 4] for i in range(0, 16, 4))
    for k in _bits(length):
        m = times(m, power(code, k))
    least = min(x for row in m for x in row)
    return tuple(x if x >= NEVER else x - least for row in m for x in row), least


def summed(codes: bytes, lengths: list[int]) -> Vector:
    """The matrix of a segment, row by row."""
    flat, total = tuple(x for row in UNIT for x in row), 0
    for code, length in zip(codes, lengths, strict=True):
        flat, least = _grown(flat, code, length)
        total += least
    return tuple(NEVER if x >= NEVER else x + total for x in flat)


def _run(code: int, length: int, v: Vector, q: int) -> tuple[str, int]:
    """The edits of a run from state q, and the state behind it: at each row the first letter that keeps the cost least."""
    behind = [v]
    for _ in range(length):
        behind.append(before(code, 1, behind[-1])[0])
    kind, fault = divmod(code, 3)
    more = UNMENDED if fault == TRUNCATED else 0
    said = []
    for left in range(length, 0, -1):
        after = behind[left - 1]
        here, base = before(code, 1, after)
        while True:
            now, kept = here[q] + base, kept_to(kind, q)
            if DELETE + after[q] == now:
                said.append("D")
            elif INSERT + here[INSERTED[q]] + base == now:
                said.append("I")
                q = INSERTED[q]
                continue
            elif fault != GONE and kept is not None and more + after[kept] == now:
                said.append("K")
                q = kept
            else:
                said.append("R")
                q = INSERTED[q]
            break
    return "".join(said), q


_short_run = lru_cache(1 << 16)(_run)


def unrolled(codes: bytes, lengths: list[int], v: Vector, starts: range) -> list[tuple[str, int]]:
    """For each start state of a segment, the edits and the state behind it; v is what is left to pay behind the segment."""
    v, vectors = _based(v)[0], []
    for code, length in zip(reversed(codes), reversed(lengths), strict=True):
        vectors.append(v)
        v = before(code, length, v)[0]
    out = []
    for q in starts:
        said = []
        for code, length, behind in zip(codes, lengths, reversed(vectors), strict=True):
            text, q = (_short_run if length <= 64 else _run)(code, length, behind, q)
            said.append(text)
        out.append(("".join(said), q))
    return out


def closing(q: int) -> str:
    """The edits after the last row."""
    return {SYSTEM: "II", USER: "I"}.get(q, "")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: rows as the damage leaves them; copy is 0 for those that it drops."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("how") == 0, F.array(F.lit(0))).when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest")]


def _with_keys(d: DataFrame) -> DataFrame:
    return d.withColumn("head", F.substring("text", 1, 32)).withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def faults(rows_: DataFrame) -> DataFrame:
    """The rows without their texts, with `fault`: blank, duplicate, truncated or null (the first that holds), and `kind`.

    rows_: as damaged() returns them. A duplicate is any row but the first of its conversation, role and text.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z")
    slim = _with_keys(rows_).select("conv_id", "turn", "role", "head", "digest", "copy", blank.alias("blank"), cut.alias("cut"), F.monotonically_increasing_id().alias("row"))
    slim = materialise(slim.withColumn("salt", F.xxhash64("row")), "turns")
    place = F.struct("turn", "salt", "row")
    first = slim.where("copy > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("__first"))
    first = first.select(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), F.col("digest").alias("__digest"), "__first")
    met = slim.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest")), "left")
    fault = F.when(F.col("copy") == 0, None).when(F.col("blank"), "blank").when(F.col("row") != F.col("__first.row"), "duplicate").when(F.col("cut"), "truncated")
    start = F.substring("role", 1, 1)
    kind = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    return materialise(met.select("conv_id", "turn", "role", "head", "digest", "copy", "salt", "row", fault.alias("fault"), kind.alias("kind")), "faults")


def _legal(a: int, b: int) -> bool:
    """su, ua and au."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _segments(conv: pa.DataType) -> Callable:
    schema = pa.schema([("conv_id", conv), ("part", pa.int32()), ("seq", pa.int64()), ("inner", pa.bool_()), ("first", pa.int32()), ("last", pa.int32()), ("illegal", pa.int64()), ("codes", pa.binary()), ("lengths", pa.list_(pa.int32())), ("matrix", pa.list_(pa.int64()))])

    def cut(found: Iterator[tuple]) -> Iterator[tuple]:
        """(conv, part, whether the conversation goes on, runs) for each segment of the sorted rows."""
        for (conv_id,), own in groupby(found, lambda r: (r[0],)):
            runs: list[list[int]] = []
            part = 0
            for _, part, code in own:
                if runs and runs[-1][0] == code:
                    runs[-1][1] += 1
                    continue
                if len(runs) == SEGMENT:
                    yield conv_id, part, True, runs
                    runs = []
                runs.append([code, 1])
            yield conv_id, part, False, runs

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, before_, n = None, True, 0  # a segment waits until it is known whether another conversation follows
        for conv_id, part, on, runs in cut(rows(batches, "conv_id", "part", "code")):
            codes, lengths = bytes(c for c, _ in runs), [n for _, n in runs]
            kinds = [c // 3 for c in codes]
            illegal = sum((k - 1) * (not _legal(c // 3, c // 3)) for c, k in runs) + sum(not _legal(a, b) for a, b in zip(kinds, kinds[1:], strict=False))
            if held:
                yield held
            held = (conv_id, part, n, not (before_ or on), kinds[0], kinds[-1], illegal, codes, lengths, list(summed(codes, lengths)))
            before_, n = on, n + 1
        if held:
            yield (*held[:3], False, *held[4:])

    return lambda batches: gathered(made(batches), schema, lambda r: 200 + 8 * len(r[7]))


def segments(flagged: DataFrame) -> DataFrame:
    """Runs of symbols with their matrices: a row a conversation and task, in the order of part and seq.

    inner: the segment is its whole conversation, as others stand before and behind it in the task.
    """
    d = flagged.where("copy > 0")
    fault = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", TRUNCATED).otherwise(SOUND)
    d = d.withColumn("code", (3 * F.col("kind") + fault).cast("int"))
    order = [F.col("conv_id").asc_nulls_first(), *_order(), F.col("salt"), F.col("row")]
    d = d.repartitionByRange(partitions(d.sparkSession), *order).sortWithinPartitions(*order)
    d = d.select("conv_id", F.spark_partition_id().alias("part"), "code")
    conv = d.schema["conv_id"].dataType
    made = _segments(_arrow(conv))
    return materialise(d.mapInArrow(made, f"conv_id {conv.simpleString()}, part int, seq long, inner boolean, first int, last int, illegal long, codes binary, lengths array<int>, matrix array<long>"), "segments")


def _arrow(kind: object) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _left(conv: pa.DataType) -> Callable:
    schema = pa.schema([("conv_id", conv), ("part", pa.int32()), ("seq", pa.int64()), ("left", pa.list_(pa.int64())), ("lead", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (_,), own in groupby(rows(batches, "conv_id", "part", "seq", "first", "last", "illegal", "matrix"), lambda r: (r[0],)):
            v, illegal, behind, held = END, 0, None, None
            for conv_id, part, seq, first, last, bad, flat in own:
                if held:
                    yield (*held, False, 0, 0)
                illegal += bad + (behind is not None and not _legal(last, behind))
                held, behind = (conv_id, part, seq, list(v)), first
                v = applied(tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4)), v)
            yield (*held, True, v[EMPTY], illegal)

    return lambda batches: gathered(made(batches), schema, lambda r: 120)


def costs(parts: DataFrame) -> DataFrame:
    """By segment: `left`, what is to pay behind it by state; in a conversation's first segment (lead) also its cost and illegal pairs."""
    slim = parts.select("conv_id", "part", "seq", "first", "last", "illegal", "matrix")
    slim = slim.repartition(partitions(slim.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    conv = parts.schema["conv_id"].dataType
    return materialise(slim.mapInArrow(_left(_arrow(conv)), f"conv_id {conv.simpleString()}, part int, seq long, left array<long>, lead boolean, cost long, illegal long"), "costs")


def _edits(conv: pa.DataType) -> Callable:
    schema = pa.schema([("conv_id", conv), ("part", pa.int32()), ("seq", pa.int64()), ("edits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, part, seq, inner, codes, lengths, left in rows(batches, "conv_id", "part", "seq", "inner", "codes", "lengths", "left"):
            found = unrolled(codes, lengths, tuple(left), range(1 if inner else 4))
            yield conv_id, part, seq, [x for x, _ in found], [q for _, q in found]

    return lambda batches: gathered(made(batches), schema, lambda r: 80 + sum(map(len, r[3])))


def edits(parts: DataFrame, left: DataFrame) -> DataFrame:
    """By segment and start state: the edits of its rows and the state behind it."""
    own = left.select(F.col("part").alias("__part"), F.col("seq").alias("__seq"), "left")
    met = parts.join(own, (F.col("part") == F.col("__part")) & (F.col("seq") == F.col("__seq"))).select("conv_id", "part", "seq", "inner", "codes", "lengths", "left")
    conv = parts.schema["conv_id"].dataType
    return met.mapInArrow(_edits(_arrow(conv)), f"conv_id {conv.simpleString()}, part int, seq long, edits array<string>, ends array<int>")


def _repaired(conv: pa.DataType) -> Callable:
    schema = pa.schema([("conv_id", conv), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv_id,), own in groupby(rows(batches, "conv_id", "edits", "ends", "role", "text"), lambda r: (r[0],)):
            said, q, audit = [], EMPTY, None
            at = state = EMPTY
            for _, choices, ends, role, text in own:
                if choices is not None:
                    said.append(choices[q])
                    q = ends[q]
                    continue
                if audit is None:
                    audit = "".join([*said, closing(q)])
                while audit[at] == "I":
                    state, at = INSERTED[state], at + 1
                    yield conv_id, "I", _named(state), ""
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = kept_to(ROLES.index(role[0]), state)
                elif edit == "R":
                    state = INSERTED[state]
                    role = _named(state)
                yield conv_id, edit, role, text
            for _ in (audit or "")[at:]:
                state = INSERTED[state]
                yield conv_id, "I", _named(state), ""

    return lambda batches: gathered(made(batches), schema, lambda r: 40 + 4 * len(r[3]))


def _named(state: int) -> str:
    return "assistant" if state == ASSISTANT else "user"


def repaired(rows_: DataFrame, pieces: DataFrame) -> DataFrame:
    """conv_id, edit (K, R, D, I), role, text: every row with its edit, inserted rows among them.

    A conversation's rows lie in one partition, one after the other in order.
    """
    kind, nothing = rows_.schema["turn"].dataType, lambda t: F.lit(None).cast(t)
    d = _with_keys(rows_.where("copy > 0"))
    d = d.select("conv_id", nothing("int").alias("part"), nothing("long").alias("seq"), nothing("array<string>").alias("edits"), nothing("array<int>").alias("ends"), "turn", "role", "head", "digest", "text")
    p = pieces.select("conv_id", "part", "seq", "edits", "ends", nothing(kind).alias("turn"), *(nothing("string").alias(c) for c in ("role", "head")), nothing("binary").alias("digest"), nothing("string").alias("text"))
    both = d.unionByName(p).repartition(partitions(d.sparkSession), "conv_id")
    both = both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("part").asc_nulls_last(), "seq", *_order())
    conv = rows_.schema["conv_id"].dataType
    return both.select("conv_id", "edits", "ends", "role", "text").mapInArrow(_repaired(_arrow(conv)), f"conv_id {conv.simpleString()}, edit string, role string, text string")


def repair(rows_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows_: conv_id, turn, role, text, copy (0 for rows that are gone). Returns the rows with their edits, and a row a
    conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost."""
    flagged = faults(rows_)
    turn = F.when(F.col("copy") > 0, F.col("turn"))
    gaps = F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)
    counts = flagged.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    parts = segments(flagged)
    left = costs(parts)
    totals = left.where("lead").select(F.col("conv_id").alias("__conv"), "illegal", "cost")
    counts = counts.join(totals, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    return repaired(rows_, edits(parts, left)), counts.fillna(0, ["illegal", "cost"])


def _digests(conv: pa.DataType) -> Callable:
    schema = pa.schema([("conv_id", conv), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv_id,), own in groupby(rows(batches, "conv_id", "edit", "role", "text"), lambda r: (r[0],)):
            said, sha, more = [], hashlib.sha256(), ""
            for _, edit, role, text in own:
                said.append(edit)
                if edit != "D":
                    sha.update(f"{more}{role}:{text}".encode())
                    more = "\n"
            yield conv_id, "".join(said), sha.hexdigest()

    return lambda batches: gathered(made(batches), schema, lambda r: 100 + len(r[1]))


def digests(edited: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of rows as repaired() returns them, without another shuffle."""
    conv = edited.schema["conv_id"].dataType
    return edited.mapInArrow(_digests(_arrow(conv)), f"conv_id {conv.simpleString()}, audit string, repaired_sha256 string")
