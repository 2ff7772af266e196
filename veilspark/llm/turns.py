"""Repair of conversations: faults are counted, then the cheapest edits that give legal roles.

Rows are put in order by conversation and turn (nulls first; ties by role, then text) by range
partitions, so one long conversation spreads over tasks, and numbered. A row becomes one symbol,
its role's initial and its fault. Symbols travel in pieces of at most ``CHUNK`` rows; the task
that gathers a conversation holds one byte a row, as the audit it returns does. There equal
consecutive symbols collapse to runs. A run's effect on the four states of the role pattern
(nothing yet, after s, after u, after a) is a power in the min-plus semiring of its symbol's
transition; binary powers are cached for all conversations, so costs jump from run to run.
Choices are then unrolled from the costs, least letter first. The texts meet their edits in the
order of rows and are hashed as they pass; no task holds a conversation's texts.

Null roles, texts, ids and turns read as one space; a conversation without id is one more
conversation. A role without the initial s, u or a fits nowhere and must be changed or deleted.
Repeated rows are rows; a table without rows gives none. Texts are compared by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import store

#: Rows whose symbols travel as one piece; a power of two.
CHUNK_BITS = 12
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, CHANGE, REMOVE, ADD, CUT_OFF = 0, 2, 3, 2, 1
_INFINITE = 1 << 60
#: State after an inserted or changed turn, and its role: only a user's turn is answered by an assistant.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: State after a kept turn of initial s, u or a, for each state it may follow.
_KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
_SPACE = r"\x20\x09-\x0D"


def damage(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv``, ``turn``, ``role`` and ``text`` after damage chosen by the crc32 of id and turn."""
    text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv_col, "turn", "role", "text")}
    fate = F.crc32(F.concat(text[conv_col], F.lit(":"), text["turn"]).cast("binary")) % 20
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv"), F.col("turn").cast("long").alias("turn"), text["role"].alias("role"), text["text"].alias("text"), fate.alias("fate"))
    hurt = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.where("fate <> 0").select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), twice.alias("_")).drop("_")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with ``pos``, ascending by conv, turn, role and text, spread over tasks by ranges."""
    short = [F.substring(c, 1, 64) for c in ("role", "text")]  # what a range border may hold
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "conv", "turn", *short).sortWithinPartitions("conv", "turn", *short, "role", "text").withColumn("pos", F.monotonically_increasing_id())


def _letter(code: Column) -> Column:
    return F.char(code + 65)


def symbols(rows: DataFrame) -> DataFrame:
    """``conv`` and ``pieces``: its symbols in order, as (chunk, letters)."""
    fault = F.when(~F.col("text").rlike(f"[^{_SPACE}]"), BLANK).when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), TRUNCATED).otherwise(0)
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    small = rows.select("conv", "pos", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(7), "role", "text").alias("g"), fault.alias("fault"), role.alias("role"))
    small = store(small, "symbols")
    firsts = small.groupBy("conv", "h", "g").agg(F.min("pos").alias("first"))
    told = small.join(firsts.select("first"), small.pos == F.col("first"), "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    told = told.select("conv", F.shiftright("pos", CHUNK_BITS).alias("chunk"), F.struct("pos", _letter(F.col("role") * 4 + fault).alias("letter")).alias("row"))
    pieces = told.groupBy("conv", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["letter"]), "").alias("letters"))
    return pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", "letters"))).alias("pieces"))


def _times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@cache
def _added() -> tuple:
    """Cheapest insertions from state to state."""
    rows = []
    for start in range(4):
        row, state, cost = [_INFINITE] * 4, start, 0
        while row[state] > cost:
            row[state] = cost
            state, cost = _NEXT[state], cost + ADD
        rows.append(tuple(row))
    return tuple(rows)


@cache
def _choices(letter: str) -> tuple:
    """For each state, the edits of a row: (letter of the edit, cost, state after it), least letter first."""
    role, fault = divmod(ord(letter) - 65, 4)
    more = CUT_OFF if fault == TRUNCATED else 0
    rows = []
    for state in range(4):
        edits = [("D", REMOVE, state)]
        if fault not in (BLANK, DUPLICATE):
            if state in _KEPT[role]:
                edits.append(("K", KEEP + more, _KEPT[role][state]))
            edits.append(("R", CHANGE + more, _NEXT[state]))
        rows.append(tuple(edits))
    return tuple(rows)


@cache
def _power(letter: str, k: int) -> tuple:
    """Transition of 2**k rows of one symbol, with insertions before each."""
    if k:
        return _times(_power(letter, k - 1), _power(letter, k - 1))
    edit = [[_INFINITE] * 4 for _ in range(4)]
    for state, edits in enumerate(_choices(letter)):
        for _, cost, after in edits:
            edit[state][after] = min(edit[state][after], cost)
    return _times(_added(), tuple(map(tuple, edit)))


def _before(matrix: tuple, after: tuple) -> tuple:
    return tuple(min(matrix[i][j] + after[j] for j in range(4)) for i in range(4))


def _runs(letters: str) -> list[tuple[str, int]]:
    runs, start = [], 0
    for i in range(1, len(letters) + 1):
        if i == len(letters) or letters[i] != letters[start]:
            runs.append((letters[start], i - start))
            start = i
    return runs


def repair(letters: str) -> tuple[int, list[str]]:
    """Least cost, and the edits at each row: insertions before it and its own; a last item for those after all rows."""
    end = tuple(min(_added()[s][0], _added()[s][3]) for s in range(4))
    runs, left = _runs(letters), [end]
    for letter, n in reversed(runs):
        costs = left[-1]
        for k in range(n.bit_length()):
            if n >> k & 1:
                costs = _before(_power(letter, k), costs)
        left.append(costs)
    left.reverse()
    state, edits = 0, []
    for r, (letter, n) in enumerate(runs):
        inner = [left[r + 1]]
        for _ in range(n - 1):
            inner.append(_before(_power(letter, 0), inner[-1]))
        here = left[r]
        for after in reversed(inner):
            own = ""
            while True:
                wanted = here[state]
                first = next(((e, s) for e, cost, s in _choices(letter)[state] if e == "D" and cost + after[s] == wanted), None)
                if first is None and ADD + here[_NEXT[state]] == wanted:
                    own, state = own + "I", _NEXT[state]
                    continue
                edit, state = first or next((e, s) for e, cost, s in _choices(letter)[state] if cost + after[s] == wanted)
                break
            edits.append(own + edit)
            here = after
    tail = ""
    while end[state]:
        tail, state = tail + "I", _NEXT[state]
    return left[0][0], [*edits, tail]


@lru_cache(maxsize=1 << 14)
def _short(letters: str) -> tuple[int, list[str]]:
    """Most conversations are short, and many have the same symbols."""
    return repair(letters)


def _counts(letters: str) -> tuple[int, int, int, int]:
    roles = "".join("suax"[(ord(c) - 65) // 4] for c in letters)
    fair = sum(roles[i:i + 2] in ("su", "ua", "au") for i in range(len(roles) - 1))
    faults = [(ord(c) - 65) % 4 for c in letters]
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), max(0, len(roles) - 1) - fair


def audits(told: DataFrame) -> DataFrame:
    """Counts, ``cost`` and ``audit`` of each conversation; ``ops`` are the edits of its pieces (chunk, edits at each row)."""
    conv = told.schema["conv"].dataType.simpleString()
    kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.struct([("chunk", pa.int64()), ("edits", pa.list_(pa.string()))]))]
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "ops"]

    def solve(batches):
        for batch in batches:
            out = []
            for pieces in batch.column(1).to_pylist():
                letters = "".join(p["letters"] for p in pieces)
                cost, edits = _short(letters) if len(letters) <= 64 else repair(letters)
                *own, tail = edits
                own[-1] += tail
                ops, at = [], 0
                for p in pieces:
                    ops.append({"chunk": p["chunk"], "edits": own[at:at + len(p["letters"])]})
                    at += len(p["letters"])
                out.append((*_counts(letters), cost, "".join(own), ops))
            columns = [pa.array(v, t) for v, t in zip(zip(*out), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["conv", *names])

    return told.mapInArrow(solve, f"conv {conv}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, ops array<struct<chunk:bigint,edits:array<string>>>")


def edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after their edits, ``conv``, ``role`` and ``text``; a conversation's follow each other in one partition."""
    conv = rows.schema["conv"].dataType.simpleString()
    nothing = F.lit(None).cast("string")
    edits = found.select("conv", F.explode("ops").alias("op")).select("conv", "op.chunk", F.lit(-1).cast("long").alias("pos"), nothing.alias("role"), nothing.alias("text"), "op.edits")
    texts = rows.select("conv", F.shiftright("pos", CHUNK_BITS).alias("chunk"), "pos", "role", "text", F.lit(None).cast("array<string>").alias("edits"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = edits.unionByName(texts).repartition(n, "conv").sortWithinPartitions("conv", "chunk", "pos").select("conv", "role", "text", "edits")

    def turns(batches):
        ops, state, last = iter(()), 0, object()
        for batch in batches:
            out = ([], [], [])  # row of the batch, role, text
            for i, (conv, role, text, edits) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if conv != last:
                    state, last = 0, conv
                if edits is not None:
                    ops = iter(edits)
                    continue
                for op in next(ops):
                    if op == "D":
                        continue
                    if op == "K":
                        kept, state = role, _KEPT["sua".index(role[0])][state]
                    else:
                        kept, state = _ROLE[state], _NEXT[state]
                    out[0].append(i)
                    out[1].append(kept)
                    out[2].append("" if op == "I" else text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["conv", "role", "text"])

    return both.mapInArrow(turns, f"conv {conv}, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``sha256`` of each conversation's ``role:text`` lines, for turns as ``edited`` deals them; only the running hash is held."""
    conv = turns.schema["conv"].dataType

    def run(batches):
        last, state = None, None
        for batch in batches:
            done = []
            for who, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or who != last:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = who, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["conv", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([state.hexdigest()], pa.string())], ["conv", "sha256"])

    return turns.mapInArrow(run, f"conv {conv.simpleString()}, sha256 string")


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", rows: DataFrame | None = None) -> DataFrame:
    """A row for each conversation: gaps between turns, counts of faults, ``cost`` and ``audit`` of its repair, hash of the repaired turns.

    ``rows`` are its turns as ``damage`` gives them; by default the damaged ones.
    """
    rows = store(in_order(damage(conversations, conv_col) if rows is None else rows), "turns")
    found = store(audits(symbols(rows)), "audits")
    wide = [F.col(c).cast("decimal(20)") for c in ("most", "least")]
    gaps = rows.groupBy("conv").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count_distinct("turn").alias("n"))
    gaps = gaps.select("conv", F.coalesce(wide[0] - wide[1] + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    parts = conversations.select(F.col(f"`{conv_col}`").alias("conv")).distinct()
    for more in (gaps, found.drop("ops"), digests(edited(rows, found)).withColumnRenamed("sha256", "repaired_sha256")):
        parts = parts.unionByName(more, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = parts.groupBy("conv").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                      F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return whole.withColumnRenamed("conv", conv_col)
