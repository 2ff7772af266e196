"""Trie of conversation prefixes, with count-min screening of prefix digests.

Turns are put in order by range partitions and read once; from then on a prefix is its depth
and a digest, sums of turn hashes times powers modulo four 31-bit primes, which can be composed
from parts: a long conversation may lie in several partitions, and a rebuilt one is a prefix of
another and a tail of its own. A count-min sketch of all prefixes, built from sparse partial
counts and at most ``MOST_CELLS`` bytes a row, goes to all tasks. An estimate of one proves that
a prefix has one conversation, so such rows below another proven one are final where they stand.
The others are grouped exactly: members, children and owner (smallest member) of each node.

A conversation owns the nodes from some depth on, since members only get fewer with depth. So a
subtree needs no walk: each member c of a node adds the bytes between the node and c's first own
depth (what its path repeats), and one leaf if c's end is its own and childless. Both are partial
sums. Heavy keys, a bounded number of them, meet their rows by broadcast, all others by shuffles.

Rows without a conversation id are left out; null roles and texts read as empty; turns go in order,
nulls first, ties by role, then text; repeated rows are turns. A table without ids gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import mix, store
from .turns import in_order

#: Moduli and bases of the digest: the largest primes below 2**31 and arbitrary numbers.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_BASES = (1103515245, 1664525, 22695477, 134775813)
_LANES = range(4)
#: Cells of a row of the sketch: at least, at most; twice the prefixes in between.
FEWEST_CELLS, MOST_CELLS, _SLICE = 1 << 16, 1 << 24, 1 << 16
#: Conversations are rebuilt in blocks of BLOCK ids from fewer than SHARED first turns of the first.
BLOCK, SHARED = 5, 9
#: A key is heavy with this part of all rows; and ids of a node are put together in ranges of so many.
HEAVY_PART, ID_RANGE = 4096, 4096

_KEY = ["k0", "k1", "depth"]


def _powers(exponents: np.ndarray, lane: int) -> np.ndarray:
    p, base, out, left = _PRIMES[lane], _BASES[lane], np.ones(len(exponents), np.uint64), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(base) % np.uint64(p), out)
        base, left = base * base % p, left >> np.uint64(1)
    return out


def walked(rows: DataFrame) -> DataFrame:
    """For each ordered turn its place ``i`` in its conversation within its partition ``pid``, and digests and bytes of the turns up to and before it there."""

    def walk(batches):
        last, i, sums, size = None, 0, np.zeros((4, 1), np.uint64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, pos = (batch.column(k).to_numpy() for k in (0, 1))
            texts = [(r.encode(), t.encode()) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            turn = b"".join(hashlib.blake2b(b"%d:%b%b" % (len(r), r, t), digest_size=32).digest() for r, t in texts)
            turn = np.frombuffer(turn, "<u8").reshape(n, 4).T
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # first row of the conversation here; -1: goes on from before
            place = np.where(head < 0, i + np.arange(n) + 1, np.arange(n) - head + 1)
            length = np.cumsum([len(t) for _, t in texts])
            upto = length - np.where(head > 0, length[head - 1], 0) + np.where(head < 0, size, 0)
            columns = {"conv": conv, "pos": pos, "i": place, "b": upto, "pb": upto - np.array([len(t) for _, t in texts])}
            total = np.zeros((4, n), np.uint64)
            for lane in _LANES:
                p = np.uint64(_PRIMES[lane])
                own = turn[lane] % p * _powers(place, lane) % p
                run = np.cumsum(own)
                total[lane] = (run - np.where(head > 0, run[head - 1], np.uint64(0)) + np.where(head < 0, sums[lane], np.uint64(0))) % p
                columns[f"l{lane}"], columns[f"p{lane}"] = total[lane].astype(np.int64), ((total[lane] + p - own) % p).astype(np.int64)
            last, i, sums, size = conv[-1], int(place[-1]), total[:, -1:].copy(), int(upto[-1])
            yield pa.RecordBatch.from_pydict({k: v.astype(np.int64) for k, v in columns.items()})

    names = ["conv", "pos", "i", "b", "pb", *(f"{c}{k}" for k in _LANES for c in "lp")]
    return rows.select("conv", "pos", "role", "text").mapInArrow(walk, ", ".join(f"{n} long" for n in names)).withColumn("pid", F.shiftright("pos", 33))


def _carried(parts: DataFrame) -> DataFrame:
    """Turns with whole places, digests and bytes: what a conversation has in earlier partitions is added. One row a partition goes through the driver."""
    own = F.struct("conv", "i", "b", *(f"l{k}" for k in _LANES))
    edges = parts.groupBy("pid").agg(F.min_by("conv", "pos").alias("first"), F.max_by(own, "pos").alias("last")).orderBy("pid").collect()
    carry, before = [], None
    for edge in edges:
        last = edge["last"].asDict()
        if before and before["conv"] == edge["first"]:
            carry.append((edge["pid"], edge["first"], before["i"], before["b"], *(before[f"l{k}"] for k in _LANES), *(pow(_BASES[k], before["i"], _PRIMES[k]) for k in _LANES)))
            if last["conv"] == before["conv"]:
                joined = {f"l{k}": (before[f"l{k}"] + pow(_BASES[k], before["i"], _PRIMES[k]) * last[f"l{k}"]) % _PRIMES[k] for k in _LANES}
                last |= joined | {"i": before["i"] + last["i"], "b": before["b"] + last["b"]}
        before = last
    names = ["pid", "conv", "ci", "cb", *(f"c{k}" for k in _LANES), *(f"q{k}" for k in _LANES)]
    carry = parts.sparkSession.createDataFrame(carry, ", ".join(f"{n} long" for n in names))
    found = parts.join(F.broadcast(carry), ["pid", "conv"], "left").na.fill({"ci": 0, "cb": 0, **{f"c{k}": 0 for k in _LANES}, **{f"q{k}": 1 for k in _LANES}})
    lanes = [((F.col(f"c{k}") + F.col(f"q{k}") * F.col(f"{c}{k}")) % _PRIMES[k]).alias(f"{c}{k}") for k in _LANES for c in "lp"]
    return found.select("conv", (F.col("i") + F.col("ci")).alias("i"), (F.col("b") + F.col("cb")).alias("b"), (F.col("pb") + F.col("cb")).alias("pb"), *lanes)


def _key(lanes: list[Column], names: tuple[str, str]) -> list[Column]:
    return [(F.shiftleft(lanes[0], 31) + lanes[1]).alias(names[0]), (F.shiftleft(lanes[2], 31) + lanes[3]).alias(names[1])]


def _met(rows: DataFrame, table: DataFrame, on: list[str], weight: str, heavy: int) -> DataFrame:
    """rows joined with table, whose keys are unique; ``weight`` bounds a key's rows, so keys of ``heavy`` rows are few and broadcast."""
    hot, cold = F.broadcast(table.where(F.col(weight) >= heavy)), table.where(F.col(weight) < heavy)
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def prefixes(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv``, ``depth``, keys of the prefix and of its parent, bytes up to and before its last turn, and the conversation's ``length``: one row for each
    prefix of each rebuilt conversation, the empty one included."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *texts)
    turns = _carried(store(walked(in_order(rows)), "walked"))
    lanes = [f"l{k}" for k in _LANES]
    first = F.array_sort(F.collect_list(F.when(F.col("i") < SHARED, F.struct("i", "b", "pb", *lanes, *(f"p{k}" for k in _LANES)))))
    convs = store(turns.groupBy("conv").agg(F.max("i").alias("n"), first.alias("first")), "convs")
    starts = convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).withColumn("base", F.col("conv") - F.col("conv") % BLOCK)
    starts = starts.join(convs.select(F.col("conv").alias("base"), F.col("first").alias("lent")), "base", "left")
    starts = starts.withColumn("e", F.least("h", F.coalesce(F.size("lent"), F.lit(0))).cast("long"))
    at = lambda rows, n, c: F.when(F.col(n) > 0, F.try_element_at(F.col(rows), F.col(n).cast("int"))[c]).otherwise(F.lit(0))
    back = lambda k: reduce(lambda w, s: w.when(F.col("h") - F.col("e") == s, pow(_BASES[k], -s, _PRIMES[k])), range(1, SHARED), F.when(F.col("h") == F.col("e"), 1))
    # lanes of what is lent, of the own turns left out, and the power that moves the own tail to its new place
    starts = starts.select("conv", "h", "e", "n", (F.col("e") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), F.slice(F.coalesce("lent", F.array().cast(starts.schema["lent"].dataType)), F.lit(1), F.col("e").cast("int")).alias("lent"),
                           at("lent", "e", "b").alias("eb"), at("first", "h", "b").alias("hb"), *(at("lent", "e", f"l{k}").alias(f"e{k}") for k in _LANES),
                           *(at("first", "h", f"l{k}").alias(f"h{k}") for k in _LANES), *(back(k).cast("long").alias(f"w{k}") for k in _LANES))
    starts = store(starts, "starts")
    none = [F.lit(0).cast("long").alias(c) for c in ("depth", "k0", "k1", "p0", "p1", "b", "pb")]
    roots = starts.select("conv", *none, "length")
    lent = starts.select("conv", "length", F.explode("lent").alias("x")).select(
        "conv", F.col("x.i").alias("depth"), *_key([F.col(f"x.l{k}") for k in _LANES], ("k0", "k1")), *_key([F.col(f"x.p{k}") for k in _LANES], ("p0", "p1")), F.col("x.b").alias("b"), F.col("x.pb").alias("pb"), "length")
    heavy = max(1000, convs.agg(F.sum("n")).head()[0] // HEAVY_PART) if not convs.isEmpty() else 1000
    tails = _met(turns, starts.where("n > h").drop("lent"), ["conv"], "n", heavy).where("i > h")
    moved = lambda c: [(F.col(f"e{k}") + F.pmod(F.col(f"{c}{k}") - F.col(f"h{k}"), F.lit(_PRIMES[k])) * F.col(f"w{k}")) % _PRIMES[k] for k in _LANES]
    tails = tails.select("conv", (F.col("e") + F.col("i") - F.col("h")).alias("depth"), *_key(moved("l"), ("k0", "k1")), *_key(moved("p"), ("p0", "p1")),
                         *((F.col(c) - F.col("hb") + F.col("eb")).alias(c) for c in ("b", "pb")), "length")
    return roots.unionByName(lent).unionByName(tails)


def _cells(k0: np.ndarray, k1: np.ndarray, depth: np.ndarray, width: int) -> np.ndarray:
    """Cells of prefixes in both rows of the sketch."""
    at = [mix(k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + depth.astype(np.uint64)) & np.uint64(width - 1) for k in (k0, k1)]
    return np.stack([at[0], at[1] + np.uint64(width)]).astype(np.int64)


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Counts of prefixes, up to 255, in two rows of ``width`` cells."""

    def count(batches):
        counts = np.zeros(2 * width, np.uint32)
        for batch in batches:
            k0, k1, depth = (batch.column(k).to_numpy() for k in range(3))
            np.add.at(counts, _cells(k0, k1, depth, width).ravel(), 1)
        counts = np.minimum(counts, 255).astype(np.uint8).reshape(-1, _SLICE)
        for k in np.flatnonzero(counts.any(axis=1)):
            at = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "at": pa.array([at.astype("<u2").tobytes()]), "n": pa.array([counts[k][at].tobytes()])})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE, np.uint8)
        for at, n in zip(table["at"].to_pylist(), table["n"].to_pylist(), strict=True):
            at, n = np.frombuffer(at, "<u2"), np.frombuffer(n, np.uint8)
            total[at] = np.minimum(total[at].astype(np.uint16) + n, 255)
        return pa.table({"slice": table["slice"].slice(0, 1), "cells": pa.array([total.tobytes()])})

    parts = rows.where("depth > 0").select(*_KEY).mapInArrow(count, "slice int, at binary, n binary")
    cells = np.zeros((2 * width // _SLICE, _SLICE), np.uint8)
    for row in parts.groupBy("slice").applyInArrow(add, "slice int, cells binary").toLocalIterator():
        cells[row["slice"]] = np.frombuffer(row["cells"], np.uint8)
    return cells.ravel()


def screened(rows: DataFrame, cells: np.ndarray) -> DataFrame:
    """Add ``single`` and ``parent_single``: the sketch proves that the prefix, or its parent, has one conversation."""
    width, held = len(cells) // 2, rows.sparkSession.sparkContext.broadcast(cells)
    names = rows.columns

    def mark(batches):
        for batch in batches:
            col = {n: batch.column(n).to_numpy() for n in (*_KEY, "p0", "p1")}
            flags = [(held.value[_cells(col[a], col[b], col["depth"] - less, width)].min(axis=0) == 1) & (col["depth"] > less) for a, b, less in (("k0", "k1", 0), ("p0", "p1", 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f) for f in flags)], [*names, "single", "parent_single"])

    return rows.mapInArrow(mark, ", ".join(f"{n} long" for n in names) + ", single boolean, parent_single boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """Hash of the ids that end at each node, put together in ranges of ids so that no group is large."""
    ids = rows.where("depth = length").select(*_KEY, "conv", F.floor(F.col("conv") / ID_RANGE).alias("range"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    ids = ids.groupBy(*_KEY, "range").agg(joined.alias("ids"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "ids"))), lambda x: x["ids"]), ",")
    return ids.groupBy(*_KEY).agg(F.sha2(whole, 256).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row for each node: smallest member, depth, parent's smallest member, members, children, leaves below, bytes saved below, hash of the ids that end here."""
    rows = store(prefixes(conversations, conv_col), "prefixes")
    total = rows.count()
    width = min(MOST_CELLS, max(FEWEST_CELLS, 1 << (2 * total).bit_length()))
    rows, heavy = store(screened(rows, sketch(rows, width)), "screened"), max(1000, total // HEAVY_PART)
    shared = rows.where("NOT single")
    edge = rows.where("single AND NOT parent_single")

    nodes = shared.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("owner"), F.any_value("p0").alias("p0"), F.any_value("p1").alias("p1"))
    nodes = store(nodes, "nodes")
    parents = [F.col("p0").alias("k0"), F.col("p1").alias("k1"), (F.col("depth") - 1).alias("depth")]
    below = nodes.where("depth > 0").select(*parents).unionAll(edge.select(*parents)).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.drop("p0", "p1").join(below, _KEY, "left").na.fill({"n_children": 0})
    held = store(_met(shared.select("conv", *_KEY, "b", "pb", "length"), store(nodes, "nodes"), _KEY, "n_convs", heavy), "held")

    foreign = F.max(F.when(F.col("owner") < F.col("conv"), F.struct("depth", "owner", "b"))).alias("x")
    paths = held.groupBy("conv").agg(foreign, F.max("length").alias("whole"), F.max(F.when(F.col("depth") == F.col("length"), F.col("n_children"))).alias("end"))
    paths = paths.select("conv", "whole", F.coalesce(F.col("x.depth") + 1, F.lit(0)).alias("own"), F.col("x.owner").alias("above"), F.coalesce("x.b", F.lit(0)).alias("own_b"), "end")
    paths = store(paths.withColumn("leaf", ((F.col("own") <= F.col("whole")) & (F.coalesce("end", F.lit(0)) == 0)).cast("long")).drop("end"), "paths")
    repeated = F.when(F.col("own") > F.col("depth"), F.col("own_b") - F.col("pb")).otherwise(0)
    parent = F.when((F.col("conv") == F.col("owner")) & (F.col("depth") > 0), F.when(F.col("depth") > F.col("own"), F.col("conv")).otherwise(F.col("above")))
    sums = _met(held, paths, ["conv"], "whole", heavy).groupBy(*_KEY).agg(
        F.min("owner").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.max("n_children").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(repeated).alias("saved_tokens"))
    none = F.sha2(F.lit(""), 256)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    big = sums.join(_ends(shared), _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).select(*out)

    alone = [F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
             F.when(F.col("depth") < F.col("length"), none).otherwise(F.sha2(F.col("conv").cast("string"), 256)).alias("ends_sha256")]
    tops = edge.join(paths.select("conv", "own", "above"), "conv").select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("own"), F.col("conv")).otherwise(F.col("above")).alias("parent_conv_id"), *alone)
    inner = rows.where("single AND parent_single").select(F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), *alone)
    return big.unionByName(tops).unionByName(inner)
