"""Suffix-array dedup: maximal repeats of ``LENGTH`` bytes or more, from common-prefix interval trees.

Suffixes are sorted sparsely. A text's anchors are the positions where the hash of the next
``ANCHOR`` bytes is the smallest in some window of ``LENGTH`` bytes; equal windows have their
anchor at the same place. So every repeat of LENGTH bytes holds an anchor whose next bytes
occur at another anchor too, and suffixes need be compared only among anchors with the same
hash, to the right up to LENGTH bytes and to the left up to LENGTH - ANCHOR.

Anchors whose whole surroundings are equal are one context, counted by partial aggregates:
such surroundings repeat in full, and one representative stands for all in what follows.
A repeat around an anchor reaches at least half of LENGTH - ANCHOR bytes beyond it on one
side, so contexts are grouped by the hash of that much on the right, and again on the left;
a line that stands in many texts with nothing else in common forms no group. The contexts
of a group form an enhanced suffix array: sorted right sides with their common prefix
lengths, scanned with a stack into the tree of common-prefix intervals. For each interval
(a right extension shared by its members, more among its parts) the members are ordered by
their left sides; neighbours there differ in what stands further left, so their common left
extension and the interval's depth bound a maximal repeat, of which all members, not just
neighbours, are given. Groups come to a task one after the other, so it holds one of them.

A group of more than ``MAX_CONTEXTS`` contexts is not gathered. Its windows are taken in
ranges of ``STEPS`` offsets from the anchor: contexts that agree in all that the windows of a
range cover repeat there in full, and are one class from then on; classes that agree in what
the windows of a range have in common form a smaller group, gathered if it is small enough,
or else taken in narrower ranges, down to single windows.

Only anchors are shuffled, about one for 185 bytes, and the surroundings of representatives
that differ; texts meet their ranges once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, U, _table, cut, hash_spans, id_type, mix, rows_of, store

LENGTH, ANCHOR, MAX_CONTEXTS, STEPS = 400, 32, 20_000, (47, 6, 1)

#: Flags for each wanted seat, and the most of them: 64 MB in the driver and each worker.
SEAT_BITS, MAX_BITS = 16, 1 << 29
_CHUNK, _PLACE = 1 << 20, U((1 << 24) - 1)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    rows = np.append(x, np.full(-len(x) % w, np.iinfo(np.uint64).max, U)).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return np.minimum(behind[:m], ahead[w - 1:w - 1 + m])


class Anchors:
    """Anchors of a block: byte positions ``at``, documents ``doc``, hashes, and the ranges of their contexts."""

    def __init__(self, block: Block, keys: np.ndarray, length: int):
        buf, starts, k = block.buf, block.starts, ANCHOR
        found = [np.zeros(0, np.int64)]
        sizes = np.diff(starts)
        long_enough = np.flatnonzero(sizes >= length)
        edge = np.zeros(len(buf) + 1, np.int64)
        np.add.at(edge, starts[long_enough], 1)
        np.subtract.at(edge, starts[long_enough + 1] - length + 1, 1)
        whole = np.cumsum(edge)[:-1] > 0  # where a window starts
        for a in range(0, max(0, len(buf) - length + 1), _CHUNK):
            b = min(len(buf), a + _CHUNK + length - 1)
            if whole[a:a + _CHUNK].any():
                up, down = _table(b - a + 1)
                total = np.zeros(b - a + 1, U)
                np.cumsum((buf[a:b].astype(U) + U(1)) * up[:b - a], out=total[1:])
                h = mix((total[k:] - total[:-k]) * down[:b - a - k + 1])
                low = _least((h & ~_PLACE) | np.arange(len(h), dtype=U), length - k + 1)
                found.append(a + np.unique(low[whole[a:a + len(low)]] & _PLACE).astype(np.int64))
        self.at = np.unique(np.concatenate(found))
        self.doc = np.searchsorted(starts, self.at, "right") - 1
        self.begin = np.maximum(starts[self.doc], self.at - (length - k))
        self.end = np.minimum(starts[self.doc + 1], self.at + length)
        self.pos = self.at - starts[self.doc]
        self.hash = hash_spans(buf, self.at, self.at + k)
        # Both sides in equal shares of what a repeat has beside its anchor; 0: the text ends before.
        half = (length - k + 1) // 2
        self.right, self.left = np.zeros(len(self.at), U), np.zeros(len(self.at), U)
        some = np.flatnonzero(self.end - self.at >= k + half)
        self.right[some] = mix(hash_spans(buf, self.at[some], self.at[some] + k + half) + U(1))
        some = np.flatnonzero(self.at - self.begin >= half)
        self.left[some] = mix(hash_spans(buf, self.at[some] - half, self.at[some] + k) + U(2))
        sides = (self.at - self.begin).astype(U) * U(1 << 20) + (self.end - self.at).astype(U)
        self.context = mix(hash_spans(buf, self.begin, self.end) ^ mix(sides))
        self.occurrence = keys[self.doc].view(U) ^ self.pos.astype(U)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray]]:
    for block in cut(batches):
        yield block, block.ids.to_numpy(zero_copy_only=False).astype(np.int64)


def _wanted(chosen: DataFrame) -> np.ndarray:
    """Flags, packed, of the residues of the chosen occurrences in groups; a power of two of them, by the number of rows."""
    bits = min(MAX_BITS, max(1 << 15, 1 << (SEAT_BITS * chosen.count() - 1).bit_length()))
    slot = F.col("occurrence").bitwiseXOR(F.col("group")).bitwiseAND(F.lit(bits - 1)).alias("slot")
    rows = chosen.select(slot).groupBy(F.expr("slot div 32768").alias("page")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("flags"))
    out = np.zeros(bits >> 3, np.uint8)
    for r in rows.collect():
        out[r["page"] * 4096:(r["page"] + 1) * 4096] = np.frombuffer(bytes(r["flags"]), np.uint8)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in the order of their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            groups = batch.column(0).to_numpy()
            last = int(np.searchsorted(groups, groups[-1]))
            if last or (held and held[-1].column(0)[0].as_py() != groups[0]):
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _common(rows: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common prefix lengths of rows i and j."""
    differ = rows[i] != rows[j]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[i], sizes[j]))


def _matrix(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    width = max(1, int(sizes.max(initial=0)))
    return np.frombuffer(b"".join(t.ljust(width, b"\xff") for t in texts), np.uint8).reshape(len(texts), width), sizes


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of a sorted list, from the lengths shared with the one before."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(prefixes) + 1):
        now, first = (prefixes[k] if k < len(prefixes) else -1), k - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, k - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeats_around(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Groups of repeats around one anchor: members, bytes to the left of each, and bytes to the right.

    ``left`` sides are reversed. Of a member's repeats those inside another are left out.
    """
    n = len(right)
    order = sorted(range(n), key=right.__getitem__)
    after, after_size = _matrix(right)
    before, before_size = _matrix(left)
    place = np.array(order)
    shared = [0, *_common(after, after_size, place[:-1], place[1:]).tolist()]
    by_left = np.empty(n, np.int64)
    by_left[sorted(range(n), key=left.__getitem__)] = np.arange(n)
    best = np.full(n, -1)
    for depth, first, last in sorted(intervals(shared), key=lambda x: -x[0]):
        members = place[first:last + 1]
        members = members[np.argsort(by_left[members])]
        near = _common(before, before_size, members[:-1], members[1:])
        reach = np.maximum(np.append(near, -1), np.insert(near, 0, -1))
        new = (reach + depth >= length) & (reach > best[members])
        best[members[new]] = reach[new]
        if new.any():
            yield members[new], reach[new], depth


def maximal_repeats(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(member, bytes to the left, bytes to the right, group) of the same repeats."""
    for group, (members, reach, depth) in enumerate(repeats_around(left, right, length)):
        yield from ((i, r, depth, group) for i, r in zip(members.tolist(), reach.tolist(), strict=True))


class Repeats:
    """Repeats of one table: its rows (key, text) and the least length."""

    def __init__(self, rows: DataFrame, length: int):
        self.rows, self.length, self.spark = rows, length, rows.sparkSession

    def anchors(self) -> DataFrame:
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, keys in _blocks(batches):
                a = Anchors(block, keys, length)
                signed = (pa.array(x.view(np.int64)) for x in (a.hash, a.context, a.right, a.left))
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[a.doc]), pa.array(a.pos), *signed, pa.array((a.at - a.begin).astype(np.int32)), pa.array((a.end - a.at).astype(np.int32))],
                    ["key", "pos", "anchor", "context", "right", "left", "l", "r"])

        return self.rows.mapInArrow(run, "key long, pos long, anchor long, context long, right long, left long, l int, r int")

    def surroundings(self, chosen: DataFrame) -> DataFrame:
        """(group, anchor, context, before reversed, after) of the chosen occurrences; a few others may come along."""
        length, shared = self.length, self.spark.sparkContext.broadcast(_wanted(chosen))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, keys in _blocks(batches):
                a = Anchors(block, keys, length)
                raw = block.buf.tobytes()
                for group in (a.right, a.left):
                    slot = ((a.occurrence ^ group) & U(8 * len(shared.value) - 1)).astype(np.int64)
                    flags = (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
                    some = np.flatnonzero((flags > 0) & (group > 0))
                    before = [raw[b:e][::-1] for b, e in zip(a.begin[some].tolist(), a.at[some].tolist(), strict=True)]
                    after = [raw[b:e] for b, e in zip(a.at[some].tolist(), a.end[some].tolist(), strict=True)]
                    signed = (pa.array(x[some].view(np.int64)) for x in (group, a.hash, a.context))
                    yield pa.RecordBatch.from_arrays([*signed, pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["group", "anchor", "context", "before", "after"])

        return self.rows.mapInArrow(run, "group long, anchor long, context long, before binary, after binary")

    def in_groups(self, rows: DataFrame) -> DataFrame:
        """(anchor, context, l, r): how far repeats reach around it, among different contexts of one group; ``rows`` as surroundings gives them."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches):
                groups, anchor, context = (table.column(k).to_numpy() for k in range(3))
                sides = [table.column(k).combine_chunks() for k in (3, 4)]
                new = np.append(True, groups[1:] != groups[:-1])  # of rows that come twice the first counts
                single = np.flatnonzero(new | np.append(True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])))
                first = np.append(np.flatnonzero(new[single]), len(single))
                reach = np.zeros((len(table), 2), np.int32)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if b - a > 1:
                        at = single[a:b]
                        before, after = (x.take(pa.array(at)).to_pylist() for x in sides)
                        for i, l, r in repeats_around(before, after, length):
                            reach[at[i], 0] = np.maximum(reach[at[i], 0], l)
                            reach[at[i], 1] = np.maximum(reach[at[i], 1], r)
                found = reach[:, 1] > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (anchor, context, reach[:, 0], reach[:, 1])], ["anchor", "context", "l", "r"])

        rows = rows.select("group", "anchor", "context", "before", "after").repartition("group").sortWithinPartitions("group", "anchor", "context")
        return rows.mapInArrow(run, "anchor long, context long, l int, r int")

    def seats(self, rows: DataFrame, step: int) -> DataFrame:
        """(seat, class, whole, anchor, context, first, last) of ranges of at most ``step`` offsets within each row's first and last.

        A seat is a range with the bytes that all its windows have in common; a class also has all that
        they cover together (``whole``), or is the context itself where that ends before.
        """
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before, after = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                buf = np.frombuffer(b"".join(b[::-1] + a for b, a in zip(before, after, strict=True)), np.uint8)
                left, right = (np.array([len(x) for x in xs], np.int64) for xs in (before, after))
                at = np.cumsum(left + right) - right  # of the anchors
                low, high = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                count = (high - low) // step + 1
                of = np.repeat(np.arange(len(batch)), count)
                first = low[of] + step * (np.cumsum(count)[of] - 1 - np.arange(len(of)))  # the last range first: spans must ascend
                last = np.minimum(first + step - 1, high[of])
                some = (left[of] >= first) & (right[of] >= length - last)
                of, first, last = of[some], first[some], last[some]
                range_ = mix((first << 20 | last).astype(U))
                context = batch.column(1).to_numpy()[of]
                seat = mix(hash_spans(buf, at[of] - first, at[of] + length - last) ^ range_)
                whole = (left[of] >= last) & (right[of] >= length - first)
                kind = mix(context.view(U) ^ range_)
                kind[whole] = mix(hash_spans(buf, (at[of] - last)[whole], (at[of] + length - first)[whole]) + range_[whole])
                yield pa.RecordBatch.from_arrays([
                    pa.array(seat.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(whole), pa.array(batch.column(0).to_numpy()[of]), pa.array(context),
                    pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["seat", "class", "whole", "anchor", "context", "first", "last"])

        rows = rows.select("anchor", "context", "first", "last", "before", "after")
        return rows.mapInArrow(run, "seat long, class long, whole boolean, anchor long, context long, first int, last int")

    def in_ranges(self, chosen: DataFrame) -> DataFrame:
        """The same as in_groups for groups of very many contexts."""
        half, every = (self.length - ANCHOR + 1) // 2, self.length - ANCHOR
        sides = chosen.groupBy("group").agg(F.first("side").alias("side"))
        rows = store(self.surroundings(chosen).join(F.broadcast(sides), "group").dropDuplicates(["group", "anchor", "context"]), "hot")
        texts = rows.dropDuplicates(["anchor", "context"]).select("anchor", "context", "before", "after")
        # Windows that begin up to half of the rest before the anchor lie in the group by the right side, the others in that by the left.
        first, last = F.when(F.col("side") == 0, 0).otherwise(half), F.when(F.col("side") == 0, every - half).otherwise(every)
        rows = rows.select("*", first.cast("int").alias("first"), last.cast("int").alias("last"))
        found: list[DataFrame] = []
        for step in STEPS:
            seats = store(self.seats(rows, step), "seats")
            classes = store(seats.groupBy("seat", "class", "whole", "first", "last").agg(
                F.count(F.lit(1)).alias("n"), F.min("anchor").alias("anchor"), F.min("context").alias("context")), "classes")
            equal = seats.join(classes.where("whole AND n > 1").select("seat", "class"), ["seat", "class"], "left_semi")
            found.append(equal.select("anchor", "context", F.col("last").alias("l"), (F.lit(self.length) - F.col("first")).alias("r")))
            groups = classes.groupBy("seat").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
            rest = store(classes.join(groups, "seat").select(F.col("seat").alias("group"), "anchor", "context", "first", "last", "classes"), "classes")
            few = rest.where(F.col("classes") <= MAX_CONTEXTS)
            if not few.isEmpty():
                found.append(self.in_groups(few.join(texts, ["anchor", "context"])))
            rest = rest.where(F.col("classes") > MAX_CONTEXTS)
            if rest.isEmpty():
                break
            rows = rest.select("anchor", "context", "first", "last").distinct().join(texts, ["anchor", "context"])
        return reduce(DataFrame.union, found)

    def ranges(self) -> DataFrame:
        """(key, ranges): the bytes of each document inside repeats, as begin and end, unordered and overlapping.

        All that is known of a context holds its anchor, so its ranges are one: from the
        farthest to the left to the farthest to the right.
        """
        anchors = store(self.anchors(), "anchors")
        occurrence = F.min(F.col("key").bitwiseXOR(F.col("pos"))).alias("occurrence")
        contexts = store(anchors.groupBy("anchor", "context", "right", "left").agg(F.count(F.lit(1)).alias("n"), occurrence), "contexts")
        seats = contexts.select(F.posexplode(F.array("right", "left")).alias("side", "group"), "occurrence").where("group <> 0")
        groups = seats.groupBy("group").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
        differing = store(seats.join(groups, "group"), "differing")
        few = self.in_groups(self.surroundings(differing.where(F.col("contexts") <= MAX_CONTEXTS)))
        large = differing.where(F.col("contexts") > MAX_CONTEXTS)
        whole = contexts.where("n > 1").select("anchor", "context", F.lit(self.length).alias("l"), F.lit(self.length).alias("r"))
        every = whole.union(few) if large.isEmpty() else whole.union(few).union(self.in_ranges(large))
        # Stored by context: a plain scan on both sides lets Spark deal out a context that very many texts hold.
        covers = store(every.groupBy("anchor", "context").agg(F.max("l").alias("to_left"), F.max("r").alias("to_right")), "covers")
        held = anchors.select("key", "pos", "anchor", "context", "l", "r").join(covers, ["anchor", "context"])
        begin, end = F.col("pos") - F.least("l", "to_left"), F.col("pos") + F.least("r", "to_right")
        return held.select("key", F.struct(begin.alias("begin"), end.alias("end")).alias("range")).groupBy("key").agg(F.collect_set("range").alias("ranges"))


def merge(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
    return list(zip(begin[new].tolist(), reach[last].tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` and ``kept`` (binary).

    Bytes inside a string of ``length`` bytes that starts anywhere else too are removed; all
    its occurrences go. ``spans`` are the maximal removed runs of UTF-8 bytes, half open.
    What is kept may cut a character, hence the binary type. With ``digest``,
    ``kept_sha256`` stands in place of both. Null and empty texts have no bytes; texts
    shorter than ``length`` are never touched. Repeated rows repeat each other.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    rows = rows_of(docs, id_col, text_col).withColumn("key", F.xxhash64(F.col("id").cast("string"), "text"))
    found = Repeats(rows.select("key", "text"), length).ranges()
    joined = rows.join(found, "key", "left").select("id", "text", F.col("ranges.begin").alias("begins"), F.col("ranges.end").alias("ends"))
    schema = f"`{id_col}` {id_type(docs, id_col)}, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "spans array<struct<begin:long,end:long>>, kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["n_bytes", "n_removed", "n_spans"]
            out: list[tuple] = []
            for text, begins, ends in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                raw = memoryview(text.as_buffer())
                runs = merge(begins.values.to_numpy(), ends.values.to_numpy()) if begins.is_valid else []
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest() if digest else kept, runs))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [batch.column(0), *(pa.array(columns[k], pa.int64()) for k in range(3))]
            if digest:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns[3], pa.string())], [id_col, *names, "kept_sha256"])
            else:
                pairs = pa.array([[{"begin": a, "end": b} for a, b in runs] for runs in columns[4]], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*arrays, pairs, pa.array(columns[3], pa.binary())], [id_col, *names, "spans", "kept"])

    return joined.mapInArrow(run, schema)
