"""Jaccard join of word n-gram sets with adaptive multi-match prefixes.

A document is the set of its distinct shingles. Sets are ordered alike everywhere: shingles
in no more than ``RARE`` documents first, then by their number of documents. Two sets of
similarity t share at least ceil(t n) shingles, n the larger size, so the first
n - ceil(t n) + m shingles of both have m in common, for every m. Each document picks the m
of least estimated cost: the postings its prefix touches, and the candidates among them that
must be verified, at most postings / m. A pair is a candidate if it shares as many prefix
shingles as the smaller m of the two asks for. Candidates are verified on whole sets.

Equal sets are one class; only classes are joined. Links are needed only as far as they join
components: first each posting list links its members with one of them; then only members
whose components still differ are compared, until nothing is left to compare. These meet at
the first common shingle they share, which stands among the first n - overlap + 1 of both,
and one of them lies outside the list's largest component; the rest of what they share is
counted on their prefixes. No link between components is lost, and a group of thousands of
near copies costs no pairs among all.

Before whole sets travel, a bitmap of each class tells pairs that cannot be similar: every
shingle flips one bit, so two bitmaps differ in no more bits than their sets in shingles. A
bitmap has at least twice as many bits as its set has shingles, else those of two long sets
would differ in half their bits at most, too few to tell.

Shuffles. Shingle counts and prefix postings travel as packed arrays, hashed to many small
parts whose number follows the shuffle partitions. Common shingles are pre-aggregated per
task; their postings are joined with one leader each, row by row. The table of common
shingles is broadcast, at most ``MAX_COMMON`` of the most common ones; it sets order and
cost alone, so what is cut from it does not change the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import LOWER, SPACE, Block, U, chain, cut, hash_spans, id_type, rows_of, spans, store
from .components import components

WORDS, PERCENT = 4, 85
RARE, MAX_COMMON, MAX_MATCHES, FLUSH, WANTED_BITS, PART, MAX_BROADCAST = 32, 1_500_000, 8, 1_500_000, 24, 512, 500_000
BITS = 512

#: A packed posting: 32 bits of the shingle beside those that name its part, the class, 8 * set size + matches - 1.
_POSTING = np.dtype([("token", "<u4"), ("key", "<i8"), ("size", "<u4")])


def document_sets(block: Block, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer than k words are one shingle."""
    begin, end = spans(block.buf, block.starts, SPACE)
    at = np.searchsorted(begin, block.starts).tolist()
    words = hash_spans(block.buf, begin, end, LOWER)
    windows = chain(words, k)
    for a, b in zip(at, at[1:], strict=False):
        yield np.unique(windows[a:b - k + 1]) if b - a >= k else chain(words[a:b], b - a) if b > a else words[:0]


def class_key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def flipped(tokens: np.ndarray) -> np.ndarray:
    """The bitmap of a set, as 64-bit numbers: each shingle flips the bit that its lowest bits name.

    The number of bits is a power of two. The halves of a bitmap, one flipped by the other, are
    the set's bitmap of half as many bits.
    """
    bits = max(BITS, 1 << (2 * len(tokens)).bit_length())
    odd = np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _folded(bits: str, width: str) -> str:
    """A bitmap brought to fewer numbers."""
    parts = f"aggregate(sequence(0, size({bits}) div {width} - 1), array_repeat(0L, {width}), (held, k) -> zip_with(held, slice({bits}, k * {width} + 1, {width}), (p, q) -> p ^ q))"
    return f"CASE WHEN size({bits}) = {width} THEN {bits} ELSE {parts} END"


def parts_of(spark: SparkSession) -> int:
    """How many parts packed arrays are hashed to: a power of two, several for each shuffle partition."""
    return 1 << (8 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


class Join:
    """One join: its rows (id, text), shingle size and threshold in percent."""

    def __init__(self, rows: DataFrame, words: int, percent: int):
        self.rows, self.words, self.percent = rows, words, percent
        self.spark = rows.sparkSession
        self.parts = parts_of(self.spark)

    def members(self, kind: str) -> DataFrame:
        """(id, n, key, bitmap): set size, class and bitmap of every row; empty sets have no class."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in cut(batches):
                sets = list(document_sets(block, words))
                yield pa.RecordBatch.from_arrays([
                    block.ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()),
                    _lists([flipped(s) for s in sets])], ["id", "n", "key", "bits"])

        return self.rows.mapInArrow(run, f"id {kind}, n long, key long, bits array<long>")

    def common(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Leading bits of shingles in more than RARE documents (sorted), their document counts, bits cut off.

        Copies count, too: that may make a shingle look more common than it is among classes,
        which costs time, not results.
        """
        words, bits = self.words, self.parts.bit_length() - 1
        shift = max(0, 40 - bits)  # 24 bits beside those of the part: a few shingles in a hundred meet another's

        def packed(found: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(found) >> U(shift), return_counts=True)
            part = (keys >> U(64 - shift - bits)).astype(np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            ends = [*edges[1:].tolist(), len(keys)]
            short = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3])
            many = np.minimum(counts, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([
                pa.array(part[edges].astype(np.int32)), pa.array([short[a:b].tobytes() for a, b in zip(edges.tolist(), ends, strict=True)], pa.binary()),
                pa.array([_sparse(many[a:b]) for a, b in zip(edges.tolist(), ends, strict=True)], pa.binary())], ["part", "tokens", "counts"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[np.ndarray] = []
            size = 0
            for block in cut(batches):
                for s in document_sets(block, words):
                    found.append(s)
                    size += len(s)
                if size >= FLUSH:
                    yield packed(found)
                    found, size = [], 0
            if size:
                yield packed(found)

        def total(found: pa.Table) -> pa.Table:
            raw = [np.frombuffer(t, np.uint8).reshape(-1, 3).astype(np.uint32) for t in found["tokens"].to_pylist()]
            tokens = np.concatenate([t[:, 0] | t[:, 1] << 8 | t[:, 2] << 16 for t in raw])
            counts = np.concatenate([_dense(c, len(t)) for c, t in zip(found["counts"].to_pylist(), raw, strict=True)])
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            sums = np.add.reduceat(counts[order], first)
            some = sums > RARE
            lead = (np.uint64(found["part"][0].as_py()) << U(24)) | tokens[first][some].astype(U)
            return pa.table({"token": lead.view(np.int64), "docs": sums[some]})

        counted = self.rows.mapInArrow(count, "part int, tokens binary, counts binary").groupBy("part").applyInArrow(total, "token long, docs long")
        counted = store(counted, "common")
        if counted.count() > MAX_COMMON:
            counted = counted.orderBy(F.desc("docs"), "token").limit(MAX_COMMON)
        found = counted.toArrow()
        tokens = found["token"].to_numpy().view(U)
        order = np.argsort(tokens)
        return tokens[order], found["docs"].to_numpy()[order], shift

    def prefixes(self, table) -> DataFrame:
        """(part, data): packed prefix postings of rare shingles, once per class and flush."""
        words, percent, parts = self.words, self.percent, self.parts
        bits = parts.bit_length() - 1

        def packed(found: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
            lengths = [len(f[3]) for f in found]
            tokens = np.concatenate([f[3] for f in found])
            rows = np.empty(len(tokens), _POSTING)
            rows["token"] = (tokens >> U(bits)).astype(np.uint32)
            rows["key"] = np.repeat(np.array([f[0] for f in found], np.int64), lengths)
            rows["size"] = np.repeat(np.array([8 * f[1] + f[2] - 1 for f in found], np.uint32), lengths)
            part = (tokens & U(parts - 1)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            ends = [*edges[1:].tolist(), len(rows)]
            return pa.RecordBatch.from_arrays([
                pa.array(part[edges].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(edges.tolist(), ends, strict=True)], pa.binary())], ["part", "data"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple[int, int, int, np.ndarray]] = {}
            size = 0
            for block in cut(batches):
                for s in document_sets(block, words):
                    if len(s) and (key := class_key(s)) not in found:
                        m, rare, _ = prefix(s, percent, *table.value)
                        found[key] = (key, len(s), m, rare)
                        size += len(rare)
                if size >= FLUSH:
                    yield packed(list(found.values()))
                    found, size = {}, 0
            if size:
                yield packed(list(found.values()))

        return self.rows.mapInArrow(run, "part int, data binary")

    def common_postings(self, table) -> DataFrame:
        """(x, rare, common): every class, as (key, n, m), with the common shingles of its prefix, in order, and how many rare ones come first."""
        words, percent = self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in cut(batches):
                rows = [(class_key(s), len(s), *p) for s in document_sets(block, words) if len(s) and len((p := prefix(s, percent, *table.value))[2])]
                keys, sizes, matches, rare, common = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(matches, pa.int32()), pa.array([len(x) for x in rare], pa.int32()), _lists(common)], ["key", "n", "m", "rare", "common"])

        found = self.rows.mapInArrow(run, "key long, n int, m int, rare int, common array<long>").dropDuplicates(["key"])
        return found.select(F.struct("key", "n", "m").alias("x"), "rare", "common")

    def lists(self, table) -> DataFrame:
        """Posting lists of two classes or more: (members, times), equal lists united."""

        def gather(found: pa.Table) -> pa.Table:
            rows = np.unique(np.frombuffer(b"".join(found["data"].to_pylist()), _POSTING))
            first = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
            ends = np.append(first[1:], len(rows))
            some = ends - first > 1
            out = [rows[a:b] for a, b in zip(first[some].tolist(), ends[some].tolist(), strict=True)]
            return pa.table({c: _lists([r[c].astype(np.int64) for r in out]) for c in ("key", "size")})

        found = self.prefixes(table).groupBy("part").applyInArrow(gather, "key array<long>, size array<long>")
        found = found.groupBy("key").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("times"))
        member = lambda z: F.struct(z["key"].alias("key"), F.shiftright(z["size"], 3).cast("int").alias("n"), (z["size"] % 8 + 1).cast("int").alias("m"))
        return found.select(F.transform(F.arrays_zip("key", "size"), member).alias("members"), "times")

    def _near(self, x: str, y: str) -> Column:
        return F.expr(f"100 * least({x}.n, {y}.n) >= {self.percent} * greatest({x}.n, {y}.n)")

    def _overlap(self, x: str, y: str) -> str:
        """How many shingles sets of the sizes of x and y must share."""
        return f"(({self.percent} * ({x}.n + {y}.n) + {99 + self.percent}) div {100 + self.percent})"

    def likely(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose bitmaps do not rule out that they are similar."""
        pairs = store(pairs, "asked")
        ids = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        held = classes.join(F.broadcast(ids) if 2 * pairs.count() <= MAX_BROADCAST else ids, "key", "left_semi")
        joined = pairs.join(held.alias("x"), F.col("a") == F.col("x.key")).join(held.alias("y"), F.col("b") == F.col("y.key"))
        width = "least(size(x.bits), size(y.bits))"
        differ = f"aggregate(zip_with({_folded('x.bits', width)}, {_folded('y.bits', width)}, (p, q) -> bit_count(p ^ q)), 0, (sum, n) -> sum + n)"
        return joined.where(f"{differ} <= x.n + y.n - 2 * {self._overlap('x', 'y')}").select("a", "b")

    @property
    def _pair(self) -> list[Column]:
        """A pair x, y and how many prefix shingles it must share."""
        return [F.least("x.key", "y.key").alias("low"), F.greatest("x.key", "y.key").alias("high"), F.least("x.m", "y.m").alias("need")]

    def _asked(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) from x, y and times that share as many prefix shingles as they must; a is an x."""
        flat = pairs.select(*self._pair, F.col("x.key").alias("a"), "times")
        counted = flat.groupBy("low", "high", "need").agg(F.sum("times").alias("times"), F.min("a").alias("a")).where("times >= need")
        return counted.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))

    def first_pairs(self, single: DataFrame, common: DataFrame) -> DataFrame:
        """Each list's members with its head, the class with most neighbours.

        A copy's own shingles are rare and come first in its prefix, where they meet nobody;
        the text that was copied meets all its copies. So heads are mostly originals, and
        near copies that do not resemble each other enough are linked through them.
        """
        common = common.select("x", F.explode("common").alias("token"))
        met = single.select("x", "times").union(common.select("x", F.lit(1).cast("long").alias("times")))
        degrees = store(met.groupBy(F.col("x.key").alias("key")).agg(F.sum("times").alias("degree")), "degrees")
        best = F.max_by("x", F.struct("degree", "key")).alias("head")
        joined = single.join(degrees, F.col("x.key") == degrees.key)
        heads = joined.groupBy("list").agg(best)
        stars = single.join(heads, "list").where("x.key <> head.key").select(F.col("head").alias("x"), F.col("x").alias("y"), "times")
        heads = common.join(degrees, F.col("x.key") == degrees.key).groupBy("token").agg(best, F.count(F.lit(1)).alias("size")).where("size > 1")
        more = common.join(heads, "token").where("x.key <> head.key").select(F.col("head").alias("x"), F.col("x").alias("y"), F.lit(1).cast("long").alias("times"))
        return self._asked(stars.unionByName(more).where(self._near("x", "y")))

    def further_pairs(self, single: DataFrame, common: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
        """Members of one list whose components differ, and that were not compared yet."""
        label = F.coalesce("label", F.col("x.key"))
        single = single.join(labels, F.col("x.key") == labels.key, "left").select("list", "times", F.struct("x.*", label.alias("label")).alias("x"))
        mixed = single.groupBy("list", "times").agg(F.collect_list("x").alias("xs"), F.min("x.label").alias("low"), F.max("x.label").alias("high")).where("low <> high")
        pairs = mixed.select("times", "xs", F.explode("xs").alias("x")).select(
            "times", "x", F.explode(F.filter("xs", lambda y: (y["key"] > F.col("x.key")) & (y["label"] != F.col("x.label")))).alias("y"))
        # Of the shingles that two similar sets share, the first stands no later than n - overlap + 1 in either.
        rows = common.join(labels, F.col("x.key") == labels.key, "left").select(F.struct("x.*", label.alias("label")).alias("x"), "rare", F.posexplode("common").alias("at", "token"))
        rows = rows.select("token", F.struct("x.*", (F.col("rare") + F.col("at") + 1).alias("pos")).alias("x")).where(f"x.pos <= x.n - ({self.percent} * x.n + 99) div 100 + 1")
        largest = rows.groupBy("token", "x.label").agg(F.count(F.lit(1)).alias("size")).groupBy("token").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count(F.lit(1)).alias("labels"))
        rows = store(rows.join(largest.where("labels > 1"), "token").select("token", "x", (F.col("x.label") != F.col("largest")).alias("outside")), "early")
        early = F.expr(f"greatest(x.pos - x.n, y.pos - y.n) <= 1 - {self._overlap('x', 'y')}")
        other = (F.col("x.label") != F.col("y.label")) & (~F.col("among") | (F.col("x.key") < F.col("y.key"))) & self._near("x", "y") & early
        every = rows.select("token", F.col("x").alias("y"), F.col("outside").alias("among"))
        seeds = rows.where("outside").select("token", "x").join(every.withColumnRenamed("token", "met"), (F.col("token") == F.col("met")) & other)
        every = pairs.where(self._near("x", "y")).select(*self._pair, "times").unionByName(seeds.select(*self._pair, F.lit(0).cast("long").alias("times")))
        met = every.groupBy("low", "high", "need").agg(F.sum("times").alias("times"))
        none = F.array().cast("array<long>")
        held = common.select("x.key", "common")
        both = met.join(held.select(F.col("key").alias("low"), F.col("common").alias("xs")), "low", "left").join(held.select(F.col("key").alias("high"), F.col("common").alias("ys")), "high", "left")
        asked = both.where(F.col("times") + F.size(F.array_intersect(F.coalesce("xs", none), F.coalesce("ys", none))) >= F.col("need")).select(F.col("low").alias("a"), F.col("high").alias("b"))
        known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return asked.join(known, ["a", "b"], "left_anti")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough.

        A set travels once for each a it is compared with. The pairs of one a are dealt to
        several parts if they are many; in a part the set of a comes first, and the others
        pass by it.
        """
        words, percent = self.words, self.percent
        ids = pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
        wanted = self.spark.sparkContext.broadcast(_bitmap(ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, sent = wanted.value, set()
            for block in cut(batches):
                rows = []
                for s in document_sets(block, words):
                    if len(s) and _holds(bits, key := class_key(s)) and key not in sent:
                        rows.append((key, s.tobytes()))
                        sent.add(key)  # 8 bytes for each class of this task
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["key", "tokens"])

        sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        dealt = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PART).cast("long")))
        seats = dealt.select("a", "part", F.col("b").alias("key"), F.lit(1).alias("role")).union(dealt.select("a", "part", F.col("a").alias("key"), F.lit(0).alias("role")).distinct())
        seats = store(seats, "seats")
        sets = self.rows.mapInArrow(run, "key long, tokens binary")
        rows = sets.join(F.broadcast(seats) if seats.count() <= MAX_BROADCAST else seats, "key")
        rows = rows.select("a", "part", "role", "key", "tokens").repartition("a", "part").sortWithinPartitions("a", "part", "role")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seat, held = None, np.zeros(0, U)
            for batch in batches:
                found = []
                for a, part, role, key, tokens in zip(*(batch.column(k) for k in range(5)), strict=True):
                    a, part = a.as_py(), part.as_py()
                    own = np.frombuffer(tokens.as_buffer(), U)
                    if not role.as_py():
                        seat, held = (a, part), own.copy()
                    elif seat == (a, part):
                        both = len(np.intersect1d(held, own, assume_unique=True))
                        if 100 * both >= percent * (len(held) + len(own) - both):
                            found.append((a, key.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        return rows.mapInArrow(test, "a long, b long").distinct()

    def links(self, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Verified links between classes (key, n, bitmap) that make up all components, and the components' labels."""
        table = self.spark.sparkContext.broadcast(self.common())
        lists = self.lists(table)
        common = store(self.common_postings(table), "postings")
        single = store(lists.select(F.xxhash64("members").alias("list"), "times", F.explode("members").alias("x")), "members")
        tested = store(self.likely(self.first_pairs(single, common), classes), "pairs")
        links = store(self.verified(tested), "verified")
        labels = components(links)
        while True:
            pairs = store(self.likely(self.further_pairs(single, common, labels, tested), classes), "pairs")
            if pairs.isEmpty():
                return links, labels
            fresh = store(self.verified(pairs), "verified")
            if fresh.isEmpty():
                return links, labels
            links, tested = links.union(fresh), tested.union(pairs)
            labels = components(links)


def prefix(tokens: np.ndarray, percent: int, common: np.ndarray, docs: np.ndarray, shift: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(matches asked for, rare, common) prefix shingles of a set."""
    n = len(tokens)
    least = -(-percent * n // 100)
    if len(common):
        lead = tokens >> U(shift)
        k = np.minimum(np.searchsorted(common, lead), len(common) - 1)
        hit = common[k] == lead
    else:
        hit = np.zeros(n, bool)
    if n - int(hit.sum()) >= n - least + 1 or not hit.any():
        return 1, tokens[~hit][:n - least + 1], tokens[:0]
    rare, late, counts = tokens[~hit], tokens[hit], docs[k[hit]]
    order = np.lexsort((late, counts))
    postings = np.concatenate([[0], np.cumsum(counts[order])])
    choices = range(1, min(MAX_MATCHES, least) + 1)
    cost = [postings[n - least + m - len(rare)] * (1 + n / m) for m in choices]
    m = 1 + int(np.argmin(cost))
    return m, rare, late[order][:n - least + m - len(rare)]


def _sparse(counts: np.ndarray) -> bytes:
    """Counts above one, each with its position; nearly all are one."""
    some = np.flatnonzero(counts > 1)
    return some.astype("<u4").tobytes() + counts[some].tobytes()


def _dense(packed: bytes, size: int) -> np.ndarray:
    n = len(packed) // 5
    out = np.ones(size, np.int64)
    out[np.frombuffer(packed, "<u4", n)] = np.frombuffer(packed, np.uint8, n, 4 * n)
    return out


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows).view(np.int64) if len(rows) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each of 2**WANTED_BITS residues of the keys: a fixed 2 MB whatever their number."""
    slot = F.col("key").bitwiseAND(F.lit((1 << WANTED_BITS) - 1))
    rows = ids.select(slot.alias("slot")).groupBy(F.expr("slot div 32768").alias("page")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits")).collect()
    out = np.zeros(1 << WANTED_BITS - 3, np.uint8)
    for r in rows:
        out[r["page"] * 4096:(r["page"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _holds(bits: np.ndarray, key: int) -> bool:
    slot = key & ((1 << WANTED_BITS) - 1)
    return bool(bits[slot >> 3] >> (slot & 7) & 1)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link if their shingle sets have a Jaccard similarity of ``percent`` or
    more. Null and empty texts have no shingles and their own id as component. Rows with
    equal sets are in one component, repeated rows and ids included. A null id counts as no
    id: it is never a component's smallest, unless there is no other.
    """
    kind = id_type(docs, id_col)
    join = Join(rows_of(docs, id_col, text_col), words, percent)
    members = store(join.members(kind), "members")
    classes = members.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("low"), F.min("n").alias("n"), F.first("bits").alias("bits"))
    classes = store(classes, "classes")
    _, labels = join.links(classes.drop("low"))
    labelled = classes.join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("label"), "low")
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    named = labelled.select("key", "label").join(lowest, "label").select("key", "component_id")
    joined = members.join(named, "key", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
