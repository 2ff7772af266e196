"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton reads normalised words of a document and keeps the length of the longest
suffix read so far that occurs in some item. Where that length reaches an item's window
(``window`` consecutive words; a shorter item is one window), those words are hit. A state
knows which items have a window that ends in it. Between two words that never follow one
another in any item the length is at most 1, so only stretches whose neighbouring words do
follow each other in an item are fed to the automaton; numpy finds these stretches.

Items travel to the tasks in blocks of at most ``ITEM_BYTES`` bytes of text. Documents are
read once for each block, without a shuffle; with several blocks the rows are stored with a
key of their own first, and a grouping by that key unites their hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, NON_ALNUM, Block, carried, cut, hash_spans, id_type, mix, rows_of, spans, store

WINDOW = 10
ITEM_BYTES = 1 << 20


class Automaton:
    """Suffix automaton of several word sequences; ``items`` are (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        sequences: list[list[int]] = []
        pairs = [np.zeros(0, np.uint64)]
        for block in cut(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in items], pa.string()), texts], ["id", "text"])])):
            begin, end, at = block_words(block)
            words = hash_spans(block.buf, begin, end, LOWER)
            for k in range(len(block)):
                own = words[at[k]:at[k + 1]]
                sequences.append(own.tolist())
                pairs.append(pair_keys(own))
        self.pairs = np.unique(np.concatenate(pairs))
        self.singles = np.unique(np.array([s[0] for s in sequences if len(s) == 1], np.uint64))
        for s in sequences:
            self._add(s)
        self.ends: dict[int, list[tuple[int, list[str]]]] = {}  # state: (window length, items whose window ends here)
        for (item, _), s in zip(items, sequences, strict=True):
            self._mark(item, s)

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(edges)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of state q for strings no longer than those of p with the word."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                continue
            last = self._state(self.length[p] + 1, {}, 0)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)

    def _step(self, state: int, size: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, size + 1)

    def _holder(self, state: int, size: int) -> int:
        """The state of the suffix of that size."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _mark(self, item: str, sequence: list[int]) -> None:
        size, state, matched = min(self.window, len(sequence)), 0, 0
        for k, word in enumerate(sequence):
            state, matched = self._step(state, matched, word)
            if size and k + 1 >= size:
                rows = self.ends.setdefault(self._holder(state, size), [])
                row = next((r for r in rows if r[0] == size), None)
                if row is None:
                    rows.append((size, [item]))
                elif row[1][-1] != item:
                    row[1].append(item)

    def hits(self, words: list[int]) -> Iterator[tuple[int, int, list[str]]]:
        """(end, window length, items) of every window that occurs."""
        state = size = 0
        for k, word in enumerate(words):
            state, size = self._step(state, size, word)
            at = state
            while at > 0:
                for length, items in self.ends.get(at, ()):
                    if length <= size:
                        yield k + 1, length, items
                at = self.link[at]


def block_words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of a block's words, and each document's range of words."""
    begin, end = spans(block.buf, block.starts, NON_ALNUM)
    return begin, end, np.searchsorted(begin, block.starts)


def pair_keys(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(3) + words[1:])


_built: dict[str, Automaton] = {}


def automaton(items: list[tuple[str, str]], window: int) -> Automaton:
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, window)
    return _built[key]


def _known(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    k = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[k] == keys


def scan(auto: Automaton, block: Block) -> list[tuple[int, int, list[tuple[int, int]], list[str]]]:
    """(number of words, hit words, their merged ranges, items) of each document."""
    begin, end, at = block_words(block)
    words = hash_spans(block.buf, begin, end, LOWER)
    follows = _known(pair_keys(words), auto.pairs) if len(words) > 1 else np.zeros(0, bool)
    inner = at[(at > 0) & (at < len(words))]
    follows[inner - 1] = False
    feed = np.zeros(len(words), bool)
    feed[1:] |= follows
    feed[:-1] |= follows
    feed |= _known(words, auto.singles)
    new = np.flatnonzero(feed & ~np.concatenate([[False], follows]))  # first words of the stretches
    stop = np.searchsorted(np.flatnonzero(feed), new)
    fed = np.flatnonzero(feed)
    stops = np.append(fed[stop[1:] - 1] + 1, fed[-1] + 1) if len(new) else new
    out: list[tuple[int, int, list[tuple[int, int]], list[str]]] = []
    owner = np.searchsorted(at, new, "right") - 1
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for a, b, doc in zip(new.tolist(), stops.tolist(), owner.tolist(), strict=True):
        for stopped, length, items in auto.hits(words[a:b].tolist()):
            ranges, names = found.setdefault(doc, ([], set()))
            ranges.append((a + stopped - length - int(at[doc]), a + stopped - int(at[doc])))
            names.update(items)
    for doc in range(len(block)):
        ranges, names = found.get(doc, ([], set()))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out.append((int(at[doc + 1] - at[doc]), sum(b - a for a, b in merged), merged, sorted(names)))
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, item_bytes: int) -> list[list[tuple[str, str]]]:
    """The test items in blocks of bounded size; their number is chosen from the measured bytes."""
    rows = rows_of(benchmark, item_col, text_col).where("id IS NOT NULL").select(F.col("id").cast("string"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = 1 if total <= item_bytes else 2 + int(2 * total // item_bytes)
    blocks = (rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).orderBy("id", "text").collect() for k in range(n))
    return [[(r[0], r[1]) for r in block] for block in blocks]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, item_bytes: int = ITEM_BYTES, with_text: bool = False, carry: bool = False) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` words, ``n_items``, ``items`` (sorted as strings), ``hits``.

    ``hits`` are the maximal ranges of hit words, half open. With ``with_text`` the column
    ``clean_text`` holds the text without the bytes from the first to the last word of each
    range. Null and empty texts have no words and no hits; items without words or without an
    id are no items. Repeated documents give repeated results, one row for each input row.
    ``carry`` adds the table's other columns as ``row``.
    """
    spark, kind = docs.sparkSession, id_type(docs, id_col)
    blocks = item_blocks(benchmark, item_col, item_text_col, item_bytes)
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items array<string>, hits array<struct<first:long,last:long>>"
    if len(blocks) == 1:
        return _one_pass(docs, spark.sparkContext.broadcast(blocks[0]), window, id_col, text_col, schema, with_text, carry)
    # Numbers of rows are only the same in every pass if they are stored.
    rows = store(rows_of(docs, id_col, text_col, carry).withColumn("key", F.monotonically_increasing_id()), "numbered")
    keyed = "`key` long, n_words long, n_hit long, n_items long, items array<string>, hits array<struct<first:long,last:long>>"
    parts = [_one_pass(rows.select("key", "text"), spark.sparkContext.broadcast(b), window, "key", "text", keyed, False, False) for b in blocks]
    every = parts[0].select("key", "n_words", "items", "hits")
    for p in parts[1:]:
        every = every.unionByName(p.where("n_hit > 0").select("key", "n_words", "items", "hits"))
    merged = F.expr("""aggregate(array_sort(flatten(collect_list(hits))), array(named_struct('first', -1L, 'last', -1L)),
        (acc, h) -> IF(h.first <= element_at(acc, -1).last,
            concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(h.last, element_at(acc, -1).last)))),
            concat(acc, array(named_struct('first', h.first, 'last', h.last)))), acc -> slice(acc, 2, size(acc)))""")
    united = every.groupBy("key").agg(
        F.max("n_words").alias("n_words"), merged.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.expr("aggregate(hits, 0L, (n, h) -> n + h.last - h.first)")
    united = united.select("key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits")
    found = rows.drop(*([] if with_text else ["text"])).join(united, "key")
    return _without(found, id_col, kind, carried(docs, text_col) if carry else "", with_text)


def _one_pass(docs: DataFrame, items, window: int, id_col: str, text_col: str, schema: str, with_text: bool, carry: bool) -> DataFrame:
    names = [id_col, "n_words", "n_hit", "n_items", "items", "hits"]
    pair = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(items.value, window)
        for block in cut(batches):
            rows = scan(auto, block)
            columns = [
                block.ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.string())),
                pa.array([[{"first": a, "last": b} for a, b in r[2]] for r in rows], pa.list_(pair))]
            if with_text:
                columns.append(pa.array([remove_words(block.bytes_of(k), r[2]) for k, r in enumerate(rows)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns + block.rest, names + ["clean_text"] * with_text + ["row"] * carry)

    schema += ", clean_text string" * with_text + (f", row {carried(docs, text_col)}" if carry else "")
    return rows_of(docs, id_col, text_col, carry).mapInArrow(run, schema)


def remove_words(text: bytes, hits: list[tuple[int, int]]) -> str:
    """The text without the words of these ranges and what stands between them."""
    if not hits:
        return text.decode("utf-8", "replace")
    buf = np.frombuffer(text, np.uint8)
    begin, end = spans(buf, np.array([0, len(buf)]), NON_ALNUM)
    kept, at = [], 0
    for a, b in hits:
        kept.append(text[at:begin[a]])
        at = end[b - 1]
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


def _without(found: DataFrame, id_col: str, kind: str, row: str, with_text: bool) -> DataFrame:
    """The numbered rows with their hits as ``contamination`` returns them."""
    names = ["n_words", "n_hit", "n_items", "items", "hits"]
    if not with_text:
        return found.select(F.col("id").alias(id_col), *names, *(["row"] if row else []))
    rows = found.select("id", "text", *names, *(["row"] if row else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(b.schema.get_field_index("hits")).to_pylist()
            texts = [remove_words(t.encode(), [(h["first"], h["last"]) for h in hs]) for t, hs in zip(b.column(1).to_pylist(), hits, strict=True)]
            columns = [b.column(0), *b.columns[2:7], pa.array(texts, pa.string()), *b.columns[7:]]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *names, "clean_text"] + ["row"] * bool(row))

    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items array<string>, hits array<struct<first:long,last:long>>, clean_text string"
    return rows.mapInArrow(run, schema + (f", row {row}" if row else ""))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a hash of the items' ids, for comparison."""
    return found.select(id_col, "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
