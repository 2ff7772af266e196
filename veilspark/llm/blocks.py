"""Texts as byte blocks: cutting Arrow batches, finding words, hashing spans.

Tasks see texts as the UTF-8 bytes of an Arrow column. A block holds whole documents and
about ``BLOCK_BYTES`` bytes, or one longer document. Hashes are 64-bit and depend on the
hashed bytes alone, so equal words have equal hashes in every task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
LONG_SPAN = 1 << 20

#: Most bits that split_by broadcasts, and those of a page, as bitmap_construct_agg makes them.
MAX_MARKS, _PAGE = 1 << 27, 1 << 15
U = np.uint64
_BASE, _MIX, _STEP = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93

#: Byte classes: white space that separates words, and the bytes of letters, digits and non-ASCII characters.
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
NON_ALNUM = ~np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def rows_of(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Columns ``id`` and ``text`` (null text: empty), and with ``carry`` all others as ``row``.

    Operators see these names alone, so columns of the table cannot clash with theirs.
    """
    rows = [F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]
    return docs.select(*rows, *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")] if carry else []))


def carried(docs: DataFrame, text_col: str) -> str:
    """Type of the ``row`` that rows_of carries."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))).schema[0].dataType.simpleString()


def restored(found: DataFrame, docs: DataFrame, text_col: str, text: str, chars_col: str = "n_chars") -> DataFrame:
    """The columns of ``docs`` from carried rows, with ``text`` as the new text and its length where docs has one."""
    new = {text_col: F.col(text), chars_col: F.length(text).cast("long")}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


class Block:
    """Documents of one block: ``ids``, their bytes in ``buf``, where each starts (one more at the end), other columns in ``rest``."""

    def __init__(self, ids: pa.Array, buf: np.ndarray, starts: np.ndarray, rest: list[pa.Array]):
        self.ids, self.buf, self.starts, self.rest = ids, buf, starts, rest

    def __len__(self) -> int:
        return len(self.starts) - 1

    def bytes_of(self, k: int) -> bytes:
        return self.buf[self.starts[k]:self.starts[k + 1]].tobytes()


def cut(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole documents from batches whose first two columns are id and text."""
    for batch in batches:
        ids, text = batch.column(0), pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        if not len(text):
            continue
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            rest = [c.slice(first, last - first) for c in batch.columns[2:]]
            yield Block(ids.slice(first, last - first), data[at[first]:at[last]], at[first:last + 1] - at[first], rest)
            first = last


def spans(buf: np.ndarray, starts: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the maximal runs without a ``gap`` byte; no run crosses a document."""
    inside = ~gap[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[starts] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, U)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(_MIX)
    return h ^ (h >> U(29))


def hash_spans(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """A 64-bit hash of each byte range (ranges ascend); ``fold`` replaces bytes first."""
    out, k, n = np.zeros(len(begin), U), 0, len(begin)
    while k < n:
        a = begin[k]
        m = max(k + 1, int(np.searchsorted(end, a + LONG_SPAN, "right")))
        m = min(m, n)
        if end[k] - a > LONG_SPAN:
            out[k] = int.from_bytes(hashlib.blake2b(fold[buf[a:end[k]]].tobytes(), digest_size=8).digest(), "little")
            k += 1
            continue
        width = int(end[m - 1] - a)
        up, down = _table(width + 1)
        total = np.zeros(width + 1, U)
        np.cumsum((fold[buf[a:a + width]].astype(U) + U(1)) * up[:width], out=total[1:])
        out[k:m] = (total[end[k:m] - a] - total[begin[k:m] - a]) * down[begin[k:m] - a]
        k = m
    return mix(out)


def chain(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(_STEP) + words[j:j + n]
    return mix(out + U(k))


def within(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n-k+1 windows of k items stay inside one document; ``bounds`` are the documents' item ranges."""
    if n < k:
        return np.zeros(0, bool)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return owner[:n - k + 1] == owner[k - 1:]


def shared_dir(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only on a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="veilspark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def split_by(rows: DataFrame, key: Column, wanted: Column, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is one that ``found`` holds as ``wanted``, with about one in sixteen of all others; and the rest.

    Only the first need to meet ``found``, so only their texts are shuffled. The keys are
    broadcast as bitmap pages of 4 KB, up to 16 MB in all. Null keys are keys like others.
    """
    bits = min(MAX_MARKS, max(_PAGE, 1 << (16 * found.count()).bit_length()))
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1)).alias("__slot")
    pages = found.select(slot(wanted)).groupBy(F.expr(f"__slot div {_PAGE}").alias("__page")).agg(F.expr(f"bitmap_construct_agg(__slot % {_PAGE})").alias("__bits"))
    paged = rows.select("*", slot(key)).join(F.broadcast(pages), F.expr(f"__slot div {_PAGE} = __page"), "left")
    byte = f"cast(conv(hex(substring(__bits, cast(__slot % {_PAGE} div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    marked = F.expr(f"coalesce((shiftright({byte}, cast(__slot % 8 AS INT)) & 1) = 1, false)")
    return paged.where(marked).drop("__slot", "__page", "__bits"), paged.where(~marked).drop("__slot", "__page", "__bits")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs no recomputation and plans stay short."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
