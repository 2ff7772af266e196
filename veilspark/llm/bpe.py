"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token is a row of symbols. The leaves of its segment tree hold, for each symbol, the
rank of the pair it forms with the next living symbol and its position, in one integer; an
inner node holds the smaller child. The root is thus the leftmost pair of lowest rank. A
merge kills one leaf and changes at most two others, each by one walk to the root. Trees of
one size are kept in one numpy array, so a step merges once in every tree of the batch.

Encoding is a narrow map: no shuffle. Each Python worker keeps a bounded table of the
pre-tokens it has met. Long pre-tokens go through the same trees, in smaller batches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .blocks import Block, cut, id_type, rows_of

#: Fixed values of byte-level BPE: how text is cut, and which character stands for which byte.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: The same cut for texts of Latin letters and plain digits alone; other texts hold a character of BEYOND.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SPLIT_LATIN = rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^{WHITE}{LATIN}0-9]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
BEYOND = "[\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]"

#: Pre-tokens kept per worker, leaves of one batch of trees.
KNOWN, LEAVES = 600_000, 1 << 19
NONE = np.int64(1) << np.int64(62)


def byte_characters() -> dict[int, str]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks, ids and added tokens of a byte-level BPE file."""

    def __init__(self, text: str):
        model = json.loads(text)
        chars = byte_characters()
        to_byte = {c: b for b, c in chars.items()}
        vocab = model["model"]["vocab"]
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.size = 1 + max(max(vocab.values()), max((t["id"] for t in model["added_tokens"]), default=0))
        keys, merged = [], []
        for pair in model["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] * self.size + vocab[b])
            merged.append(vocab[a + b])
        keys, order = np.unique(np.array(keys, np.int64), return_index=True)
        self.keys, self.ranks, self.merged = np.append(keys, NONE), order, np.array(merged, np.int64)[order]
        self.by_rank = np.array(merged, np.int64)
        self.bytes: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.split, self.split_latin, self.beyond = regex.compile(SPLIT), re.compile(SPLIT_LATIN), re.compile(BEYOND)
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        first, second = np.divmod(np.arange(1 << 16), 256)
        self.byte_ranks = self.rank(self.byte_ids[first], self.byte_ids[second])
        self.pieces = [self.bytes.get(i, b"") for i in range(self.size)]
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE if they do not merge (a symbol below 0 is none)."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        k = np.searchsorted(self.keys, key)
        return np.where(self.keys[k] == key, np.append(self.ranks, 0)[k], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed as little-endian 32-bit integers."""
        out, sizes = [b""] * len(words), np.array([len(w) for w in words])
        widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for width in np.unique(widths).tolist():
            members = np.flatnonzero(widths == width)
            step = max(1, LEAVES // width)
            for a in range(0, len(members), step):
                part = members[a:a + step]
                for k, ids in zip(part.tolist(), self._trees([words[k] for k in part.tolist()], sizes[part], width), strict=True):
                    out[k] = ids
        return out

    def _trees(self, words: list[bytes], length: np.ndarray, width: int) -> list[bytes]:
        n, place = len(words), np.arange(width)
        inside = place < length[:, None]
        raw = np.zeros((n, width), np.int64)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        symbol = np.where(inside, self.byte_ids[raw], -1).ravel()
        after = np.where(place + 1 < length[:, None], place + 1, width).ravel()  # next living symbol; width: none
        before = np.tile(place - 1, n)
        grid = np.full((n, 2 * width), NONE, np.int64)
        ranks = np.where(inside[:, 1:], self.byte_ranks[raw[:, :-1] * 256 + raw[:, 1:]], NONE)
        grid[:, width:2 * width - 1] = np.where(ranks < NONE, ranks * width + place[:-1], NONE)
        level = width
        while level > 1:
            grid[:, level // 2:level] = np.minimum(grid[:, level:2 * level:2], grid[:, level + 1:2 * level:2])
            level //= 2
        tree = grid.ravel()
        live = np.flatnonzero(grid[:, 1] < NONE)
        while len(live):
            row, top = live * width, live * (2 * width)
            rank, at = np.divmod(tree.take(top + 1), width)
            gone = after.take(row + at)
            here, follows, prior = self.by_rank.take(rank), after.take(row + gone), before.take(row + at)
            symbol[row + at] = here
            symbol[row + gone] = -1
            after[row + at] = follows
            more, less = follows < width, prior >= 0
            before[(row + follows)[more]] = at[more]
            right = np.where(more, symbol.take(np.where(more, row + follows, 0)), -1)
            left = np.where(less, symbol.take(np.where(less, row + prior, 0)), -1)
            fresh = self.rank(np.concatenate([here, left]), np.concatenate([right, here]))
            place_of = np.concatenate([at, prior])
            fresh = np.where(fresh < NONE, fresh * width + place_of, NONE)
            tree[top + width + gone] = NONE
            tree[top + width + at] = fresh[:len(live)]
            tree[(top + width + prior)[less]] = fresh[len(live):][less]
            nodes, step = np.concatenate([width + gone, width + at, width + np.where(less, prior, at)]), width
            tops = np.concatenate([top, top, top])
            while step > 1:
                nodes = nodes >> 1
                child = tops + 2 * nodes
                tree[tops + nodes] = np.minimum(tree.take(child), tree.take(child + 1))
                step //= 2
            live = live[tree.take(top + 1) < NONE]
        alive = symbol >= 0
        packed = symbol[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.reshape(n, width).sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def cut(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond.search(text):
            return self.split_latin.findall(text)
        return self.split.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts; added tokens in a text become their own ids."""
        tokens = []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            tokens.append(self.cut(text) if len(parts) == 1 else [w for p in parts for w in ([p] if p in self.added else self.cut(p))])
        new = set().union(*tokens).difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.known = {}
            new = set().union(*tokens)
        if new:
            words = list(new)
            self.known.update(zip(words, self.merge([w.encode() for w in words]), strict=True))
            self.known.update((t, int(i).to_bytes(4, "little")) for t, i in self.added.items())
        look = self.known.__getitem__
        return [b"".join(map(look, ws)) for ws in tokens]

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError("an id is outside the vocabulary")
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def encode(docs: DataFrame, vocabulary_text: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, with_decoded: bool = False) -> DataFrame:
    """One row per document: its id, ``n_tokens`` and ``ids`` (array of int), or with ``digest`` hashes instead of ids.

    ``vocabulary_text`` is the content of a byte-level BPE file, a few MB whatever the corpus.
    Null and empty texts have no ids. Repeated rows give repeated results. With ``digest``:
    ``ids_sha256`` of the ids as little-endian 32-bit integers, ``decoded_sha256`` of the text
    they decode to; ``with_decoded`` gives the latter beside the ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text)
    kind = id_type(docs, id_col)
    schema = f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string" if digest else "ids array<int>") + (", decoded_sha256 string" if digest or with_decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for block in cut(batches):
            yield _result(vocab, block, id_col, digest, with_decoded)

    return rows_of(docs, id_col, text_col).mapInArrow(run, schema)


def _result(vocab: Vocabulary, block: Block, id_col: str, digest: bool, with_decoded: bool) -> pa.RecordBatch:
    packed = vocab.encode([block.bytes_of(k).decode("utf-8", "replace") for k in range(len(block))])
    counts = np.array([len(x) // 4 for x in packed], np.int64)
    columns = {id_col: block.ids, "n_tokens": pa.array(counts)}
    if digest:
        columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string())
    else:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
    if digest or with_decoded:
        texts = (vocab.decode(np.frombuffer(x, "<u4")) for x in packed)
        columns["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def decode(encoded: DataFrame, vocabulary_text: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: its id and ``text``. Null ids give an empty text; an unknown id raises."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            texts = [vocab.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(f"`{id_col}`", f"`{ids_col}`").mapInArrow(run, f"`{id_col}` {id_type(encoded, id_col)}, text string")
