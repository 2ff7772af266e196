"""Line-first cleaning: rules per line, failed lines removed, documents that lose too much rejected.

A line of a text (cut at ``\\n``) that holds a word fails
* the punctuation rule, if symbols and exclamation marks are more than a tenth of its characters in words,
* the navigation rule, if it has two separators ``|`` or ``>`` or more, and one for every four words or fewer,
* the boilerplate rule, if it holds one of ``BOILERPLATE`` (any case of A-Z),
* the stutter rule, if more than ``MAX_STUTTER`` percent of its words equal the word before.
Lines without a word are neither kept nor lost text. A document is rejected if the failed
lines hold more than ``MAX_LOST`` percent of its characters in words.

Everything about a document is counted in one pass over its bytes, in a narrow map: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import SPACE, Block, U, carried, chain, cut, hash_spans, id_type, mix, rows_of, spans, within

#: Fixed values of the base counts: symbols, words of a window, least words, most repeated words in percent.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEATED = b"#*$%&|<>", 8, 20, 30

#: Percent of a line's characters in words that may be symbols or "!"; percent of a text's that may be lost.
MAX_MARKS, MAX_STUTTER, MAX_LOST = 10, 40, 30
MARKS = b"#*$%&|<>{}=~^_\\!"
SEPARATORS = b"|>"
BOILERPLATE = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "licensed under", "is licensed under", "released under the", "enable javascript", "subscribe to our newsletter",
]


def _members(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_SYMBOL, _MARK, _SEPARATOR = _members(SYMBOLS), _members(MARKS), _members(SEPARATORS)
_NEWLINE = _members(b"\n")
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _per(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags lie between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[bounds])


def measure(block: Block) -> dict[str, np.ndarray]:
    """Counts and verdicts of each document, and the kept lines' byte ranges under ``lines``."""
    buf, starts = block.buf, block.starts
    n = len(block)
    begin, end = spans(buf, starts, SPACE)
    words_at = np.searchsorted(begin, starts)
    n_words = np.diff(words_at)
    chars = ((buf & 0xC0) != 0x80) & ~SPACE[buf]
    word_chars = _per(chars, starts)
    n_symbols = _per(_SYMBOL[buf], starts)

    breaks = np.flatnonzero(_NEWLINE[buf])
    line_begin = np.sort(np.concatenate([starts[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([breaks, starts[1:]]))
    line_doc = np.repeat(np.arange(n), 1 + _per(_NEWLINE[buf], starts))
    line_words = np.searchsorted(begin, line_end) - np.searchsorted(begin, line_begin)
    worded = line_words > 0
    salt = mix(np.arange(1, n + 1, dtype=U))
    full = line_begin[worded], line_end[worded], line_doc[worded]
    keys = mix(hash_spans(buf, *full[:2]) ^ salt[full[2]])
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    n_dup_lines = np.bincount(full[2][later], minlength=n)

    hashes = hash_spans(buf, begin, end)
    windows = chain(hashes, WINDOW)
    ok = np.flatnonzero(within(words_at, WINDOW, len(begin)))
    owner = np.repeat(np.arange(n), n_words)
    windows = mix(windows[ok] ^ salt[owner[ok]])
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(ok), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.bincount(ok[again], minlength=len(begin) + 1) - np.bincount(ok[again] + WINDOW, minlength=len(begin) + 1)
    n_repeat_words = np.bincount(owner[np.cumsum(covered)[:-1] > 0], minlength=n)

    total = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    size = total[line_end] - total[line_begin]
    marks = np.concatenate([[0], np.cumsum(_MARK[buf], dtype=np.int64)])
    separators = np.concatenate([[0], np.cumsum(_SEPARATOR[buf], dtype=np.int64)])
    n_separators = separators[line_end] - separators[line_begin]
    failed = 100 * (marks[line_end] - marks[line_begin]) > MAX_MARKS * size
    line_of = np.searchsorted(line_begin, begin, "right") - 1
    stutter = np.flatnonzero((hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])) + 1
    failed |= 100 * np.bincount(line_of[stutter], minlength=len(line_begin)) > MAX_STUTTER * line_words
    failed |= (n_separators >= 2) & (4 * n_separators >= line_words)
    lower = buf.tobytes().translate(_UPPER)
    for phrase in BOILERPLATE:
        needle, at = phrase.encode(), -1
        while (at := lower.find(needle, at + 1)) >= 0:
            k = int(np.searchsorted(line_begin, at, "right")) - 1
            failed[k] |= at + len(needle) <= line_end[k]
    failed &= worded
    lost = np.bincount(line_doc[failed], weights=size[failed], minlength=n).astype(np.int64)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words, "base_failed": base_failed, "kept": ~base_failed & (100 * lost <= MAX_LOST * word_chars),
        "n_lines": np.bincount(line_doc[worded], minlength=n), "n_failed_lines": np.bincount(line_doc[failed], minlength=n),
        "lines": (line_begin, line_end, line_doc, failed),
    }


def _texts(block: Block, lines: tuple[np.ndarray, ...]) -> list[str]:
    """Each text without its failed lines."""
    begin, end, doc, failed = lines
    hurt = set(doc[failed].tolist())
    at = np.searchsorted(doc, np.arange(len(block) + 1))
    out = []
    for k in range(len(block)):
        if k in hurt:
            rows = [j for j in range(at[k], at[k + 1]) if not failed[j]]
            out.append(b"\n".join(block.buf[begin[j]:end[j]].tobytes() for j in rows).decode("utf-8", "replace"))
        else:
            out.append(block.bytes_of(k).decode("utf-8", "replace"))
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, carry: bool = False) -> DataFrame:
    """One row per document: id, base counts, ``base_failed``, ``kept``, ``n_lines``, ``n_failed_lines`` and ``clean_text``.

    ``kept`` is false for documents that fail the base rules or lose too much text; their
    ``clean_text`` is given all the same. Null and empty texts have no words: counts 0, base
    failed, not kept, empty text. Repeated rows give repeated results. ``carry`` adds the
    table's other columns as ``row``.
    """
    schema = f"`{id_col}` {id_type(docs, id_col)}, " + ", ".join(f"{c} long" for c in COUNTS)
    schema += ", base_failed boolean, kept boolean, n_lines long, n_failed_lines long" + (", clean_text string" if with_text else "")
    schema += f", row {carried(docs, text_col)}" if carry else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in cut(batches):
            found = measure(block)
            names = [*COUNTS, "base_failed", "kept", "n_lines", "n_failed_lines"]
            columns = [block.ids, *(pa.array(found[c]) for c in names)]
            if with_text:
                columns.append(pa.array(_texts(block, found["lines"]), pa.string()))
            yield pa.RecordBatch.from_arrays(columns + block.rest, [id_col, *names, *(["clean_text"] if with_text else []), *(["row"] if carry else [])])

    return rows_of(docs, id_col, text_col, carry).mapInArrow(run, schema)
