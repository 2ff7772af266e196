"""SQL dump files, read in byte ranges.

Spark's text source splits a file between lines, so a range may begin inside of a string, a
comment or a statement. Three passes over the lines, none of which moves a text to another task:

1. Each line's effect on the lexer's state is a map; a range's maps compose to one.
2. With the state known at each range's begin, a range is read as if it began a statement; what
   it leaves to its neighbours is summed up: the lines that end a construct begun before it, the
   code up to its first statement end, the place in the statement it ends with, an open construct.
3. One row for each range and file, in order, gives every range its place; constructs that lie
   across a border are put together there. Then ranges are cut into parts on their own.

Between passes only one small row for each range is gathered. Range borders come from the file
listing and ``spark.sql.files.maxPartitionBytes``, so all passes see the same ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.dump_lexer import SAME, Part, Place, line_map, parts, state_after
from veilspark.functions.text import decode_text
from veilspark.operators.dumps import PARTS, part_columns
from veilspark.sources.sinks import settle

#: Code kept of a range for a statement head that crosses its begin, in characters.
LEAD = 1 << 20


def dump_lines(spark: SparkSession, path: str, glob: str = "*.sql") -> DataFrame:
    """Lines of dump files with file, range and bytes; within a range in order."""
    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_bytes"),
        (F.octet_length("value") + 1).cast("long").alias("n_bytes"), decode_text(F.col("value").cast("binary")).alias("line"))


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((file, block), first row, row after the last) of the ranges in a batch."""
    files, blocks = batch.column(0), batch.column(1)
    names = files.dictionary_encode().indices.to_numpy()
    places = blocks.to_numpy()
    edges = np.flatnonzero((names[1:] != names[:-1]) | (places[1:] != places[:-1])) + 1
    ends = [0, *edges.tolist(), len(files)] if len(files) else []
    for first, stop in zip(ends, ends[1:], strict=False):
        yield (files[first].as_py(), blocks[first].as_py()), first, stop


def range_maps(lines: DataFrame) -> DataFrame:
    """Map of states, characters and bytes of each range."""
    small = lines.select("file", "block", line_map(F.col("line")).alias("map"), (F.length("line") + 1).cast("long").alias("chars"), "n_bytes", "file_bytes")

    def fold(batches):
        key, total, chars, size, whole = None, SAME, 0, 0, 0

        def row():
            return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "map": total, "chars": chars, "n_bytes": size, "file_bytes": whole}])

        for batch in batches:
            maps, length, octets, sizes = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            for own, first, stop in runs(batch):
                if own != key:
                    if key:
                        yield row()
                    key, total, chars, size, whole = own, SAME, 0, 0, sizes[first]
                for m in maps[first:stop]:
                    if m != SAME:
                        total = "".join(m[int(s)] for s in total)
                chars, size = chars + sum(length[first:stop]), size + sum(octets[first:stop])
        if key:
            yield row()

    return small.mapInArrow(fold, "file string, block long, map string, chars long, n_bytes long, file_bytes long")


@dataclass
class Begin:
    """What a range must know: the state and character it begins with, its place (None: not known yet), and whether its last line ends without a newline."""

    state: str
    offset: int
    bare: bool = False
    place: Place | None = None


def _begins(maps: list) -> dict[tuple[str, int], Begin]:
    out, state, offset, size, before = {}, "0", 0, 0, None
    for r in sorted(maps, key=lambda r: (r["file"], r["block"])):
        if r["file"] != before:
            state, offset, size, before = "0", 0, 0, r["file"]
        size += r["n_bytes"]
        out[r["file"], r["block"]] = Begin(state, offset, size > r["file_bytes"])
        state, offset = r["map"][int(state)], offset + r["chars"]
    return out


class _Range:
    """Reads the lines of one range: joins lines that a construct holds together, and leaves the first and last to its neighbours."""

    def __init__(self, begin: Begin):
        self.begin, self.state, self.at = begin, begin.state, begin.offset
        self.lead, self.open = [], []
        self.leading, self.held = begin.state != "0", None

    def feed(self, line: str) -> str | None:
        """Text that may be cut now. One line is held back, since only the last may be without newline."""
        done, self.held = self.held, line
        return None if done is None else self._take(done + "\n")

    def close(self) -> str | None:
        return None if self.held is None else self._take(self.held if self.begin.bare else self.held + "\n")

    def _take(self, line: str) -> str | None:
        self.state = state_after(self.state, line.removesuffix("\n"))
        if self.leading:
            self.lead.append(line)
            self.leading = self.state != "0"
            self.at += len(line)
            return None
        self.open.append(line)
        if self.state != "0":
            return None
        text, self.open = "".join(self.open), []
        return text


def _read(batches, begins: dict[tuple[str, int], Begin], finish) -> Iterator[pa.RecordBatch]:
    """Feed lines to their ranges; ``finish`` turns ((file, block), range, texts with their offsets, whether it ends) to batches."""
    key, reader = None, None
    for batch in batches:
        lines = batch.column(2).to_pylist()
        for own, first, stop in runs(batch):
            if own != key:
                if reader:
                    yield from finish(key, reader, _texts(reader, [reader.close()]), True)
                key, reader = own, _Range(begins[own])
            yield from finish(key, reader, _texts(reader, map(reader.feed, lines[first:stop])), False)
    if reader:
        yield from finish(key, reader, _texts(reader, [reader.close()]), True)


def _texts(reader: _Range, found) -> Iterator[tuple[int, str]]:
    for text in found:
        if text is not None:
            at, reader.at = reader.at, reader.at + len(text)
            yield at, text


def range_edges(lines: DataFrame, begins: dict) -> DataFrame:
    """What each range leaves to its neighbours: lines that end an open construct, code up to its first statement end, its last place if nothing was pending before, what it leaves open."""
    def edges(batches):
        found = {}

        def finish(key, reader, texts, last):
            place, first, ended = found.pop(key, (None, "", False))
            for at, text in texts:
                place = place or Place(at)
                place, cut = parts(place, at, text)
                for part in cut if not ended else ():
                    first, ended = first + part.text if len(first) <= LEAD else first, part.ends
                    if ended:
                        break
            found[key] = place, first, ended
            if last:
                row = {"file": key[0], "block": key[1], "lead": "".join(reader.lead), "leading": reader.leading, "first": first, "ended": ended,
                       "place": json.dumps(asdict(place)) if place else None, "open": "".join(reader.open), "open_at": reader.at}
                yield pa.RecordBatch.from_pylist([row], _EDGES)

        yield from _read(batches, begins, finish)

    return lines.select("file", "block", "line").mapInArrow(edges, "file string, block long, lead string, leading boolean, first string, ended boolean, place string, open string, open_at long")


_EDGES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("lead", pa.string()), ("leading", pa.bool_()), ("first", pa.string()), ("ended", pa.bool_()), ("place", pa.string()), ("open", pa.string()), ("open_at", pa.int64())])
_NAMES = ["file", *(c.split()[0] for c in PARTS.split(", "))]


def _batch(file: str, found: list[Part]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), *part_columns(found)], _NAMES)


def _after(place: Place, edge: dict) -> Place:
    """The place at the end of a range that begins with ``place``; its own account took nothing to be pending."""
    own = Place(**json.loads(edge["place"])) if edge["place"] else place
    if edge["ended"] or not (place.head or place.values is not None):
        return own
    if place.values is not None:
        return place
    joined = place.read(edge["first"])
    if len(edge["first"]) <= LEAD or joined.values is not None:
        return joined
    if joined.head and joined.begin == place.begin:
        raise ValueError(f"the head of the statement at character {place.begin} of {edge['file']} is too long")
    return own


def range_places(edges: DataFrame) -> DataFrame:
    """For each range the place it begins with (``place``), and the parts that lie across borders: one pass over the ranges of a file."""

    def walk(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        place, opened, opened_at, out, begins = Place(), "", 0, [], []
        for r in rows:
            opened += r["lead"]
            if opened and not r["leading"]:
                place, cut = parts(place, opened_at, opened)
                out, opened = out + cut, ""
            begins.append((r["block"], json.dumps(asdict(place))))
            place = _after(place, r)
            if r["open"]:
                opened, opened_at = r["open"], r["open_at"]
        if opened:
            out += parts(place, opened_at, opened)[1]
        n = len(begins)
        file = rows[0]["file"]
        whole = pa.Table.from_batches([_batch(file, out)])
        marks = pa.table({"file": [file] * n, **{f.name: pa.nulls(n, f.type) for f in list(whole.schema)[1:]}, "block": pa.array([b for b, _ in begins], pa.int64()), "place": [p for _, p in begins]})
        whole = whole.append_column("block", pa.nulls(len(out), pa.int64())).append_column("place", pa.nulls(len(out), pa.string()))
        return pa.concat_tables([whole, marks.select(whole.column_names)])

    return edges.groupBy("file").applyInArrow(walk, f"file string, {PARTS}, block long, place string")


def scan_dump(spark: SparkSession, path: str, glob: str = "*.sql") -> DataFrame:
    """Parts of dump files, as ``veilspark.operators.dumps`` takes them, with ``file`` as key and offsets in characters."""
    lines = dump_lines(spark, path, glob)
    begins = _begins(range_maps(lines).collect())
    placed = settle(range_places(range_edges(lines, begins)), "dump-ranges")
    for row in placed.where("block IS NOT NULL").select("file", "block", "place").collect():
        begins[row["file"], row["block"]].place = Place(**json.loads(row["place"]))

    def cut(batches):
        places = {}

        def finish(key, reader, texts, last):
            place, out = places.pop(key, reader.begin.place), []
            for at, text in texts:
                place, found = parts(place, at, text)
                out += found
                if len(out) >= 4096:
                    yield _batch(key[0], out)
                    out = []
            if out:
                yield _batch(key[0], out)
            if not last:
                places[key] = place

        yield from _read(batches, begins, finish)

    whole = lines.select("file", "block", "line").mapInArrow(cut, f"file string, {PARTS}")
    return whole.unionByName(placed.where("block IS NULL").drop("block", "place"))
