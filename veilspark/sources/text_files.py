"""Text files of any size, read in byte ranges and scanned in pieces.

Spark's text source splits a file between lines. A task puts the lines of its range together to
pieces of about ``PIECE`` characters and gives each the text just before and behind it, so a match
or a context word across a seam is seen. Pieces at the border of a range get that text from their
neighbours, by a join of one small row for each range. Spans are kept by the piece they begin in.

A line stays whole in a piece, so only what spans lines can meet a seam: white space inside a match,
and the words and characters around one. ``AROUND`` characters cover what the rules look at; a match
that holds a longer run of white space than that is found only inside a piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.text import let
from veilspark.operators.sanitize import scan_spans
from veilspark.operators.spans import SPANS
from veilspark.sources.dump_files import dump_lines, runs
from veilspark.sources.sinks import settle

PIECE, AROUND = 1 << 16, 2048

_EDGES = "file string, block long, chars long, n_bytes long, file_bytes long, head string, tail string"
_PIECES = "file string, block long, offset long, lead string, core string, follow string, first boolean, last boolean"


def range_edges(lines: DataFrame, around: int = AROUND) -> DataFrame:
    """Size of each range, its first and its last characters."""
    def edges(batches):
        key, row = None, {}
        for batch in batches:
            texts = batch.column(4)
            for own, start, stop in runs(batch):
                if own != key:
                    if key:
                        yield pa.RecordBatch.from_pylist([row])
                    key, row = own, {"file": own[0], "block": own[1], "chars": 0, "n_bytes": 0, "file_bytes": batch.column(2)[start].as_py(), "head": "", "tail": ""}
                row["chars"] += pc.sum(pc.utf8_length(texts.slice(start, stop - start))).as_py() + stop - start
                row["n_bytes"] += pc.sum(batch.column(3).slice(start, stop - start)).as_py()
                # Few lines make the first and the last characters; the others are only counted.
                first, last, end = start, stop, ""
                while first < stop and len(row["head"]) < around:
                    row["head"] = f"{row['head']}{texts[first].as_py()}\n"[:around]
                    first += 1
                while last > start and len(end) < around:
                    last -= 1
                    end = f"{texts[last].as_py()}\n{end}"[-around:]
                row["tail"] = f"{row['tail']}{end}"[-around:]
        if key:
            yield pa.RecordBatch.from_pylist([row])

    return lines.select("file", "block", "file_bytes", "n_bytes", "line").mapInArrow(edges, _EDGES)


def neighbours(edges: DataFrame, around: int = AROUND) -> DataFrame:
    """For each range its place in characters, the text before and behind it, and whether its last line has no newline."""
    def walk(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        offset, size, before, out = 0, 0, "", []
        for r in rows:
            size += r["n_bytes"]
            out.append({"file": r["file"], "block": r["block"], "offset": offset, "bare": size > r["file_bytes"], "before": before, "behind": ""})
            offset += r["chars"]
            before = (before + r["tail"])[-around:]
        behind = ""
        for r, own in zip(reversed(rows), reversed(out), strict=True):
            own["behind"] = behind
            behind = ((r["head"].removesuffix("\n") if own["bare"] and r["chars"] == len(r["head"]) else r["head"]) + behind)[:around]
        return pa.Table.from_pylist(out)

    return edges.groupBy("file").applyInArrow(walk, "file string, block long, offset long, bare boolean, before string, behind string")


def text_pieces(spark: SparkSession, path: str, glob: str = "*.txt", piece: int = PIECE, around: int = AROUND) -> DataFrame:
    """Files as ordered pieces: ``file``, ``offset`` of ``core`` in characters, and the text before and behind it."""
    lines = dump_lines(spark, path, glob)
    places = settle(neighbours(range_edges(lines, around), around), "text-ranges")
    begins = {(r["file"], r["block"]): (r["offset"], r["bare"]) for r in places.select("file", "block", "offset", "bare").collect()}

    def cut(batches):
        key, text, lead, offset, fresh = None, "", "", 0, True

        def row(core, follow, last):
            return {"file": key[0], "block": key[1], "offset": offset, "lead": lead, "core": core, "follow": follow, "first": fresh, "last": last}

        for batch in batches:
            if not batch.num_rows:
                continue
            found, ended = [], pc.binary_join_element_wise(batch.column(2).cast(pa.large_string()), *(pa.scalar(t, pa.large_string()) for t in ("", "\n")))
            at, data = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset:], ended.buffers()[2]
            for own, start, stop in runs(batch):
                if own != key:
                    if key:
                        found.append(row(text.removesuffix("\n") if begins[key][1] else text, "", True))
                    key, text, lead, offset, fresh = own, "", "", begins[own][0], True
                for first in range(start, stop, 256):
                    text += data[int(at[first]):int(at[min(stop, first + 256)])].to_pybytes().decode()
                    while len(text) >= piece + around:
                        end = text.rfind("\n", around, piece) + 1 or text.find("\n", piece) + 1
                        if len(text) - end <= around:
                            break
                        found.append(row(text[:end], text[end:end + around], False))
                        lead, text, offset, fresh = (lead + text[:end])[-around:], text[end:], offset + end, False
            if found:
                yield pa.RecordBatch.from_pylist(found)
        if key:
            yield pa.RecordBatch.from_pylist([row(text.removesuffix("\n") if begins[key][1] else text, "", True)])

    # One pass: two branches, of inner and of border pieces, would read and cut the files twice. There is one row for each range.
    around_ranges = F.broadcast(places.select("file", "block", "before", "behind"))
    pieces = lines.select("file", "block", "line").mapInArrow(cut, _PIECES).join(around_ranges, ["file", "block"])
    lead = F.when(F.col("first"), F.col("before")).otherwise(F.col("lead"))
    follow = F.when(F.col("last"), F.col("behind")).otherwise(F.col("follow"))
    return pieces.select("file", "offset", lead.alias("lead"), "core", follow.alias("follow"))


def scan_pieces(pieces: DataFrame, **options) -> DataFrame:
    """Pieces with the spans that begin in their core, at their places in the file."""
    whole = pieces.withColumn("_text", F.concat("lead", "core", "follow"))
    found = scan_spans(whole, "_text", out="spans", **options)
    # Bound by ``let``: lengths are counted character by character, once for each piece and not for each of its spans.
    sizes = F.struct(F.length("lead").alias("since"), (F.length("lead") + F.length("core")).alias("until"), (F.col("offset") - F.length("lead")).alias("shift"))

    def own(n):
        def moved(s):
            return F.struct((s["start_pos"] + n["shift"]).alias("start_pos"), (s["end_pos"] + n["shift"]).alias("end_pos"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), s["value"].alias("value"))

        return F.transform(F.filter("spans", lambda s: (s["start_pos"] >= n["since"]) & (s["start_pos"] < n["until"])), moved)

    long_spans = SPANS.replace("start_pos:int,end_pos:int", "start_pos:bigint,end_pos:bigint")
    return found.withColumn("spans", let(sizes, own).cast(long_spans)).drop("_text")
