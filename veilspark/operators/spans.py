"""Span operators. A document carries its spans in one array column, so
detection, rules, masking and scoring stay inside the row and never shuffle text.

Span layout: ``struct<start_pos,end_pos,entity_type,score,value>``; offsets are
0-based characters, half-open, and the array is sorted by them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.functions.text import BLOCK, contains_any, find_all, left_context, let, markable, stretches, unpack
from veilspark.operators.patterns import Recognizer, bank_for

SPANS = (
    "array<struct<start_pos:int,end_pos:int,entity_type:string,score:double,value:string>>"
)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def make_span(start: Column, end: Column, entity_type: Column, score: Column, value: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start_pos"),
        end.cast("int").alias("end_pos"),
        entity_type.alias("entity_type"),
        score.cast("double").alias("score"),
        value.alias("value"),
    )


def _spans_of(scan: str, rec: Recognizer) -> Column:
    """Scored matches of one recognizer in the text column ``scan``."""

    def to_span(m: Column) -> Column:
        return make_span(m["start_pos"], m["end_pos"], F.lit(rec.entity_type),
                         rec.score(m["value"]), m["value"])

    matches = find_all(scan, rec.regex)
    if rec.refine is not None:
        def moved(m: Column) -> Column:
            return F.transform(rec.refine(m["value"]), lambda part: F.struct(
                (part["start_pos"] + m["start_pos"]).alias("start_pos"), (part["end_pos"] + m["start_pos"]).alias("end_pos"), part["value"].alias("value")))

        matches = F.flatten(F.transform(matches, moved))
    found = F.filter(F.transform(matches, to_span), lambda s: s["score"].isNotNull())
    if rec.hint is not None:
        found = F.when(rec.hint(F.col(scan)), found).otherwise(no_spans())
    return found


def _layers(bank: list[Recognizer]) -> list[tuple[dict[str, list[str]], list[Recognizer]]]:
    """Recognizers grouped so that one type has one vocabulary per group.

    Those without context words form groups that are not boosted.
    """
    layers: list[tuple[dict[str, list[str]], list[Recognizer]]] = []
    for rec in bank:
        for words, members in layers:
            if bool(words) == bool(rec.context) and words.get(rec.entity_type, rec.context) == rec.context:
                break
        else:
            words, members = {}, []
            layers.append((words, members))
        if rec.context:
            words[rec.entity_type] = rec.context
        members.append(rec)
    return layers


def boost_spans(spans: Column, text: Column, words: dict[str, list[str]]) -> Column:
    """Raise a span's score when a context word of its type stands just before it."""
    if not words:
        return spans

    def boost(cut: Column, s: Column) -> Column:
        raised = F.least(F.greatest(s["score"] + C.CONTEXT_BOOST, F.lit(C.MIN_SCORE)), F.lit(1.0))

        def rescored(ctx: Column) -> Column:
            near = None
            for entity_type, vocabulary in words.items():
                is_type = s["entity_type"] == entity_type
                hit = contains_any(ctx, vocabulary)
                near = F.when(is_type, hit) if near is None else near.when(is_type, hit)
            score = F.when(near, F.round(raised, 4)).otherwise(s["score"])
            return make_span(s["start_pos"], s["end_pos"], s["entity_type"], score, s["value"])

        before = left_context(cut, s["start_pos"], C.CONTEXT_CHARS, C.CONTEXT_TOKENS)
        open_score = (s["score"] < 1.0) & s["entity_type"].isin(list(words))
        return F.when(open_score, let(before, rescored)).otherwise(s)

    def boosted(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(stretches(text), lambda cut: F.transform(found, lambda s: boost(cut, s)))).otherwise(found)

    return let(spans, boosted)


def detect(
    docs: DataFrame,
    text: str = "text",
    types: list[str] | None = None,
    min_score: float = C.MIN_SCORE,
    bank: list[Recognizer] | None = None,
    boost: bool = True,
    out: str = "spans",
) -> DataFrame:
    """Add the array of detected spans; one narrow pass over the text."""
    wanted = C.REDACT_TYPES if types is None else types
    recognizers = bank_for(wanted, bank)
    staged = docs.withColumn("_scan", markable(F.coalesce(F.col(text), F.lit(""))))
    groups = []
    for words, members in _layers(recognizers):
        hits = F.concat(no_spans(), *[_spans_of("_scan", r) for r in members])
        groups.append(boost_spans(hits, F.col("_scan"), words) if boost else hits)
    kept = F.filter(F.concat(no_spans(), *groups), lambda s: s["score"] >= min_score)
    return staged.withColumn(out, F.array_sort(kept)).drop("_scan")


def explode_spans(docs: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row per span, without the text."""
    return unpack(docs, keys, F.col(spans))


def map_spans(docs: DataFrame, fn: Callable[[Column], Column], spans: str = "spans") -> DataFrame:
    return docs.withColumn(spans, F.transform(F.col(spans), fn))


# ---- overlap resolution -----------------------------------------------------

def _by_preference(spans: Column) -> Column:
    """Sorted by start, longest first, national types first, best score first."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start_pos"].alias("start_pos"),
            (-s["end_pos"]).alias("neg_end"),
            (~s["entity_type"].startswith("IN_")).alias("generic"),
            (-s["score"]).alias("neg_score"),
            s["entity_type"].alias("entity_type"),
            s.alias("span"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def resolve(spans: Column) -> Column:
    """Left-to-right greedy choice of disjoint spans from one array, block by block."""
    def start(last: Column) -> Column:
        return F.struct(last.alias("last"), no_spans().alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start_pos"] >= acc["last"]
        return F.struct(
            F.when(free, s["end_pos"]).otherwise(acc["last"]).alias("last"),
            F.when(free, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
        )

    def block(acc: Column, b: Column) -> Column:
        return let(F.aggregate(b, start(acc["last"]), step), lambda done: F.struct(
            done["last"].alias("last"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

    first = F.struct(F.lit(0).alias("last"), F.array().cast(f"array<{SPANS}>").alias("out"))
    picked = let(_by_preference(spans), lambda s: F.flatten(F.aggregate(_blocks(s), first, block, lambda acc: acc["out"])))
    return F.when(F.size(spans) > 1, picked).otherwise(spans)


def _blocks(items: Column) -> Column:
    """An array, not empty, cut into blocks."""
    last = ((F.size(items) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def dedup(docs: DataFrame, spans: str = "spans") -> DataFrame:
    return docs.withColumn(spans, resolve(F.col(spans)))


def dedup_entities(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same choice on a table of spans, for documents with very many of them.

    Among spans with one start only the preferred one can survive, so a partial
    aggregate keeps a single row per (document, start) before the shuffle. What
    is then gathered per document is bounded by its number of characters.
    """
    rank = F.struct(
        (-F.col("end_pos")).alias("neg_end"),
        (~F.col("entity_type").startswith("IN_")).alias("generic"),
        (-F.col("score")).alias("neg_score"),
        F.col("entity_type"),
    )
    best = entities.groupBy(key, "start_pos").agg(F.min(rank).alias("best"))
    span = make_span(F.col("start_pos"), -F.col("best.neg_end"), F.col("best.entity_type"),
                     -F.col("best.neg_score"), F.lit(None).cast("string"))
    per_doc = best.groupBy(key).agg(F.collect_list(span).alias("spans"))
    return explode_spans(dedup(per_doc), [key]).drop("value")


# ---- rewriting --------------------------------------------------------------

def stitch(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Text with every (disjoint, sorted) span replaced.

    Finding a character walks the text from its start, so the text is cut once for each
    block of spans, and a block's spans walk their own piece alone.
    """
    def piece(b: Column, i: Column) -> Column:
        first = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i * BLOCK - 1)["end_pos"])
        last = F.element_at(b, -1)["end_pos"]
        return let(F.struct(F.substring(text, first + 1, last - first).alias("text"), first.alias("first")), lambda part: F.array_join(
            F.transform(b, lambda s, k: let(
                F.when(k == 0, part["first"]).otherwise(F.get(b, k - 1)["end_pos"]),
                lambda prev: F.concat(F.substring(part["text"], prev - part["first"] + 1, s["start_pos"] - prev), replacement(s)))), ""))

    tail = F.substring(text, F.element_at(spans, -1)["end_pos"] + 1, F.length(text))
    body = F.concat(F.array_join(F.transform(_blocks(spans), piece), ""), tail)
    return F.when(F.size(spans) == 0, text).otherwise(body)
