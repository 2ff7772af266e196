"""Context rules over detected spans.

``row_*`` functions work on the span array next to its text and need no
shuffle. ``table_*`` functions answer the same question on a table of spans
without text; they meet spans in position buckets, so a document with very many
spans is spread over tasks and no pair of spans is ever materialised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.functions.checksums import luhn_valid
from veilspark.functions.text import contains_any, let, stretches, window_text
from veilspark.operators.spans import make_span


def _rescored(s: Column, score: Column) -> Column:
    return make_span(s["start_pos"], s["end_pos"], s["entity_type"], score, s["value"])


def _raised(score: Column, floor: float) -> Column:
    return F.greatest(score, F.lit(floor))


# ---- linkage rules inside the row -------------------------------------------

# Names and targets are not compared pair by pair: edges are sorted once per document, and how
# many lie in a range is the difference of two binary searches.

def _starts(spans: Column, entity_type: str, edge: str = "start_pos") -> Column:
    return F.array_sort(F.transform(F.filter(spans, lambda s: s["entity_type"] == entity_type), lambda s: s[edge]))


def _steps(spans: Column) -> Column:
    """Step widths of a search in an array no longer than ``spans``, widest first."""
    return F.filter(F.array(*[F.lit(1 << k) for k in range(26, -1, -1)]), lambda k: k <= F.size(spans))


def _below(edges: Column, steps: Column, limit: Column) -> Column:
    """How many of the sorted ``edges`` lie below ``limit``."""
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get(edges, at + k - 1) < limit, at + k).otherwise(at))


def _any_within(edges: Column, steps: Column, low: Column, high: Column) -> Column:
    """Does an edge lie between ``low`` and ``high``, both included?"""
    return _below(edges, steps, high + 1) > _below(edges, steps, low)


def _row_near_person(docs: DataFrame, target: str, below: float, window: int,
                     floor: float, spans: str) -> DataFrame:
    col = F.col(spans)
    # Bound by ``let``: an extra column would be put into the lambda by the optimizer and sorted again for every span.
    edges = F.struct(_starts(col, "PERSON").alias("from"), _starts(col, "PERSON", "end_pos").alias("to"), _steps(col).alias("steps"))

    def lifted(e: Column) -> Column:
        def lift(s: Column) -> Column:
            near = _any_within(e["to"], e["steps"], s["start_pos"] - window + 1, s["start_pos"] + window - 1) | _any_within(
                e["from"], e["steps"], s["end_pos"] - window + 1, s["end_pos"] + window - 1)
            hit = (s["entity_type"] == target) & (s["score"] < below)
            return F.when(F.when(hit, near).otherwise(False), _rescored(s, _raised(s["score"], floor))).otherwise(s)

        return F.when(F.size(e["from"]) > 0, F.transform(col, lift)).otherwise(col)

    return docs.withColumn(spans, let(edges, lifted))


def row_name_phone(docs: DataFrame, spans: str = "spans") -> DataFrame:
    return _row_near_person(docs, "PHONE_NUMBER", 0.7, C.NAME_PHONE_WINDOW, 0.85, spans)


def row_name_aadhaar(docs: DataFrame, spans: str = "spans") -> DataFrame:
    return _row_near_person(docs, "IN_AADHAAR", 0.8, C.NAME_AADHAAR_WINDOW, 0.95, spans)


def row_profile_escalation(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """Raise everything close to a name that stands in a full profile.

    A name qualifies when its window holds a national number, or a phone and an
    e-mail. That implies the document-level test, which is therefore not needed.
    A place is covered when more windows have begun up to it than have ended before it.
    """
    col = F.col(spans)
    kinds = {"aadhaar": "IN_AADHAAR", "phone": "PHONE_NUMBER", "email": "EMAIL_ADDRESS"}
    edges = F.struct(*(_starts(col, t).alias(n) for n, t in kinds.items()), _steps(col).alias("steps"))

    def windows(e: Column) -> Column:
        def qualifies(a: Column) -> Column:
            holds = {n: _any_within(e[n], e["steps"], a["start_pos"] - C.PROFILE_BEFORE, a["end_pos"] + C.PROFILE_AFTER) for n in kinds}
            return F.when(a["entity_type"] == "PERSON", holds["aadhaar"] | (holds["phone"] & holds["email"])).otherwise(False)

        return let(F.filter(col, qualifies), lambda anchors: F.struct(
            F.array_sort(F.transform(anchors, lambda a: a["start_pos"] - C.PROFILE_BEFORE)).alias("from"),
            F.array_sort(F.transform(anchors, lambda a: a["end_pos"] + C.PROFILE_AFTER)).alias("to"), e["steps"].alias("steps")))

    def lifted(w: Column) -> Column:
        def lift(s: Column) -> Column:
            begun, ended = _below(w["from"], w["steps"], s["start_pos"] + 1), _below(w["to"], w["steps"], s["start_pos"])
            covered = F.when(s["score"] < 0.9, begun > ended).otherwise(False)
            return F.when(covered, _rescored(s, _raised(s["score"], 0.95))).otherwise(s)

        return F.when(F.size(w["from"]) > 0, F.transform(col, lift)).otherwise(col)

    return docs.withColumn(spans, let(let(edges, windows), lifted))


# ---- rules that read the text -----------------------------------------------

def number_suppressed(cut: Column, s: Column) -> Column:
    """Is a phone or national number of a text, given as stretches, labelled as an internal reference?"""
    def labelled_internal(width: int) -> Column:
        return let(window_text(cut, s["start_pos"], s["end_pos"], width), lambda near: contains_any(near, C.NON_PII_KEYWORDS) & ~contains_any(near, C.PII_KEYWORDS))

    return s["entity_type"].isin("PHONE_NUMBER", "IN_AADHAAR") & (
        labelled_internal(C.NARROW_WINDOW)
        | ((s["score"] < 0.8) & labelled_internal(C.WIDE_WINDOW))
    )


def _without(text: Column, spans: Column, drop: Callable[[Column, Column], Column]) -> Column:
    """Spans but those that ``drop(stretches, span)`` names; a text without spans is not cut."""
    kept = let(stretches(text), lambda cut: F.filter(spans, lambda s: ~drop(cut, s)))
    return F.when(F.size(spans) > 0, kept).otherwise(spans)


def row_number_suppression(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    return docs.withColumn(spans, _without(F.col(text), F.col(spans), number_suppressed))


def card_fails_luhn(s: Column) -> Column:
    return (s["entity_type"] == "CREDIT_CARD") & ~luhn_valid(s["value"])


def row_luhn(docs: DataFrame, spans: str = "spans") -> DataFrame:
    return docs.withColumn(spans, F.filter(F.col(spans), lambda s: ~card_fails_luhn(s)))


def is_frequency_word(s: Column) -> Column:
    word = F.lower(F.btrim(s["value"], F.lit(" \t\r\n")))
    return (s["entity_type"] == "DATE_TIME") & word.isin(C.FREQUENCY_WORDS)


def row_date_words(docs: DataFrame, spans: str = "spans") -> DataFrame:
    return docs.withColumn(spans, F.filter(F.col(spans), lambda s: ~is_frequency_word(s)))


def apply_context_rules(docs: DataFrame, text: str = "text", profile: str = "default",
                        spans: str = "spans") -> DataFrame:
    """Boost, suppress, verify. Without PERSON spans the linkage rules are no-ops
    and are left out of the plan."""
    if profile == "linkage":
        docs = row_name_phone(docs, spans)
        docs = row_name_aadhaar(docs, spans)
        docs = row_profile_escalation(docs, spans)

    def dropped(cut: Column, s: Column) -> Column:
        return number_suppressed(cut, s) | card_fails_luhn(s) | is_frequency_word(s)

    return docs.withColumn(spans, _without(F.col(text), F.col(spans), dropped))


# ---- linkage rules on a table of spans --------------------------------------

def _bucket(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def _near_flags(entities: DataFrame, key: str, person_edge: str, window: int, prefix: str) -> DataFrame:
    """Per (document, bucket): where the closest person edges lie.

    With buckets as wide as the window, any edge in the same bucket is close
    enough; of the two neighbours only the nearest edge matters. Persons shrink
    to one row per bucket before they are copied to the three buckets they serve.
    """
    people = (
        entities.where(F.col("entity_type") == "PERSON")
        .groupBy(key, _bucket(F.col(person_edge), window).alias("b"))
        .agg(F.min(person_edge).alias("lo"), F.max(person_edge).alias("hi"))
    )
    served = people.select(
        key, "lo", "hi", "b",
        F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias(f"{prefix}_bucket"),
    )
    here = F.col("b") == F.col(f"{prefix}_bucket")
    before = F.col("b") < F.col(f"{prefix}_bucket")
    after = F.col("b") > F.col(f"{prefix}_bucket")
    return served.groupBy(key, f"{prefix}_bucket").agg(
        F.max(here).alias(f"{prefix}_here"),
        F.max(F.when(before, F.col("hi"))).alias(f"{prefix}_prev"),
        F.min(F.when(after, F.col("lo"))).alias(f"{prefix}_next"),
    )


def _is_near(position: Column, prefix: str, window: int) -> Column:
    return F.coalesce(
        F.col(f"{prefix}_here")
        | F.coalesce(position - F.col(f"{prefix}_prev") < window, F.lit(False))
        | F.coalesce(F.col(f"{prefix}_next") - position < window, F.lit(False)),
        F.lit(False),
    )


def _table_near_person(entities: DataFrame, key: str, target: str, below: float,
                       window: int, floor: float) -> DataFrame:
    cols = entities.columns
    is_target = (F.col("entity_type") == target) & (F.col("score") < below)
    # Only targets take part in the joins; the other rows pass by.
    targets = (
        entities.where(is_target)
        .withColumn("s_bucket", _bucket(F.col("start_pos"), window))
        .withColumn("e_bucket", _bucket(F.col("end_pos"), window))
        .join(_near_flags(entities, key, "end_pos", window, "s"), [key, "s_bucket"], "left")
        .join(_near_flags(entities, key, "start_pos", window, "e"), [key, "e_bucket"], "left")
    )
    near = _is_near(F.col("start_pos"), "s", window) | _is_near(F.col("end_pos"), "e", window)
    lifted = targets.withColumn(
        "score", F.when(near, _raised(F.col("score"), floor)).otherwise(F.col("score"))
    )
    return lifted.select(cols).unionByName(entities.where(~is_target))


def table_name_phone(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    return _table_near_person(entities, key, "PHONE_NUMBER", 0.7, C.NAME_PHONE_WINDOW, 0.85)


def table_name_aadhaar(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    return _table_near_person(entities, key, "IN_AADHAAR", 0.8, C.NAME_AADHAAR_WINDOW, 0.95)


def _qualifying_anchors(entities: DataFrame, key: str, width: int) -> DataFrame:
    """Name windows [lo, hi] that hold a full profile."""
    def edge(entity_type: str, fn) -> Column:
        return fn(F.when(F.col("entity_type") == entity_type, F.col("start_pos")))

    kinds = {"IN_AADHAAR": "a", "PHONE_NUMBER": "p", "EMAIL_ADDRESS": "m"}
    per_bucket = (
        entities.where(F.col("entity_type").isin(list(kinds)))
        .groupBy(key, _bucket(F.col("start_pos"), width).alias("b"))
        .agg(*[edge(t, f).alias(f"{n}_{e}") for t, n in kinds.items()
               for e, f in (("lo", F.min), ("hi", F.max))])
    )
    windows = (
        entities.where(F.col("entity_type") == "PERSON")
        .select(key, (F.col("start_pos") - C.PROFILE_BEFORE).alias("lo"),
                (F.col("end_pos") + C.PROFILE_AFTER).alias("hi"))
        .distinct()
    )
    spread = windows.withColumn(
        "b", F.explode(F.sequence(_bucket(F.col("lo"), width), _bucket(F.col("hi"), width)))
    )
    # A window covers its inner buckets fully; in an edge bucket the extreme
    # position on the window's side decides.
    first = F.col("b") == _bucket(F.col("lo"), width)
    last = F.col("b") == _bucket(F.col("hi"), width)

    def holds(n: str) -> Column:
        lo, hi = F.col(f"{n}_lo"), F.col(f"{n}_hi")
        inside = F.when(first, hi >= F.col("lo")).when(last, lo <= F.col("hi")).otherwise(lo.isNotNull())
        return F.coalesce(F.max(inside), F.lit(False))

    return (
        spread.join(per_bucket, [key, "b"])
        .groupBy(key, "lo", "hi")
        .agg(holds("a").alias("a"), holds("p").alias("p"), holds("m").alias("m"))
        .where(F.col("a") | (F.col("p") & F.col("m")))
        .select(key, "lo", "hi")
    )


def table_profile_escalation(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Row version on a table: windows and spans meet in position buckets.

    Buckets are no wider than the narrowest window, so a window never starts and
    ends in one bucket, and per bucket the leftmost window start and rightmost
    window end tell which positions are covered.
    """
    width = C.PROFILE_BEFORE + C.PROFILE_AFTER
    anchors = _qualifying_anchors(entities, key, width)
    first, last = _bucket(F.col("lo"), width), _bucket(F.col("hi"), width)
    covered = (
        anchors.withColumn("b", F.explode(F.sequence(first, last)))
        .groupBy(key, "b")
        .agg(
            F.max((F.col("b") > first) & (F.col("b") < last)).alias("all_of_it"),
            F.min(F.when(F.col("b") == first, F.col("lo"))).alias("from_pos"),
            F.max(F.when(F.col("b") == last, F.col("hi"))).alias("to_pos"),
        )
    )
    low = F.col("score") < 0.9
    hit = F.coalesce(
        F.col("all_of_it")
        | F.coalesce(F.col("start_pos") >= F.col("from_pos"), F.lit(False))
        | F.coalesce(F.col("start_pos") <= F.col("to_pos"), F.lit(False)),
        F.lit(False),
    )
    lifted = (
        entities.where(low)
        .withColumn("b", _bucket(F.col("start_pos"), width))
        .join(covered, [key, "b"], "left")
        .withColumn("score", F.when(hit, F.lit(0.95)).otherwise(F.col("score")))
    )
    return lifted.select(entities.columns).unionByName(entities.where(~low))
