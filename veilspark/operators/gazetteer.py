"""Place names by lookup instead of by a model; names may have any number of words.

A list of bounded size becomes a recognizer of the bank: one pattern in which names that begin
alike share their beginning, so a scan stays one pass over the text. A longer list is joined:
words meet names by their first word, and the rest is compared in the row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import find_all, markable, unpack
from veilspark.operators.patterns import Recognizer, constant, guarded

TOKEN_REGEX = r"[\p{L}\p{N}_]+"
#: Names and characters that a pattern may hold; more are joined.
MAX_NAMES, MAX_CHARS = 20_000, 400_000


def prefix_regex(names: list[str]) -> str:
    """A pattern for any of the names, the longest that fits, with common beginnings written once."""
    def rest(some: list[str]) -> str:
        ends, some = "" in some, [n for n in some if n]
        if not some:
            return ""
        heads: dict[str, list[str]] = {}
        for n in some:
            heads.setdefault(n[0], []).append(n[1:])
        ways = []
        for head, tails in heads.items():
            while len(tails) == 1 and tails[0] or "" not in tails and len({t[0] for t in tails}) == 1:  # one way on
                head, tails = head + tails[0][0], [t[1:] for t in tails]
            ways.append(re.escape(head) + rest(tails))
        return f"(?:{'|'.join(ways)})" + ("?" if ends else "")

    return rest(sorted(set(names)))


def named(places: DataFrame) -> DataFrame:
    """Distinct names that begin and end with a word."""
    return places.select("name").where(F.col("name").rlike(rf"^{TOKEN_REGEX}(?s:.*(?<=[\p{{L}}\p{{N}}_]))?$")).distinct()


def place_recognizer(places: DataFrame, score: float = 0.6) -> Recognizer | None:
    """LOCATION for the names of ``places(name)``; None without names. An error if they are too many for a pattern."""
    names = [r["name"] for r in named(places).limit(MAX_NAMES + 1).collect()]
    if len(names) > MAX_NAMES or sum(map(len, names)) > MAX_CHARS:
        raise ValueError("too many names for a pattern: find them by detect_places and join the spans")
    return Recognizer("LOCATION", guarded(prefix_regex(names)), constant(score)) if names else None


def detect_places(docs: DataFrame, places: DataFrame, text: str = "text", key: str = "doc_id",
                  score: float = 0.6) -> DataFrame:
    """Names of ``places(name)`` in the texts, as LOCATION spans; of names that begin at one word, each that fits.

    A word travels with as many characters as the longest name has, not with its text. The join is
    left to the optimizer: it broadcasts names by their measured size, or shuffles words.
    """
    names = named(places).withColumn("first", F.regexp_extract("name", f"^{TOKEN_REGEX}", 0))
    longest = names.agg(F.max(F.length("name"))).head()[0] or 0
    staged = docs.withColumn("_scan", markable(F.col(text)))
    words = unpack(staged, [key, "_scan"], find_all("_scan", TOKEN_REGEX))
    words = words.select(key, "start_pos", F.col("value").alias("first"), F.substring(F.col("_scan"), F.col("start_pos") + 1, F.lit(longest + 1)).alias("ahead"))
    size = F.length("name")
    whole = F.startswith("ahead", "name") & ~F.substring(F.col("ahead"), size + 1, F.lit(1)).rlike(TOKEN_REGEX)
    hits = words.join(names, "first").where(whole)
    return hits.select(key, F.lit("LOCATION").alias("entity_type"), "start_pos", (F.col("start_pos") + size).alias("end_pos"),
                       F.lit(score).alias("score"), F.col("name").alias("value"))
