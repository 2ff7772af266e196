"""Small text expressions used across operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Non-characters set aside by Unicode for a program's own use.
OPEN, CLOSE, SAFE, GAP = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"

MATCHES = "array<struct<start_pos:int,end_pos:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def contains_any(text: Column, words: list[str]) -> Column:
    """Does ``text`` hold any of ``words`` as a substring?

    One alternation keeps the plan small; words that contain another listed
    word are redundant and left out.
    """
    short = [w for w in words if not any(o != w and o in w for o in words)]
    return text.rlike("|".join(re.escape(w) for w in short))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def markable(text: Column) -> Column:
    """Text in which the two marker characters cannot occur (same length)."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit(SAFE)), F.lit(CLOSE), F.lit(SAFE))


def sql_string(value: str) -> str:
    """A string literal in Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Long arrays are worked on in blocks: appending to an array copies it, so a fold over
# all elements would be quadratic. Blocks keep the copies short.
BLOCK = 256


def blocks_of(items: str) -> str:
    """SQL: an array cut into blocks of ``BLOCK`` elements; no block for an empty array."""
    return (f"if(size({items}) = 0, array(), transform(sequence(0, cast((size({items}) - 1) div {BLOCK} as int)), "
            f"b -> slice({items}, b * {BLOCK} + 1, {BLOCK})))")


def find_all(text: str, regex: str) -> Column:
    """Every match of ``regex`` with its 0-based, half-open character offsets.

    One regex pass brackets the matches with marker characters; cutting at the
    opening marker and adding up the piece lengths yields the offsets. ``text``
    names a column that went through :func:`markable`. Written as one SQL
    expression, since it is built once per recognizer.
    """
    marked = f"regexp_replace({text}, {sql_string(regex)}, '{OPEN}$0{CLOSE}')"
    # Every piece but the first is a match, its closing marker and what follows; pieces are measured once.
    sized = (f"transform(ps, (p, i) -> named_struct('width', length(p) - if(i > 0, 1, 0), "
             f"'value', if(i > 0, substring_index(p, '{CLOSE}', 1), null)))")
    hit = "named_struct('start_pos', a.pos, 'end_pos', a.pos + length(p.value), 'value', p.value)"
    starts = ("aggregate(bs, named_struct('pos', 0, 'out', cast(array() as array<int>)), (a, b) -> named_struct("
              "'pos', a.pos + aggregate(b, 0, (n, p) -> n + p.width), 'out', concat(a.out, array(a.pos))), a -> a.out)")
    inner = (f"aggregate(b, named_struct('pos', at, 'out', cast(array() as {MATCHES})), "
             f"(a, p) -> named_struct('pos', a.pos + p.width, "
             f"'out', if(p.value is not null, concat(a.out, array({hit})), a.out)), a -> a.out)")
    found = (f"transform(array({sized}), ss -> transform(array({blocks_of('ss')}), "
             f"bs -> flatten(zip_with(bs, {starts}, (b, at) -> {inner})))[0])[0]")
    return F.expr(f"transform(array(split({marked}, '{OPEN}', -1)), ps -> if(size(ps) = 1, cast(array() as {MATCHES}), {found}))[0]")


def unpack(df: DataFrame, keys: list[str], items: Column) -> DataFrame:
    """One row per struct of an array column, next to ``keys``.

    The outer form is used on purpose: for the inner one the optimizer derives a
    size filter and pushes it below the projections that built the array, which
    would compute the array twice.
    """
    rows = df.select(*keys, F.explode_outer(items).alias("_item"))
    return rows.where(F.col("_item").isNotNull()).select(*keys, "_item.*")


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8 when valid, else Latin-1."""
    as_utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))


# Finding a character walks the text from its start. What looks at many places of a text goes
# by stretches, an array of which all but the last hold ``1 << STRETCH`` characters.
STRETCH = 10


def stretches(text: Column) -> Column:
    """A text as its stretches, cut in one pass."""
    return F.when(F.length(text) <= 1 << STRETCH, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % (1 << STRETCH)), F.lit(0)))


def part_of(cut: Column, start: Column, size: Column) -> Column:
    """``size`` characters of a text from its 0-based place ``start`` on, out of its stretches."""
    first = F.shiftright(start, STRETCH)
    near = F.array_join(F.slice(cut, first + 1, F.shiftright(start + size, STRETCH) - first + 1), "")
    return F.substring(near, start - first * (1 << STRETCH) + 1, size)


def window_text(cut: Column, start: Column, end: Column, width: int) -> Column:
    """Lower-cased characters from ``width`` before to ``width`` after a span of a text given as stretches."""
    left = F.greatest(start - width, F.lit(0))
    return F.lower(part_of(cut, left, end + width - left))


def left_context(cut: Column, start: Column, chars: int, tokens: int) -> Column:
    """The last ``tokens`` words, lower-cased, before a span of a text given as stretches.

    ``chars`` characters are enough as a rule; if they hold fewer words, all that
    stands before the span is looked at.
    """
    def words(n: Column) -> Column:
        before = F.lower(part_of(cut, start - n, n))
        return F.split(F.btrim(before, F.lit(" \t\r\n")), "[ \\t\\r\\n]+")

    near = F.least(start, F.lit(chars))
    # The first of the words may be cut, so one more is asked for.
    enough = lambda w: F.when((start <= chars) | (F.size(w) > tokens), w).otherwise(words(start))
    return let(let(words(near), enough), lambda w: F.array_join(
        F.slice(w, F.greatest(F.size(w) - tokens, F.lit(0)) + 1, tokens), " "))
