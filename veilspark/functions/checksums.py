"""Check-digit tests on digit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.text import digits_of


def _dihedral_product(i: int, j: int) -> int:
    """Group operation of the symmetries of a pentagon (0-4 turns, 5-9 flips)."""
    turn = (i + j if i < 5 else i - j) % 5
    return turn + 5 * ((i < 5) != (j < 5))


def _permutation_rows() -> list[list[int]]:
    """Eight powers of the position permutation (0)(1 5 8 9 4 2 7)(3 6)."""
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([base[d] for d in rows[-1]])
    return rows


VERHOEFF_PRODUCT = "".join(
    str(_dihedral_product(i, j)) for i in range(10) for j in range(10)
)
VERHOEFF_PERMUTE = "".join(str(d) for row in _permutation_rows() for d in row)


def verhoeff_valid(digits: Column) -> Column:
    """True when a digit string passes the Verhoeff check.

    The state runs over the digits from the right; both tables are read as
    one-character slices of two literal strings.
    """
    step = lambda acc, d: F.struct(
        (acc["i"] + 1).alias("i"),
        F.substring(
            F.lit(VERHOEFF_PRODUCT),
            acc["c"] * 10
            + F.substring(
                F.lit(VERHOEFF_PERMUTE), (acc["i"] % 8) * 10 + d.cast("int") + 1, F.lit(1)
            ).cast("int")
            + 1,
            F.lit(1),
        ).cast("int").alias("c"),
    )
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("c"))
    checked = F.aggregate(F.split(F.reverse(digits), ""), zero, step, lambda acc: acc["c"] == 0)
    return F.when(digits.rlike("^[0-9]+$"), checked).otherwise(F.lit(False))


def luhn_valid(value: Column, min_digits: int = 13) -> Column:
    digits = digits_of(value)
    return (F.length(digits) >= min_digits) & F.call_function("luhn_check", digits)
