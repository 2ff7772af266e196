"""Masks and anonymisers of a single value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.functions.text import digits_of


def _x(n: Column) -> Column:
    return F.repeat(F.lit("X"), n)


def mask_email(value: Column) -> Column:
    at = F.instr(value, "@")
    local_len = at - 1
    local = F.when(local_len > 1, F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), local_len - 1)))
    return F.when(at == 0, F.lit(C.DEFAULT_TAG)).otherwise(
        F.concat(F.coalesce(local, F.lit("*")), F.substring(value, at, F.length(value)))
    )


def _last_four(value: Column) -> Column:
    """X for every digit but the last four; NULL with fewer than four digits."""
    digits = digits_of(value)
    n = F.length(digits)
    return F.when(n >= 4, F.concat(_x(n - 4), F.right(digits, F.lit(4))))


def mask_phone(value: Column) -> Column:
    return F.coalesce(_last_four(value), _x(F.length(value)))


def mask_card(value: Column) -> Column:
    masked = _last_four(value)
    grouped = F.regexp_replace(masked, "(.{4})(?=.)", "$1-")
    return F.coalesce(
        F.when(F.contains(value, F.lit("-")), grouped).otherwise(masked), _x(F.length(value))
    )


def mask_aadhaar(value: Column) -> Column:
    masked = _last_four(value)
    spaced = F.concat_ws(
        " ", F.substring(masked, 1, 4), F.substring(masked, 5, 4), F.substring(masked, 9, 1_000)
    )
    return F.coalesce(
        F.when(masked.isNotNull() & F.contains(value, F.lit(" ")), spaced).otherwise(masked),
        _x(F.length(value)),
    )


def mask_pan(value: Column) -> Column:
    n = F.length(value)
    stars = F.repeat(F.lit("*"), n - 3)
    return F.when(
        n >= 3, F.concat(F.left(value, F.lit(2)), stars, F.right(value, F.lit(1)))
    ).otherwise(F.lit("[REDACTED_PAN]"))


def mask_fixed(entity_type: Column) -> Column:
    return (
        F.when(entity_type == "PERSON", F.lit("[REDACTED_NAME]"))
        .when(entity_type == "US_SSN", F.lit("[REDACTED_SSN]"))
        .otherwise(F.lit(C.DEFAULT_TAG))
    )


def mask_value(entity_type: Column, value: Column) -> Column:
    """Readable mask by type, for the masked view."""
    return (
        F.when(entity_type == "EMAIL_ADDRESS", mask_email(value))
        .when(entity_type == "PHONE_NUMBER", mask_phone(value))
        .when(entity_type == "CREDIT_CARD", mask_card(value))
        .when(entity_type == "IN_AADHAAR", mask_aadhaar(value))
        .when(entity_type == "IN_PAN", mask_pan(value))
        .otherwise(mask_fixed(entity_type))
    )


# ---- configurable anonymisers -----------------------------------------------

def mask_chars(value: Column, char: str, count: int, from_end: bool = False) -> Column:
    """Replace the first or last ``count`` characters, separators included."""
    n = F.least(F.lit(count), F.length(value))
    kept = F.length(value) - n
    fill = F.repeat(F.lit(char), n)
    if from_end:
        return F.concat(F.substring(value, F.lit(1), kept), fill)
    return F.concat(fill, F.substring(value, n + 1, kept))


@dataclass(frozen=True)
class Anonymizer:
    """How to rewrite one entity type: replace, mask, hash or keep."""

    kind: str
    new_value: str = C.DEFAULT_TAG
    char: str = "X"
    count: int = 0
    from_end: bool = False
    salt: str = ""

    def apply(self, value: Column) -> Column:
        if self.kind == "replace":
            return F.lit(self.new_value)
        if self.kind == "mask":
            return mask_chars(value, self.char, self.count, self.from_end)
        if self.kind == "hash":
            return F.sha2(F.concat(F.lit(self.salt), value), 256)
        if self.kind == "keep":
            return value
        raise ValueError(f"unknown anonymizer kind: {self.kind}")


Profile = dict[str, Anonymizer]

DEFAULT_PROFILE: Profile = {
    **{t: Anonymizer("replace", new_value=tag) for t, tag in C.TAGS.items()},
    "CREDIT_CARD": Anonymizer("mask", char="X", count=12),
    "DEFAULT": Anonymizer("replace"),
}


def operator_profile(twelve_digit_mode: str = "mask_last_4", name_mode: str = "redact") -> Profile:
    """Anonymizers for tables, by how national numbers and names are treated."""
    twelve = {
        "mask_last_4": Anonymizer("mask", char="X", count=8),
        "full_mask": Anonymizer("mask", char="X", count=14),
        "redact": Anonymizer("replace", new_value="[REDACTED_AADHAAR]"),
        "ignore": Anonymizer("keep"),
    }
    names = {
        "redact": Anonymizer("replace", new_value="[REDACTED_NAME]"),
        "mask_first": Anonymizer("mask", char="*", count=100),
        "hash": Anonymizer("hash"),
    }
    return {
        "IN_AADHAAR": twelve[twelve_digit_mode],
        "PERSON": names[name_mode],
        "EMAIL_ADDRESS": Anonymizer("mask", char="*", count=100, from_end=True),
        "PHONE_NUMBER": Anonymizer("mask", char="X", count=6),
        "CREDIT_CARD": Anonymizer("mask", char="X", count=12),
        "IN_PAN": Anonymizer("mask", char="*", count=7),
        "DEFAULT": Anonymizer("replace"),
    }


def anonymize(entity_type: Column, value: Column, profile: Profile | None = None) -> Column:
    profile = DEFAULT_PROFILE if profile is None else profile
    named = [(t, a) for t, a in profile.items() if t != "DEFAULT"]
    first_type, first = named[0]
    chain = F.when(entity_type == first_type, first.apply(value))
    for t, a in named[1:]:
        chain = chain.when(entity_type == t, a.apply(value))
    return chain.otherwise(profile.get("DEFAULT", Anonymizer("replace")).apply(value))
