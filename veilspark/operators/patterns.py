"""The pattern bank: what to look for, how sure a hit is, when to skip a text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.functions.checksums import luhn_valid, verhoeff_valid
from veilspark.functions.text import let

# Letters of any script, digits and underscore may not touch a match.
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"

ScoreFn = Callable[[Column], Column]
TextTest = Callable[[Column], Column]


@dataclass(frozen=True)
class Recognizer:
    """One way to find one entity type.

    ``score`` maps the matched text to a score; NULL drops the match.
    ``hint`` is a cheap test a text must pass before the regex is run on it; it
    has to be true for every text the regex can match.
    """

    entity_type: str
    regex: str
    score: ScoreFn
    hint: TextTest | None = None
    context: list[str] = field(default_factory=list)
    # Parts of a match that count instead of it: array<struct<start_pos,end_pos,value>>, offsets within the match.
    refine: Callable[[Column], Column] | None = None
    # Every match is removed again by a context rule, so scans that apply the
    # rules need not look for it.
    ruled_out: bool = False


def guarded(regex: str, first: str = "") -> str:
    """The regex with no word character beside a match.

    ``first`` is the class of characters that a match can begin with. It is tested before what
    stands before a match, which costs much more, at every character of a text.
    """
    return f"(?={first}){NOT_AFTER_WORD}(?:{regex}){NOT_BEFORE_WORD}"


def constant(score: float) -> ScoreFn:
    return lambda value: F.lit(float(score))


def when_valid(test: Callable[[Column], Column], score: float = 1.0) -> ScoreFn:
    """Score of a match that passes ``test``; others are dropped."""
    return lambda value: F.when(test(value), F.lit(float(score)))


# ---- validators -------------------------------------------------------------

def aadhaar_digits(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def aadhaar_valid(value: Column) -> Column:
    """Twelve digits, not starting with 0 or 1, not trivial, check digit right."""
    digits = aadhaar_digits(value)
    return (
        digits.rlike("^[2-9][0-9]{11}$")
        & ~digits.rlike("^(.)\\1{11}$")
        & (digits != "234567890123")
        & verhoeff_valid(digits)
    )


def pan_valid(value: Column) -> Column:
    code = F.upper(F.btrim(value))
    return (
        (F.length(code) == 10)
        & F.contains(F.lit(C.PAN_HOLDER_CODES), F.substring(code, 4, 1))
        & ~F.substring(code, 1, 3).isin(C.PAN_REJECTED_PREFIXES)
    )


def person_score(value: Column) -> Column:
    """1.0 for a listed given or family name, 0.4 for other title-case runs."""
    words = F.split(F.lower(value), r"\s+")
    listed = F.get(words, F.lit(0)).isin(C.FIRST_NAMES) | F.get(
        words, F.size(words) - 1
    ).isin(C.LAST_NAMES)
    titled = value.rlike(r"^\p{Lu}\p{Ll}*(?:\s+\p{Lu}\p{Ll}*)+$")
    return F.when(listed, F.lit(1.0)).when(titled, F.lit(0.4))


def biometric_score(value: Column) -> Column:
    strong = value.rlike("^(?:fp_hash|face_tmp|face_template|fingerprint)_")
    return F.when(strong, F.lit(0.85)).otherwise(F.lit(0.80))


def ssn_valid(value: Column) -> Column:
    return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-") & ~value.rlike("-0000$")


def ipv4_valid(value: Column) -> Column:
    return F.forall(F.split(value, "\\."), lambda part: part.cast("int") <= 255)


def ipv6_valid(value: Column) -> Column:
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    return F.when(F.contains(value, F.lit("::")), groups <= 7).otherwise(groups == 8)


# First digits that card issuers use (ISO/IEC 7812), and the digits a card number may have.
CARD_PREFIX_REGEX = "^(?:4|5[0-8]|6|3[04-9]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|8[12])"
CARD_MIN_DIGITS, CARD_MAX_DIGITS = 13, 19


def cards_in(run: Column) -> Column:
    """Card numbers in a run of digit groups, each standing one blank or hyphen apart.

    Groups may be of any length: from every group on, the most groups are taken that make an
    issuer's number with a right check digit, so a code or an expiry that follows stays outside.
    Numbers found from different groups may overlap; the choice of disjoint spans settles that.
    """
    def from_group(groups: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(groups, 1, i), F.lit(0), lambda n, g: n + F.length(g) + 1)
        ends = F.transform(F.sequence(i, F.least(i + CARD_MAX_DIGITS, F.size(groups)) - 1), lambda j: F.slice(groups, i + 1, j - i + 1))

        def is_card(some: Column) -> Column:
            return let(F.array_join(some, ""), lambda d: F.length(d).between(CARD_MIN_DIGITS, CARD_MAX_DIGITS) & d.rlike(CARD_PREFIX_REGEX) & luhn_valid(d))

        def as_span(some: Column) -> Column:
            size = F.length(F.array_join(some, " "))
            return F.struct(before.alias("start_pos"), (before + size).alias("end_pos"), F.substring(run, before + 1, size).alias("value"))

        return F.transform(F.slice(F.reverse(F.filter(ends, is_card)), 1, 1), as_span)

    starts = lambda groups: F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: from_group(groups, i)))
    return let(F.split(run, "[ -]"), starts)


# ---- hints ------------------------------------------------------------------

def has(fragment: str) -> TextTest:
    return lambda text: F.contains(text, F.lit(fragment))


def has_digits(count: int) -> TextTest:
    return lambda text: text.rlike("[0-9]{%d}" % count)


def has_frequency_word(text: Column) -> Column:
    """Every listed word ends in "ly" or holds "annual" or "night"."""
    return text.rlike("(?i)ly|annual|night")


# ---- the bank ---------------------------------------------------------------

EMAIL_REGEX = (
    r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}_.%+-]++@[\p{L}\p{N}-]+"
    r"(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
)
# Runs of at least 13 digits in groups; which of the groups are a card is told by ``cards_in``.
CARD_DIGITS_REGEX = "[0-9](?:[ -]?[0-9]){12}"
CARD_REGEX = guarded(rf"(?={CARD_DIGITS_REGEX})[0-9]+(?:[ -][0-9]+)*", "[0-9]")
PHONE_REGEX = guarded(
    r"(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{3}\)[ -]?|[0-9]{3}[ -])?[0-9]{3}[ -]?[0-9]{4}", "[+(0-9]"
)
PHONE_IN_REGEX = guarded(r"\+91[ -]?[0-9]{5}[ -]?[0-9]{5}", "[+]")
# Mobiles of ten digits, together or 5-5, landlines with their trunk code.
PHONE_LOCAL_REGEX = guarded(
    r"[6-9][0-9]{9}|[6-9][0-9]{4}[ -][0-9]{5}|0[0-9]{2,4}[ -][0-9]{6,8}", "[06-9]"
)
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|January|February|March|April|June|July|August|September|October|November|December)"
SSN_REGEX = guarded(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]")
IPV4_REGEX = guarded(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "[0-9]")
IPV6_REGEX = (
    r"(?=[0-9A-Fa-f])(?<![\p{L}\p{N}_:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)"
    r"(?![\p{L}\p{N}_:])"
)
DATE_REGEX = guarded(
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?"
    r"|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
    r"|[0-9]{1,2}-[A-Z][a-z]+-[0-9]{4}"
    r"|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
    rf"|{MONTHS} [0-9]{{1,2}},? [0-9]{{4}}|[0-9]{{1,2}} {MONTHS},? [0-9]{{4}}", "[0-9JFMASOND]"
)
FREQUENCY_REGEX = "(?i)" + guarded("|".join(C.FREQUENCY_WORDS), f"[{''.join(sorted({w[0] for w in C.FREQUENCY_WORDS}))}]")
URL_REGEX = "(?=h)" + NOT_AFTER_WORD + r"https?://[^\s\"'<>]+"
AADHAAR_REGEX = guarded(r"[2-9][0-9]{3}\s[0-9]{4}\s[0-9]{4}", "[2-9]")
AADHAAR_RUN_REGEX = guarded(r"[2-9][0-9]{11}", "[2-9]")
# How tax numbers, names and device hashes are written.
PAN_REGEX = guarded(r"[A-Z]{5}[0-9]{4}[A-Z]", "[A-Z]")
PERSON_REGEX = guarded(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}", "[A-Z]")
BIOMETRIC_REGEX = guarded(
    r"(?:fp_hash|face_tmp|face_template|fingerprint|iris_hash|bio_hash|voice_hash"
    r"|retina_hash)_[a-f0-9]{6,64}", "[fivbr]"
)

BANK: list[Recognizer] = [
    Recognizer("EMAIL_ADDRESS", EMAIL_REGEX, constant(1.0), has("@")),
    Recognizer("CREDIT_CARD", CARD_REGEX, constant(1.0), lambda text: text.rlike(CARD_DIGITS_REGEX), refine=cards_in),
    Recognizer("PHONE_NUMBER", PHONE_REGEX, constant(0.4), has_digits(3),
               C.CONTEXT_WORDS["PHONE_NUMBER"]),
    Recognizer("PHONE_NUMBER", PHONE_IN_REGEX, constant(0.75), has("+91"),
               C.CONTEXT_WORDS["PHONE_NUMBER"]),
    Recognizer("PHONE_NUMBER", PHONE_LOCAL_REGEX, constant(0.4), has_digits(3),
               C.CONTEXT_WORDS["PHONE_NUMBER"]),
    Recognizer("US_SSN", SSN_REGEX, when_valid(ssn_valid, 0.85), has_digits(3),
               C.CONTEXT_WORDS["US_SSN"]),
    Recognizer("IP_ADDRESS", IPV4_REGEX, when_valid(ipv4_valid, 0.6), has_digits(1),
               C.CONTEXT_WORDS["IP_ADDRESS"]),
    Recognizer("IP_ADDRESS", IPV6_REGEX, when_valid(ipv6_valid, 0.6), has(":"),
               C.CONTEXT_WORDS["IP_ADDRESS"]),
    Recognizer("DATE_TIME", DATE_REGEX, constant(0.6), has_digits(1),
               C.CONTEXT_WORDS["DATE_TIME"]),
    Recognizer("DATE_TIME", FREQUENCY_REGEX, constant(0.6), has_frequency_word,
               C.CONTEXT_WORDS["DATE_TIME"], ruled_out=True),
    Recognizer("URL", URL_REGEX, constant(0.6), has("://"), C.CONTEXT_WORDS["URL"]),
    Recognizer("IN_AADHAAR", AADHAAR_REGEX, when_valid(aadhaar_valid), has_digits(4),
               C.CONTEXT_WORDS["IN_AADHAAR"]),
    Recognizer("IN_AADHAAR", AADHAAR_RUN_REGEX, when_valid(aadhaar_valid), has_digits(12),
               C.CONTEXT_WORDS["IN_AADHAAR"]),
    Recognizer("IN_PAN", PAN_REGEX, when_valid(pan_valid), has_digits(4),
               C.CONTEXT_WORDS["IN_PAN"]),
    Recognizer("BIOMETRIC_HASH", BIOMETRIC_REGEX, biometric_score, has("_"),
               C.CONTEXT_WORDS["BIOMETRIC_HASH"]),
    Recognizer("PERSON", PERSON_REGEX, person_score, None, C.CONTEXT_WORDS["PERSON"]),
]


def bank_for(types: list[str] | None = None, bank: list[Recognizer] | None = None) -> list[Recognizer]:
    """Recognizers of the wanted types; the others are never evaluated."""
    chosen = BANK if bank is None else bank
    return [r for r in chosen if types is None or r.entity_type in types]


def register(recognizer: Recognizer, bank: list[Recognizer] | None = None) -> list[Recognizer]:
    """A new bank with one more recognizer; the shared one stays unchanged."""
    return [*(BANK if bank is None else bank), recognizer]


def unvalidated(entity_type: str, score: float) -> list[Recognizer]:
    """Recognizers of a type that keep every match, for rules that check later."""
    return [replace(r, score=constant(score), context=[], refine=None) for r in BANK if r.entity_type == entity_type]
