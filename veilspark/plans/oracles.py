"""The expected result of each query, as SQL for a second engine.

Detection is stated anew here: matches come from that engine's own regex
functions, offsets from the text between them, overlaps and rules from joins.
"""

from __future__ import annotations

import re

from veilspark import config as C
from veilspark.plans.fixtures import ENTITIES, FILES, KYC, MIXED, PIPE_TABLES, SQL_DUMPS, duckdb_sql

KYC_CTE = f"kyc AS ({duckdb_sql(KYC)})"
ENT_CTE = f"ent AS ({duckdb_sql(ENTITIES)})"
FILES_CTE = f"files AS ({duckdb_sql(FILES)})"
TABLES_CTE = f"{KYC_CTE}, tabs AS ({duckdb_sql(PIPE_TABLES)})"
DUMPS_CTE = f"{KYC_CTE}, dumps AS ({duckdb_sql(SQL_DUMPS)})"

MIXED_CTE = f"{KYC_CTE}, tabs AS ({duckdb_sql(PIPE_TABLES)}), dumps AS ({duckdb_sql(SQL_DUMPS)}), mixed AS ({duckdb_sql(MIXED)})"

LETTERS_AS_X = r"regexp_replace(text, '\p{L}', 'x', 'g')"


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-").replace("'", "''") for w in words)


def matches(src: str, regex: str, scan: str = "text", lead: int = 0) -> str:
    """Rows (doc_id, text, start_pos, end_pos, value) of every regex match.

    With ``lead=1`` the regex spends one group on the character before a match.
    """
    heads = f"regexp_extract_all(scan, '{regex}', 1)" if lead else "list_transform(ms, lambda m: '')"
    return f"""SELECT doc_id, text, CAST(pos0 + length(h) AS INT) AS start_pos, CAST(pos0 + length(m) AS INT) AS end_pos,
  substr(text, CAST(pos0 + length(h) + 1 AS BIGINT), length(m) - length(h)) AS value FROM (
  SELECT doc_id, text, m, h, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS pos0 FROM (
   SELECT doc_id, text, unnest(ms) AS m, unnest(hs) AS h, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
    SELECT doc_id, text, ms, {heads} AS hs, regexp_split_to_array(scan, '{regex}') AS gs FROM (
     SELECT doc_id, text, scan, regexp_extract_all(scan, '{regex}') AS ms FROM (
      SELECT doc_id, text, {scan} AS scan FROM {src}))
    WHERE len(ms) > 0)))"""


# ---- validity, restated -----------------------------------------------------

# Product and permutation tables of the check digit.
_D = ("0123456789" "1234067895" "2340178956" "3401289567" "4012395678"
      "5987604321" "6598710432" "7659821043" "8765932104" "9876543210")
_P = ("0123456789" "1576283094" "5803796142" "8916043527" "9453126870"
      "4286573901" "2793806415" "7046913258")


def verhoeff(digits: str, n: int = 12) -> str:
    mapped = (f"list_transform(range(0, {n}), lambda i: CAST(substr('{_P}', (i % 8) * 10 + "
              f"CAST(substr(reverse({digits}), i + 1, 1) AS INT) + 1, 1) AS INT))")
    return (f"(list_reduce(list_prepend(0, {mapped}), "
            f"lambda c, v: CAST(substr('{_D}', c * 10 + v + 1, 1) AS INT)) = 0)")


def aadhaar_ok(value: str) -> str:
    d = f"replace({value}, ' ', '')"
    return (f"(length({d}) = 12 AND substr({d}, 1, 1) NOT IN ('0', '1') AND {d} <> repeat(substr({d}, 1, 1), 12) "
            f"AND {d} <> '234567890123' AND {verhoeff(d)})")


def luhn(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr(reverse({d}), i + 1, 1) AS INT)"
    twice = f"CASE WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    total = f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 1 THEN {twice} ELSE {digit} END))"
    return f"(length({d}) >= 13 AND {total} % 10 = 0)"


def pan_ok(value: str) -> str:
    bad = ", ".join(f"'{p}'" for p in C.PAN_REJECTED_PREFIXES)
    return f"(contains('{C.PAN_HOLDER_CODES}', substr({value}, 4, 1)) AND substr({value}, 1, 3) NOT IN ({bad}))"


def ip_ok(value: str) -> str:
    return " AND ".join(f"CAST(split_part({value}, '.', {i}) AS INT) <= 255" for i in range(1, 5))


def ssn_ok(value: str) -> str:
    return (f"(substr({value},1,3) NOT IN ('000','666') AND substr({value},1,1) <> '9' "
            f"AND substr({value},5,2) <> '00' AND substr({value},8,4) <> '0000')")


def person_score(value: str) -> str:
    words = f"regexp_split_to_array(lower({value}), '\\s+')"
    first = ", ".join(f"'{w}'" for w in C.FIRST_NAMES)
    last = ", ".join(f"'{w}'" for w in C.LAST_NAMES)
    return f"CASE WHEN {words}[1] IN ({first}) OR {words}[-1] IN ({last}) THEN 1.0 ELSE 0.4 END"


#: A place name of more words than most, for queries that look for places.
LONG_PLACE = "Federal Islamic Republic of the Comoro Islands"

# type -> list of (regex, lead group, condition, base score)
_LEAD = "(^|[^0-9A-Za-z_])"
_MONTH = ("Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?|September|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?")
DETECTORS: dict[str, list[tuple[str, int, str, str]]] = {
    "EMAIL_ADDRESS": [(r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}", 0, "true", "1.0")],
    "CREDIT_CARD": [(r"\b[0-9]+(?:[ -][0-9]+)*\b", 0, luhn("value"), "1.0")],
    "PHONE_NUMBER": [
        (_LEAD + r"(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{3}\)[ -]?|[0-9]{3}[ -])?[0-9]{3}[ -]?[0-9]{4}\b", 1, "true", "0.4"),
        (_LEAD + r"\+91[ -]?[0-9]{5}[ -]?[0-9]{5}\b", 1, "true", "0.75"),
        (_LEAD + r"(?:[6-9][0-9]{4}[ -]?[0-9]{5}|0[0-9]{2}[0-9]?[0-9]?[ -][0-9]{6}[0-9]?[0-9]?)\b", 1, "true", "0.4")],
    "US_SSN": [(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0, ssn_ok("value"), "0.85")],
    "IP_ADDRESS": [(r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", 0, ip_ok("value"), "0.6")],
    "DATE_TIME": [
        (r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{1,2}-[A-Z][a-z]+-[0-9]{4}"
         r"|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
         r"|(?:" + _MONTH + r") [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} (?:" + _MONTH + r"),? [0-9]{4})\b", 0, "true", "0.6"),
        (r"(?i)\b(?:" + "|".join(C.FREQUENCY_WORDS) + r")\b", 0, "true", "0.6")],
    "URL": [(r"\bhttps?://[^\s\"''<>]+", 0, "true", "0.6")],
    "IN_AADHAAR": [(r"\b[2-9][0-9]{3}\s[0-9]{4}\s[0-9]{4}\b", 0, aadhaar_ok("value"), "1.0"),
                   (r"\b[2-9][0-9]{11}\b", 0, aadhaar_ok("value"), "1.0")],
    "IN_PAN": [(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0, pan_ok("value"), "1.0")],
    "BIOMETRIC_HASH": [(r"\b(?:fp_hash|face_tmp|face_template|fingerprint)_[a-f0-9]{6,64}\b", 0, "true", "0.85")],
    "LOCATION": [(r"\b(?:NATION_[0-9]+|AFRICA|AMERICA|ASIA|EUROPE|MIDDLE EAST|" + LONG_PLACE + r")\b", 0, "true", "0.6")],
    "PERSON": [(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b", 0, "true", person_score("value"))],
}

_BEFORE = "lower(substr(text, 1, CAST(start_pos AS BIGINT)))"
CONTEXT = (f"array_to_string(regexp_split_to_array(trim({_BEFORE}, ' ' || chr(9) || chr(10) || chr(13)), "
           f"'[ \\t\\r\\n]+')[-5:], ' ')")


def boosted(entity_type: str, score: str) -> str:
    words = C.CONTEXT_WORDS.get(entity_type)
    if not words:
        return f"CAST({score} AS DOUBLE)"
    return (f"CAST(CASE WHEN {score} >= 1 THEN {score} WHEN regexp_matches({CONTEXT}, '{any_of(words)}') "
            f"THEN least(greatest({score} + 0.35, 0.4), 1.0) ELSE {score} END AS DOUBLE)")


def cards(runs: str) -> str:
    """Cards in runs of digit groups, by trying every stretch of characters between group borders."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    ok = (f"length({digits}) BETWEEN 13 AND 19 AND {luhn('v')} AND regexp_matches({digits}, "
          "'^(4|5[0-8]|6|30|3[4-9]|222[1-9]|22[3-9]|2[3-6]|270|271|2720|81|82)')")
    return f"""SELECT doc_id, text, CAST(s + a AS INT) AS start_pos, CAST(s + max(b) AS INT) AS end_pos, max_by(v, b) AS value FROM (
  SELECT *, substr(run, a + 1, b - a) AS v FROM (SELECT *, unnest(range(a + 13, least(a + 37, length(run)) + 1)) AS b FROM (
   SELECT doc_id, text, start_pos AS s, value AS run, unnest(range(0, length(value) - 12)) AS a FROM ({runs}) WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) >= 13))
  WHERE (a = 0 OR substr(run, a, 1) IN (' ', '-')) AND (b = length(run) OR substr(run, b + 1, 1) IN (' ', '-')))
  WHERE substr(v, 1, 1) BETWEEN '0' AND '9' AND {ok} GROUP BY doc_id, text, s, run, a"""


def spans(src: str, types: list[str], scan: str = "text", min_score: float = C.MIN_SCORE,
          scan_of: dict[str, str] | None = None, boost: bool = True) -> str:
    """All spans of ``types`` in ``src(doc_id, text)`` with their final score."""
    parts = []
    for t in types:
        for regex, lead, cond, score in DETECTORS[t]:
            how = (scan_of or {}).get(t, scan)
            found = matches(src, regex, how, lead)
            found = cards(found) if t == "CREDIT_CARD" else found
            final = boosted(t, score) if boost else f"CAST({score} AS DOUBLE)"
            parts.append(
                f"SELECT doc_id, text, '{t}' AS entity_type, start_pos, end_pos, value, {final} AS score "
                f"FROM ({found}) WHERE {cond}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE score >= {min_score}"


def near(width: int) -> str:
    return (f"lower(substr(text, CAST(greatest(start_pos - {width}, 0) + 1 AS BIGINT), "
            f"CAST(end_pos + {width} - greatest(start_pos - {width}, 0) AS BIGINT)))")


def internal(width: int) -> str:
    return (f"(regexp_matches({near(width)}, '{any_of(C.NON_PII_KEYWORDS)}') "
            f"AND NOT regexp_matches({near(width)}, '{any_of(C.PII_KEYWORDS)}'))")


SUPPRESSED = (f"(entity_type IN ('PHONE_NUMBER', 'IN_AADHAAR') AND ({internal(C.NARROW_WINDOW)} "
              f"OR (score < 0.8 AND {internal(C.WIDE_WINDOW)})))")
FREQUENCY = ("(entity_type = 'DATE_TIME' AND lower(trim(value)) IN ("
             + ", ".join(f"'{w}'" for w in C.FREQUENCY_WORDS) + "))")


def ruled(rel: str) -> str:
    return f"SELECT * FROM {rel} WHERE NOT {SUPPRESSED} AND NOT {FREQUENCY}"


def linked(rel: str, key: str = "doc_id", extra: str = "") -> dict[str, str]:
    """The three linkage rules as CTEs l2, l3, l6 over ``rel``."""
    def close(window: int) -> str:
        return (f"EXISTS (SELECT 1 FROM {{src}} p WHERE p.{key} = e.{key} AND p.entity_type = 'PERSON' AND "
                f"(abs(e.start_pos - p.end_pos) < {window} OR abs(p.start_pos - e.end_pos) < {window}))")

    inside = (f"o.start_pos BETWEEN a.start_pos - {C.PROFILE_BEFORE} AND a.end_pos + {C.PROFILE_AFTER}")
    holds = lambda t, src: (f"EXISTS (SELECT 1 FROM {src} o WHERE o.{key} = a.{key} AND o.entity_type = '{t}' AND {inside})")
    return {
        "phone": f"SELECT * REPLACE (CASE WHEN entity_type = 'PHONE_NUMBER' AND score < 0.7 AND "
                 f"{close(C.NAME_PHONE_WINDOW).format(src=rel)} THEN 0.85 ELSE score END AS score) FROM {rel} e",
        "aadhaar": f"SELECT * REPLACE (CASE WHEN entity_type = 'IN_AADHAAR' AND score < 0.8 AND "
                   f"{close(C.NAME_AADHAAR_WINDOW).format(src=rel)} THEN 0.95 ELSE score END AS score) FROM {rel} e",
        "profile": f"SELECT o.* REPLACE (CASE WHEN o.score < 0.9 AND EXISTS (SELECT 1 FROM (SELECT a.{key}, a.start_pos, a.end_pos "
                   f"FROM {rel} a WHERE a.entity_type = 'PERSON' AND ({holds('IN_AADHAAR', rel)} OR "
                   f"({holds('PHONE_NUMBER', rel)} AND {holds('EMAIL_ADDRESS', rel)}))) a WHERE a.{key} = o.{key} AND {inside}) "
                   f"THEN 0.95 ELSE o.score END AS score) FROM {rel} o",
    }


def resolved(rel: str) -> str:
    """Left-to-right choice of disjoint spans, one step per kept span."""
    order = "start_pos, end_pos DESC, CASE WHEN entity_type LIKE 'IN\\_%' ESCAPE '\\' THEN 0 ELSE 1 END, score DESC, entity_type"
    return f"""SELECT * EXCLUDE (rn, lastpos, kept) FROM (
 WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS rn FROM {rel}),
 g AS (SELECT *, end_pos AS lastpos, true AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.*, CASE WHEN o.start_pos >= g.lastpos THEN o.end_pos ELSE g.lastpos END, o.start_pos >= g.lastpos
  FROM g JOIN o ON o.doc_id = g.doc_id AND o.rn = g.rn + 1)
 SELECT * FROM g) WHERE kept"""


TAG = "CASE entity_type " + " ".join(f"WHEN '{t}' THEN '{tag}'" for t, tag in C.TAGS.items()) + (
    " WHEN 'CREDIT_CARD' THEN concat(repeat('X', least(12, length(value))), substr(value, 13)) ELSE '[REDACTED]' END")

_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LAST4 = f"concat(repeat('X', length({_DIGITS}) - 4), right({_DIGITS}, 4))"


def mask_email(v: str) -> str:
    return (f"CASE WHEN NOT contains({v}, '@') THEN '[REDACTED]' ELSE concat(CASE WHEN strpos({v}, '@') > 2 THEN "
            f"concat(left({v}, 1), repeat('*', strpos({v}, '@') - 2)) ELSE '*' END, substr({v}, strpos({v}, '@'))) END")


MASK = f"""CASE entity_type WHEN 'EMAIL_ADDRESS' THEN {mask_email('value')}
 WHEN 'PHONE_NUMBER' THEN {_LAST4}
 WHEN 'CREDIT_CARD' THEN CASE WHEN contains(value, '-') THEN regexp_replace({_LAST4}, '(....)(....)(....)(....)', '\\1-\\2-\\3-\\4') ELSE {_LAST4} END
 WHEN 'IN_AADHAAR' THEN CASE WHEN contains(value, ' ') THEN concat('XXXX XXXX ', right({_DIGITS}, 4)) ELSE {_LAST4} END
 WHEN 'IN_PAN' THEN concat(left(value, 2), repeat('*', length(value) - 3), right(value, 1))
 WHEN 'US_SSN' THEN '[REDACTED_SSN]' WHEN 'PERSON' THEN '[REDACTED_NAME]' ELSE '[REDACTED]' END"""

# Anonymisers of the default table profile.
TABLE_TAG = """CASE entity_type WHEN 'IN_AADHAAR' THEN concat(repeat('X', least(8, length(value))), substr(value, 9))
 WHEN 'PERSON' THEN '[REDACTED_NAME]' WHEN 'EMAIL_ADDRESS' THEN repeat('*', length(value))
 WHEN 'PHONE_NUMBER' THEN concat(repeat('X', least(6, length(value))), substr(value, 7))
 WHEN 'CREDIT_CARD' THEN concat(repeat('X', least(12, length(value))), substr(value, 13))
 WHEN 'IN_PAN' THEN concat(repeat('*', least(7, length(value))), substr(value, 8)) ELSE '[REDACTED]' END"""


def stitched(src: str, rel: str, tag: str, out: str) -> str:
    """Rows (doc_id, out): text of ``src`` with the spans of ``rel`` replaced."""
    return f"""SELECT s.doc_id, CASE WHEN b.body IS NULL THEN s.text ELSE concat(b.body, substr(s.text, b.last_end + 1)) END AS {out}
 FROM {src} s LEFT JOIN (SELECT doc_id, string_agg(concat(substr(text, prev_end + 1, start_pos - prev_end), tag), '' ORDER BY start_pos) AS body,
  max(end_pos) AS last_end FROM (SELECT *, {tag} AS tag, coalesce(lag(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos), 0) AS prev_end
  FROM {rel}) GROUP BY doc_id) b ON s.doc_id = b.doc_id"""


WEIGHT = "CASE entity_type " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in C.RISK_WEIGHTS.items()) + " ELSE 1 END"
RISK = f"CAST(round(sum({WEIGHT} * CAST(score AS DECIMAL(18,4))), 2) AS DOUBLE)"


def level(score: str) -> str:
    return f"CASE WHEN {score} < 10 THEN 'LOW' WHEN {score} < 30 THEN 'MEDIUM' WHEN {score} < 60 THEN 'HIGH' ELSE 'CRITICAL' END"


def scan(src: str, types: list[str], scan_of: dict[str, str] | None = None) -> str:
    """CTEs found -> kept -> fin (disjoint) for a default scan of ``src``."""
    return (f"found AS ({spans(src, types, scan_of=scan_of)}), kept AS ({ruled('found')}), "
            f"fin AS ({resolved('kept')})")


DOC_TYPES = ["EMAIL_ADDRESS", "CREDIT_CARD", "PHONE_NUMBER", "IP_ADDRESS"]
DOC_SCAN = {t: LETTERS_AS_X for t in DOC_TYPES if t != "EMAIL_ADDRESS"}
DEFAULT = [t for t in C.REDACT_TYPES if t != "LOCATION"]
EVERY = DEFAULT + ["PERSON"]
