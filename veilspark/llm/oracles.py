"""Expected results in DuckDB SQL."""

from .quality_rules import BOILERPLATE, MAX_LOST, MAX_MARKS, MAX_REPEATED, MAX_STUTTER, MIN_WORDS, WINDOW
from .templates import DEPTH, MIN_CONTEXTS, MIN_TOKENS, SIMILARITY, SPREAD

_SPACE = r"\x20\x09-\x0D"


def quality(documents: str = "documents") -> str:
    """Base counts and verdict of op4, for a table of documents."""
    phrases = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM {documents}),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^{_SPACE}]+') AS words FROM d),
l AS (SELECT k, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT k, string_split(text, chr(10)) AS ls FROM d)),
m AS (SELECT k, pos, line, regexp_extract_all(line, '[^{_SPACE}]+') AS lw,
        length(regexp_replace(line, '[{_SPACE}]', '', 'g')) AS size,
        length(regexp_replace(line, '[^#*$%&|<>{{}}=~^_\\!]', '', 'g')) AS marks,
        length(regexp_replace(line, '[^|>]', '', 'g')) AS seps,
        translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM l),
f AS (SELECT k, line, size, len(lw) > 0 AND (
        100 * marks > {MAX_MARKS} * size OR (seps >= 2 AND 4 * seps >= len(lw)) OR {phrases}
        OR 100 * len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) > {MAX_STUTTER} * len(lw)) AS failed,
        len(lw) > 0 AS worded FROM m),
p AS (SELECT k, coalesce(sum(size) FILTER (failed), 0) AS lost, sum(size) AS word_chars,
        count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS n_dup_lines FROM f GROUP BY k),
s AS (SELECT k, unnest(range(1, len(words) - {WINDOW} + 2)) AS i, words FROM w),
g AS (SELECT k, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM s),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS j FROM r) GROUP BY k),
a AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(p.word_chars AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(p.n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, p.lost
      FROM w JOIN p USING (k) LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost <= {MAX_LOST} * word_chars AS kept FROM b"""


def contamination(documents: str = "documents", benchmark: str = "benchmark", window: int = 10) -> str:
    """Hits of op6."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM {documents}),
b AS (SELECT item_id, {words} AS w FROM {benchmark}),
bn AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM
        (SELECT item_id, w, least({window}, len(w)) AS n, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bn),
dn AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM
        (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
h AS (SELECT k, dn.n, i, item_id FROM dn JOIN bn ON dn.n = bn.n AND dn.win = bn.win),
c AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM
        (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)"""


def line_templates(documents: str = "documents") -> str:
    """Kept lines of op9, for a table of documents without repeated rows."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM {documents}),
s AS (SELECT k, string_split(text, chr(10)) AS ls, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l AS (SELECT k, pos, ls[pos] AS line, coalesce(CASE WHEN pos > 1 THEN ls[pos - 1] END, '') || chr(10) || coalesce(ls[pos + 1], '') AS ctx FROM s),
m AS (SELECT k, pos, line, ctx, list_transform(regexp_extract_all(line, '[^{_SPACE}]+'),
        lambda t: CASE WHEN regexp_matches(t, '[0-9@/]') THEN '<*>' ELSE t END) AS tokens FROM l),
p AS (SELECT k, pos, ctx, tokens, array_to_string(tokens, ' ') AS tpl, concat(len(tokens), ' ', array_to_string(tokens[1:{DEPTH}], ' ')) AS leaf
      FROM m WHERE len(tokens) >= {MIN_TOKENS}),
places AS (SELECT leaf, tpl, tokens, ctx, count(*) AS n FROM p GROUP BY ALL),
counts AS (SELECT leaf, tpl, tokens, count(*) AS contexts, sum(n) AS n FROM places GROUP BY ALL),
leaves AS (SELECT leaf FROM counts GROUP BY leaf HAVING count(*) > 1 AND sum(contexts) >= {MIN_CONTEXTS}),
members AS (SELECT * FROM counts SEMI JOIN leaves USING (leaf)),
tok AS (SELECT leaf, len(tokens) AS size, contexts, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM members),
votes AS (SELECT leaf, size, pos, token, sum(contexts) AS v FROM tok WHERE pos > {DEPTH} GROUP BY ALL),
best AS (SELECT leaf, size, pos, token FROM (SELECT *, row_number() OVER (PARTITION BY leaf, pos ORDER BY v DESC, CAST(token AS BLOB) DESC) AS r,
        sum(v) OVER (PARTITION BY leaf, pos) AS total FROM votes) WHERE r = 1 AND 2 * v >= total),
fixed AS (SELECT leaf, size, list(pos) AS spots, list(token) AS held FROM best GROUP BY leaf, size HAVING (count(*) + {DEPTH}) * 100 >= size * {SIMILARITY}),
fits AS (SELECT members.leaf, tpl FROM members JOIN fixed USING (leaf)
         WHERE len(list_filter(range(1, len(spots) + 1), lambda i: tokens[spots[i]] <> held[i])) = 0),
spread AS (SELECT leaf, ctx, sum(n) AS n FROM places SEMI JOIN fits USING (leaf, tpl) GROUP BY ALL),
general AS (SELECT leaf FROM spread GROUP BY leaf HAVING count(*) >= {MIN_CONTEXTS} AND count(*) * {SPREAD} >= sum(n)),
gone AS (SELECT tpl FROM counts WHERE contexts >= {MIN_CONTEXTS} AND contexts * {SPREAD} >= n
         UNION SELECT tpl FROM fits SEMI JOIN general USING (leaf)),
dropped AS (SELECT k, pos FROM p SEMI JOIN gone USING (tpl)),
rest AS (SELECT k, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN dropped USING (k, pos) GROUP BY k),
n AS (SELECT k, count(*) AS n FROM dropped GROUP BY k)
SELECT doc_id, CAST(CASE WHEN d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(rest.text, '')) AS clean_sha256
FROM d LEFT JOIN rest USING (k) LEFT JOIN n USING (k)"""


def chats(conversations: str = "conversations") -> str:
    """Events of op1: an assistant's turn is a call, the user's turn after it its result."""
    return rf"""
WITH c AS (SELECT conv_id, turn, role, text, concat('call_', conv_id, '_', turn) AS own, concat('call_', conv_id, '_', turn - 1) AS prior,
        role = 'user' AND turn > 0 AS answers FROM {conversations}),
e AS (SELECT *, exists(SELECT 1 FROM c AS a WHERE a.conv_id = c.conv_id AND a.role = 'assistant' AND a.turn = c.turn - 1) AS asked,
        exists(SELECT 1 FROM c AS u WHERE u.conv_id = c.conv_id AND u.answers AND u.turn = c.turn + 1) AS answered FROM c)
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'call' WHEN answers THEN 'result' ELSE 'message' END AS kind,
  CASE WHEN role = 'assistant' THEN CASE WHEN answered THEN 'linked' ELSE 'unanswered' END
       WHEN answers THEN CASE WHEN asked THEN 'linked' ELSE 'orphan' END ELSE 'plain' END AS status,
  turn AS at_turn, CAST(0 AS BIGINT) AS step,
  CASE WHEN role = 'assistant' THEN length(text) BETWEEN 1 AND 400 END AS valid,
  sha256(CASE WHEN role = 'assistant' THEN concat('{{"role":"assistant","tool_call":{{"arguments":{{"text":', CAST(to_json(text) AS VARCHAR), ',"turn":', turn, '}},"id":"', own, '","name":"reply"}}}}')
       ELSE concat('{{"content":', CAST(to_json(text) AS VARCHAR), ',"role":"', role, '"', CASE WHEN answers THEN concat(',"tool_call_id":"', prior, '"') ELSE '' END, '}}') END) AS json_sha256
FROM e"""


def near_duplicates(documents: str = "documents", words: int = 4, percent: int = 85) -> str:
    """Components of op8: pairs of equal or similar sets, then the smallest id along links."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') AS w FROM {documents}),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS sh FROM
      (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {words} + 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) AS m ON m.a = d.doc_id"""


def neighbours(embeddings: str = "embeddings", k: int = 10, every: int = 100) -> str:
    """Exact answers of op11: every query against every other row."""
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings} WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[2] - z[1]) * (z[2] - z[1])), lambda a, b: a + b)) AS score
      FROM v AS q JOIN v AS c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= {k}"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    byte = "lambda a, j: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {byte})), 4294967295)"


def repairs(conversations: str = "conversations") -> str:
    """Faults and cheapest edits of op12: the best (cost, audit) of each state, row by row, as strings that sort like them."""
    def add(s: str, letter: str, cost: str) -> str:
        return f"CASE WHEN {s} = '~' THEN '~' ELSE concat(lpad(CAST(CAST(left({s}, 6) AS INT) + {cost} AS VARCHAR), 6, '0'), substr({s}, 7), '{letter}') END"

    def where(cond: str, s: str) -> str:
        return f"CASE WHEN {cond} THEN {s} ELSE '~' END"

    user = f"least(v[3], {add('v[1]', 'I', '2')}, {add('v[2]', 'I', '2')}, {add('v[4]', 'I', '2')})"
    grown = f"list_transform([[v[1], v[2], {user}, v[4]]], lambda u: [u[1], u[2], u[3], least(u[4], {add('u[3]', 'I', '2')})])[1]"
    more, may = "CASE WHEN e[2] = '3' THEN 1 ELSE 0 END", "e[2] IN ('0', '3')"
    to = lambda letter, cost: f"least({', '.join(add(f'w[{k}]', letter, cost) for k in (1, 2, 4))})"
    step = f"""list_transform([{grown}], lambda w: [{add('w[1]', 'D', '3')},
  least({add('w[2]', 'D', '3')}, {where(f"e[1] = 's' AND {may}", add('w[1]', 'K', more))}),
  least({add('w[3]', 'D', '3')}, {where(may, to('R', f'2 + {more}'))}, {where(f"e[1] = 'u' AND {may}", to('K', more))}),
  least({add('w[4]', 'D', '3')}, {where(may, add('w[3]', 'R', f'2 + {more}'))}, {where(f"e[1] = 'a' AND {may}", add('w[3]', 'K', more))})])[1]"""
    return rf"""
WITH x AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS fate FROM {conversations}),
y AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE fate <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM y),
f AS MATERIALIZED (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
  CASE WHEN NOT regexp_matches(text, '[^{_SPACE}]') THEN '1' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN '2'
  WHEN NOT regexp_matches(text, '[.!?][{_SPACE}]*\z') THEN '3' ELSE '0' END AS fault FROM r),
g AS (SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
  count(*) FILTER (fault = '1') AS blank, count(*) FILTER (fault = '2') AS duplicate, count(*) FILTER (fault = '3') AS truncated,
  string_agg(initial, '' ORDER BY i) AS initials, list([initial, fault] ORDER BY i) AS rows FROM f GROUP BY conv_id),
v AS (SELECT * EXCLUDE (rows), list_reduce(list_prepend(['000000', '~', '~', '~'], rows), lambda v, e: {step}) AS v FROM g),
b AS MATERIALIZED (SELECT conv_id, gaps, blank, duplicate, truncated, list_sum(list_transform(range(1, length(initials)), lambda k: CASE WHEN substr(initials, k, 2) IN ('su', 'ua', 'au') THEN 0 ELSE 1 END)) AS illegal,
  list_transform([{grown}], lambda u: least(u[1], u[4]))[1] AS best FROM v),
o AS (SELECT conv_id, k, substr(best, 6 + k, 1) AS op FROM (SELECT conv_id, best, unnest(range(1, length(best) - 5)) AS k FROM b)),
p AS (SELECT *, sum(CASE WHEN op <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS i FROM o),
kept AS (SELECT p.conv_id, k, op, role, text, initial, row_number() OVER (PARTITION BY p.conv_id ORDER BY k) AS e FROM p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE op <> 'D'),
lead AS (SELECT conv_id, CASE WHEN op = 'K' AND initial = 's' THEN 1 ELSE 0 END AS lead FROM kept WHERE e = 1),
done AS (SELECT kept.conv_id, sha256(string_agg(concat(CASE WHEN op = 'K' THEN role WHEN (e - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN op = 'I' THEN '' ELSE text END), chr(10) ORDER BY k)) AS h
  FROM kept JOIN lead ON lead.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY kept.conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(left(best, 6) AS INT), 0) AS BIGINT) AS cost, coalesce(substr(best, 7), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {conversations}) AS a LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id"""


def prefix_trie(conversations: str = "conversations") -> str:
    """Nodes of op13, by whole prefixes; a subtree is what conversations of a node pass below it."""
    return f"""
WITH c AS MATERIALIZED (SELECT conv_id, md5(concat(length(role), ':', role, text)) AS m, strlen(text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations} WHERE conv_id IS NOT NULL)),
n AS (SELECT conv_id, max(i) AS n FROM c GROUP BY conv_id),
ids AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM n),
t AS (SELECT ids.conv_id, i AS d, m, b FROM ids JOIN c ON c.conv_id = base AND i <= h
  UNION ALL SELECT ids.conv_id, least(h, coalesce(n, 0)) + i - h, m, b FROM ids JOIN c ON c.conv_id = ids.conv_id AND i > h LEFT JOIN n ON n.conv_id = base),
p AS MATERIALIZED (SELECT conv_id, d, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, b FROM t UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
ends AS (SELECT conv_id, max(d) AS l FROM p GROUP BY conv_id),
nodes AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = l), '')) AS ends
  FROM p JOIN ends USING (conv_id) GROUP BY k, d),
up AS MATERIALIZED (SELECT DISTINCT p.k, a.k AS above FROM p JOIN p AS a ON a.conv_id = p.conv_id AND a.d = p.d - 1),
kids AS (SELECT above AS k, count(*) AS kids FROM up GROUP BY above),
below AS (SELECT DISTINCT p.k AS top, w.k FROM p JOIN p AS w ON w.conv_id = p.conv_id AND w.d >= p.d),
sums AS (SELECT top AS k, sum((n - 1) * b) AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM below JOIN nodes USING (k) LEFT JOIN kids USING (k) GROUP BY top)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, CAST(nodes.n AS BIGINT) AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN up USING (k) LEFT JOIN nodes AS above ON above.k = up.above"""
