"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _spans(text: str, pattern: str, kind: str, order: int, valid: str = "true") -> str:
    """All spans of a pattern as structs (start, ord, stop, kind); ``valid`` is over the matched string ``m``."""
    p = pattern.replace("'", "''")
    matches, gaps = f"regexp_extract_all({text}, '{p}')", f"string_split_regex({text}, '{p}')"
    sums = lambda a, n: f"coalesce(list_sum(list_transform({a}[1:{n}], lambda x: length(x))), 0)"
    start = f"{sums(gaps, 'i')} + {sums(matches, 'i - 1')}"
    one = f"{{'start': ({start})::bigint, 'ord': {order}, 'stop': ({start} + length({matches}[i]))::bigint, 'kind': '{kind}', 'm': {matches}[i]}}"
    return f"CASE WHEN regexp_matches({text}, '{p}') THEN list_filter(list_transform(range(1, len({matches}) + 1), lambda i: {one}), lambda s: {valid.replace('@', 's.m')}) ELSE [] END"


def _listed(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda s: s.kind || ':' || s.start || ':' || s.stop), ','), '')"


def _count(spans: str, kind: str) -> str:
    return f"len(list_filter({spans}, lambda s: s.kind = '{kind}'))::bigint"


_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_BASE = [
    _spans("t", _ASSIGN, "assign", 0, f"length(regexp_extract(@, '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8"),
    _spans("t", "AKIA[A-Z0-9]+", "access", 1, "length(@) >= 16"),
    _spans("t", "[0-9a-f]{32,}", "hex", 2),
]
_ADDED = [
    _spans("t", "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", "pem", 3),
    _spans("t", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "jwt", 4),
]

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_concat(list_concat({_BASE[0]}, {_BASE[1]}), {_BASE[2]}) AS base, list_concat({_ADDED[0]}, {_ADDED[1]}) AS added FROM d)
SELECT doc_id, {", ".join(f"{_count('base', k)} AS n_{k}" for k in ("assign", "access", "hex"))},
       sha256({_listed("base")}) AS base_sha256, {_listed("list_concat(base, added)")} AS spans
FROM f
"""

OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body)::bigint AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM r
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
         md5('1:' || coalesce(doc_id::varchar, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::double AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int]::double AS weight
  FROM d GROUP BY source),
w AS (
  SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS total,
         sum(2.0 * source_size) OVER f - 2.0 * source_size AS cap_before,
         sum(weight) OVER () - sum(weight) OVER f + weight AS weight_left
  FROM s WINDOW f AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, greatest(total - cap_before, 0.0) / weight_left AS level_here FROM w),
m AS (SELECT arg_min(level_here, cap_before) AS level FROM l WHERE level_here * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM l, m),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS words_before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::bigint AS source_size, target,
       (whole * size + greatest(0, least(size, round(target - whole * source_size) - words_before)))::bigint AS taken
FROM r
"""

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
_CARD = r"[0-9](?:[\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_only = "regexp_replace(@, '[^0-9]', '', 'g')"
_parts = "list_transform(string_split(@, '.'), lambda p: ltrim(p, '0'))"
_digit = f"list_transform(string_split(reverse({_only}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::int WHEN c::int > 4 THEN 2 * c::int - 9 ELSE 2 * c::int END)"
_PII = [
    _spans("t", _EMAIL, "email", 0),
    _spans("t", _IP, "ip", 1, f"len(list_filter({_parts}, lambda p: length(p) > 3 OR (length(p) = 3 AND p > '255'))) = 0"),
    _spans("t", _CARD, "card", 2, f"CASE WHEN length({_only}) BETWEEN 12 AND 19 THEN list_sum({_digit}) % 10 = 0 ELSE false END"),
    _spans("t", _PHONE, "phone", 3, f"length({_only}) BETWEEN 9 AND 15"),
]
_WORDS = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda w: lower(w))"
_TERM = _spans("t", r"[\p{L}\p{N}]{2,}", "term", 4, "list_contains(hits, lower(@))")
_PUT = "CASE WHEN s.kind <> 'term' THEN '[' || s.kind || ']' WHEN regexp_matches(s.m, '^\\p{Lu}') THEN '[name]' ELSE '[term]' END"
_CUT = f"""list_reduce(list_transform(list_sort(spans), lambda s: {{'start': s.start, 'pos': s.stop, 'out': {_PUT}}}),
  lambda a, x: CASE WHEN x.start >= a.pos THEN {{'start': x.start, 'pos': x.pos, 'out': a.out || substring(t, a.pos + 1, x.start - a.pos) || x.out}} ELSE a END,
  {{'start': 0::bigint, 'pos': 0::bigint, 'out': ''}})"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT r, doc_id, t, list_concat(list_concat(list_concat({_PII[0]}, {_PII[1]}), {_PII[2]}), {_PII[3]}) AS base FROM d),
h AS (SELECT t, unnest(base) AS s FROM f),
e AS (SELECT t, CASE WHEN s.kind IN ('email', 'ip') THEN lower(s.m) ELSE s.kind || ':' || regexp_replace(s.m, '[^0-9]', '', 'g') END AS entity,
  {_WORDS.format("substring(t, 1, s.start)")} AS l, {_WORDS.format("substring(t, s.stop + 1)")} AS a FROM h),
p AS (SELECT DISTINCT t, entity, unnest(list_concat(list_reverse(l)[1:5], a[1:5])) AS term FROM e),
c AS (SELECT entity, count(DISTINCT t) AS n_c FROM e GROUP BY 1 HAVING count(DISTINCT t) >= 3),
ct AS (SELECT entity, n_c, term, count(DISTINCT t) AS n_ct FROM p JOIN c USING (entity) GROUP BY ALL HAVING count(DISTINCT t) >= 3),
k AS (SELECT DISTINCT term FROM ct),
x AS (SELECT DISTINCT t FROM d), n AS (SELECT count(*)::double AS n FROM x),
w AS (SELECT t, unnest(list_distinct({_WORDS.format("t")})) AS term FROM x),
nt AS (SELECT term, count(*) AS n_t FROM w JOIN k USING (term) GROUP BY 1),
z AS (SELECT DISTINCT term FROM ct JOIN nt USING (term), n WHERE n > n_c AND ln(n_ct * n / (n_c * n_t)) / ln(n / n_c) >= 0.8),
v AS (SELECT t, list(term) AS hits FROM w JOIN z USING (term) GROUP BY 1),
g AS (SELECT f.*, list_concat(base, CASE WHEN hits IS NULL THEN [] ELSE {_TERM} END) AS spans FROM f LEFT JOIN v USING (t)),
u AS (SELECT *, {_CUT} AS c FROM g)
SELECT doc_id, {", ".join(f"{_count('base', q)} AS n_{q}" for q in ("email", "ip", "card", "phone"))},
       sha256({_listed("base")}) AS base_sha256, {_listed("spans")} AS spans, sha256(c.out || substring(t, c.pos + 1)) AS sanitized_sha256
FROM u
"""

_ESCAPED = r"regexp_replace(regexp_replace({0}, '#(\\*)## ', '#\\\1## ', 'g'), '<(\\*)/turn>', '<\\\1/turn>', 'g')"
_SAID = r"'\### Assistant: </turn> ok'"

OP11 = rf"""
WITH a AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}),
b AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM a),
c AS (SELECT *, md5(role || chr(10) || t) AS tie, {_ESCAPED.format("t")} AS body, regexp_replace({_ESCAPED.format("role")}, ':(\\*) ', ':\\\1 ', 'g') AS head FROM b),
d AS (
  SELECT conv_id, count(*)::bigint AS n_turns,
         string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, tie) AS listing,
         coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, tie) FILTER (WHERE role = 'assistant'), '') AS learned,
         sum(4 + length(head) + 2 + length(body) + 8)::bigint AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(listing) AS turns_sha256, length(learned)::bigint AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM d
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
n AS (SELECT r, doc_id, len(words)::bigint AS n, words FROM d WHERE len(words) > 0),
g AS (SELECT count(*)::bigint AS docs, sum(n)::bigint AS total FROM n),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
t AS (SELECT r, unnest(words) AS term FROM n),
p AS (SELECT r, term, count(*)::bigint AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM p, g GROUP BY term),
m AS (SELECT r, doc_id, 10 + (90 * n * docs) // total AS m FROM n, g),
s AS (SELECT i, item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint AS score, any_value(doc_id) AS doc_id
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, item_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM k WHERE rank <= 10
"""

ORACLES = {"op3_secret_scan": OP3, "op6_warc": OP6, "op8_source_mixing": OP8, "op10_pii_sanitisation": OP10, "op11_chat_format": OP11, "op13_block_max_search": OP13}
