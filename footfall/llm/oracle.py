"""The queries that SQL can express, for checking them in another engine."""

from __future__ import annotations

from footfall.llm.decontaminate import SLACK, WINDOW
from footfall.llm.line_dedup import MIN_DOCS
from footfall.llm.quality_rules import MAX_HOST_RATE, PRIOR_DOCUMENTS
from footfall.llm.secret_scan import ACCESS, ALLOWED, ASSIGN, ASSIGN_VALUE, CLASSES, HEX, KINDS, NEXT_STEPS
from footfall.llm.secret_scan import WINDOW as ENTROPY_WINDOW
from footfall.llm.text import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('=' || source, 'null') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words FROM d),
grams AS (SELECT r, i, words[i:i + 4] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2, 3, 4]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{WORD}') GROUP BY r),
m AS (SELECT w.doc_id, w.host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(h.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM w LEFT JOIN hit h ON h.r = w.r LEFT JOIN lines l ON l.r = w.r),
f AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > n_words AS symbols,
  10 * n_dup_lines > 3 * n_lines AS dup FROM m),
hosts AS (SELECT host, rule, count(*) AS n, sum(CAST(failed AS INTEGER)) AS failed FROM (
  SELECT host, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule, unnest([short, repeats, symbols, dup]) AS failed FROM f) GROUP BY host, rule),
prior AS (SELECT rule, mean, CASE WHEN spread > 0 AND mean * (1 - mean) / spread - 1 > 0 THEN mean * (1 - mean) / spread - 1
  ELSE {PRIOR_DOCUMENTS} END AS strength FROM (SELECT rule, sum(failed) / sum(n) AS mean, var_samp(failed / n) AS spread FROM hosts GROUP BY rule)),
bad AS (SELECT DISTINCT host FROM hosts JOIN prior USING (rule) WHERE (failed + mean * strength) / (n + strength) > {MAX_HOST_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND host NOT IN (SELECT host FROM bad) AS kept FROM f"""

CONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS words FROM benchmark),
cut AS (SELECT item, words[k:k + {WINDOW - 1}] AS g FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - {WINDOW - 1}) + 1)) AS k FROM i WHERE len(words) > 0)),
win AS (SELECT g, row_number() OVER () AS w, len(g) AS n FROM (SELECT DISTINCT g FROM cut)),
dw AS (SELECT doc_id, p - 1 AS pos, words[p] AS term FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM d)),
wt AS (SELECT w, n, o - 1 AS o, g[o] AS term FROM (SELECT w, n, g, unnest(range(1, n + 1)) AS o FROM win)),
counts AS (SELECT term, count(*) AS c FROM dw WHERE term IN (SELECT term FROM wt) GROUP BY term),
rare AS (SELECT * FROM (SELECT w, n, o, term, row_number() OVER (PARTITION BY w ORDER BY c, o) AS rk, count(*) OVER (PARTITION BY w) AS whole
  FROM wt JOIN counts USING (term)) WHERE rk <= 2 AND whole >= n),
places AS MATERIALIZED (SELECT doc_id, w, n, rk, pos - o AS base FROM dw JOIN rare USING (term)),
near AS MATERIALIZED (SELECT a.doc_id, a.w, a.base, b.base - a.base AS shift FROM places a JOIN places b ON a.doc_id = b.doc_id AND a.w = b.w
  WHERE a.rk = 1 AND b.rk = 2 AND abs(b.base - a.base) <= {SLACK} AND a.base >= 0
  UNION ALL SELECT doc_id, w, base, 0 FROM places WHERE n = 1 AND base >= 0),
found AS (SELECT DISTINCT near.doc_id, near.w, near.base, win.n, win.g FROM near JOIN win USING (w) JOIN d ON d.doc_id = near.doc_id
  WHERE shift = 0 AND d.words[base + 1:base + win.n] = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, base + unnest(range(0, n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (
  SELECT DISTINCT doc_id, item FROM found JOIN cut USING (g)) GROUP BY doc_id),
around AS (SELECT doc_id, count(DISTINCT w) AS n FROM near GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(named.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, CAST(coalesce(around.n, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN around USING (doc_id)"""

GROUPS = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, words[i:i + 4] AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i
  FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, links.b FROM reach JOIN links ON links.a = reach.y),
roots AS (SELECT x AS doc_id, min(y) AS root FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept
FROM d JOIN roots USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _spans(kind: str, pattern: str, keep: str = "true") -> str:
    """Rows ``r, rank, s, e, v`` of one pattern: matches and the gaps between them, added up."""
    gaps, values = f"string_split_regex(t, {_quoted(pattern)})", f"regexp_extract_all(t, {_quoted(pattern)})"
    return f"""SELECT r, {KINDS.index(kind)} AS rank, e - length(v) AS s, e, v FROM (SELECT r, v[k] AS v,
  list_sum(list_transform(g[1:k], lambda x: length(x))) + list_sum(list_transform(v[1:k], lambda x: length(x))) AS e
  FROM (SELECT r, g, v, unnest(range(1, len(v) + 1)) AS k FROM (SELECT r, {gaps} AS g, {values} AS v FROM d WHERE regexp_matches(t, {_quoted(pattern)})))) WHERE {keep}"""


def _secrets() -> str:
    value = f"regexp_extract(v, {_quoted(f'^{ASSIGN}({ASSIGN_VALUE})$')}, 1)"
    base = [_spans("assign", ASSIGN + ASSIGN_VALUE, f"length({value}) >= 6"), _spans("access", ACCESS), _spans("hex", HEX)]
    part = f"substr(v, low, high - low + {ENTROPY_WINDOW})"
    allowed = " AND ".join(f"NOT regexp_matches({part}, {_quoted(p)})" for p in ALLOWED)
    steps = "list_sum(list_transform(range(1, length(win)), lambda j: CASE WHEN ascii(win[j + 1:j + 1]) = ascii(win[j:j]) + 1 THEN 1 ELSE 0 END))"
    entropy = []
    for kind, (letters, _, least) in CLASSES.items():
        entropy.append(f"""SELECT r, rank, s + low - 1 AS s, s + high - 1 + {ENTROPY_WINDOW} AS e FROM (SELECT r, rank, s, v, min(i) AS low, max(i) AS high FROM (
  SELECT r, rank, s, v, i FROM (SELECT r, rank, s, v, i, win, c, count(*) AS n FROM (
    SELECT r, rank, s, v, i, win, unnest(string_split(win, '')) AS c FROM (SELECT *, substr(v, i, {ENTROPY_WINDOW}) AS win FROM (
      SELECT *, unnest(range(1, length(v) - {ENTROPY_WINDOW - 2})) AS i FROM ({_spans(kind, f"{letters}{{{ENTROPY_WINDOW},}}")})))) GROUP BY r, rank, s, v, i, win, c)
  GROUP BY r, rank, s, v, i, win HAVING log2({ENTROPY_WINDOW}) - sum(n * log2(n)) / {ENTROPY_WINDOW} >= {least} AND {steps} < {NEXT_STEPS}) GROUP BY r, rank, s, v) WHERE {allowed}""")
    names = ", ".join(_quoted(k) for k in KINDS)
    joined = f"string_agg([{names}][rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
    count = lambda k: f"CAST(count(*) FILTER (rank = {k}) AS BIGINT)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS MATERIALIZED (SELECT r, rank, s, e FROM ({" UNION ALL ".join(base)}) UNION ALL {" UNION ALL ".join(entropy)}),
b AS (SELECT r, {joined} AS joined, {", ".join(f"{count(k)} AS k{k}" for k in range(3))} FROM spans WHERE rank < 3 GROUP BY r),
a AS (SELECT r, {joined} AS joined, CAST(count(*) FILTER (rank > 2) AS BIGINT) AS n FROM spans GROUP BY r)
SELECT doc_id, coalesce(k0, 0) AS n_assign, coalesce(k1, 0) AS n_access, coalesce(k2, 0) AS n_hex, sha256(coalesce(b.joined, '')) AS base_sha256,
  coalesce(a.joined, '') AS spans, coalesce(a.n, 0) AS n_entropy FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)"""

SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS words FROM documents),
tot AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM d WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot),
i AS (SELECT tf.r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(words) * docs) // terms))) AS part FROM tf JOIN w USING (term) JOIN d ON d.r = tf.r, tot),
s AS (SELECT item_id, r, CAST(sum(part) AS BIGINT) AS score FROM i JOIN q USING (term) GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM s JOIN d USING (r) WHERE score > 0) WHERE rank <= 50"""

LINES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, p, line, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d)),
bad AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
m AS (SELECT r, doc_id, p, line, key IN (SELECT key FROM bad) AS dropped FROM l)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (SELECT r, doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT dropped), '') AS kept FROM m GROUP BY r, doc_id)"""


def _edited(cell: str, cost: int, letter: str) -> str:
    """A cell, eight digits of cost and then the audit, with one more edit; null stays null."""
    return f"printf('%08d', CAST(left({cell}, 8) AS INTEGER) + {cost}) || substr({cell}, 9) || '{letter}'"


def _repairs() -> str:
    """The cheapest edits as a fold over the rows: one cell for each state, whose text order is the order of (cost, audit)."""
    s = [f"s[{k}]" for k in range(1, 5)]
    keep = lambda cell, initial: f"CASE WHEN x[1][2:2] IN ('k', 't') AND x[1][1:1] = '{initial}' THEN CASE x[1][2:2] WHEN 't' THEN {_edited(cell, 1, 'K')} ELSE {_edited(cell, 0, 'K')} END END"
    other = lambda cell: f"CASE x[1][2:2] WHEN 't' THEN {_edited(cell, 3, 'R')} WHEN 'k' THEN {_edited(cell, 2, 'R')} END"
    gone = [_edited(cell, 3, "D") for cell in s]
    to_u = ", ".join(f"{keep(cell, 'u')}, {other(cell)}" for cell in (s[0], s[1], s[3]))
    moved = f"[{gone[0]}, least({gone[1]}, {keep(s[0], 's')}), least({gone[2]}, {to_u}), least({gone[3]}, {keep(s[2], 'a')}, {other(s[2])})]"
    two = lambda v: f"list_transform([{v}], lambda v: [v[1], v[2], least(v[3], {_edited('v[1]', 2, 'I')}, {_edited('v[2]', 2, 'I')}, {_edited('v[4]', 2, 'I')}), v[4]])[1]"
    three = lambda v: f"list_transform([{v}], lambda v: [v[1], v[2], v[3], least(v[4], {_edited('v[3]', 2, 'I')})])[1]"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    bits = "list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda c, z: xor(c >> 8, t.list[CAST(xor(c, z) & 255 AS INTEGER) + 1])), 4294967295)"
    return f"""WITH t AS MATERIALIZED (SELECT list({bits} ORDER BY n) AS list FROM (SELECT unnest(range(256)) AS n)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT conv_id, turn, role, text, {crc} % 20 AS kind FROM k, t),
g AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {white}) AS bare FROM g),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
  CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN 'k' ELSE 't' END AS fault FROM o),
a AS (SELECT conv_id, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, list([initial || fault] ORDER BY i) AS codes, string_agg(initial, '' ORDER BY i) AS initials FROM f GROUP BY conv_id),
e AS (SELECT *, list_reduce(list_prepend({three(two("['00000000', NULL, NULL, NULL]"))}, codes), lambda s, x: {three(two(moved))}) AS cells FROM a),
b AS MATERIALIZED (SELECT *, least(cells[1], cells[4]) AS best FROM e),
l AS (SELECT conv_id, unnest(string_split(substr(best, 9), '')) AS letter, generate_subscripts(string_split(substr(best, 9), ''), 1) AS p FROM b),
n AS (SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM l),
r AS (SELECT n.conv_id, p, letter, role, CASE letter WHEN 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY n.conv_id ORDER BY p) AS place,
  first_value(CASE WHEN letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id ORDER BY p) AS led
  FROM n LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i WHERE letter <> 'D'),
h AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM r GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  CAST(coalesce(list_sum(list_transform(range(1, length(initials)), lambda j: CASE WHEN initials[j:j + 1] IN ('su', 'ua', 'au') THEN 0 ELSE 1 END)), 0) AS BIGINT) AS illegal,
  CAST(coalesce(left(best, 8), '0') AS BIGINT) AS cost, coalesce(substr(best, 9), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM i.conv_id"""


ORACLE = {
    "op4_near_dedup": GROUPS,
    "op5_decontaminate": CONTAMINATION,
    "op6_secret_scan": _secrets(),
    "op8_quality_rules": QUALITY,
    "op11_ranked_search": SEARCH,
    "op12_conversation_repair": _repairs(),
    "op13_line_dedup": LINES,
}
