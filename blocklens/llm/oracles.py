"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from blocklens.llm import fingerprints as fp
from blocklens.llm import licenses

_WS = r"[\t-\r ]"
ORACLES = {}


def _fingerprint_parts(name: str, text: str) -> str:
    """CTEs <name>_parts (counts, wide and thin lanes of every document's ``text``) and <name> (its hexadecimal text)."""
    pairs = [lane for p in range(fp.SLOTS // 2) for f in (3, 2, 1, 0) for lane in ((2 * p + 1) * 4 + f, 2 * p * 4 + f)]
    order = [level * fp.LANES + lane for level in range(fp.LEVELS) for lane in pairs]
    powers = ", ".join(str(4**k) for k in range(fp.LEVELS))
    return f"""
{name}_split AS (
  SELECT doc_id, list_filter(string_split({text}, chr(10)), lambda p: p <> '') AS ps FROM edits
), {name}_hashed AS (
  SELECT doc_id, list_transform(ps, lambda p: sha256('0' || p) || sha256('1' || p)) AS hs,
    list_transform(list_filter(flatten(list_transform(ps, lambda p: string_split(regexp_replace(p, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)))),
      lambda s: s <> ''), lambda s: ('0x' || md5(s)[1:15])::BIGINT) AS rs
  FROM {name}_split
), {name}_parts AS (
  SELECT doc_id, len(hs) AS n_paragraphs, len(rs) AS n_sentences,
    list_transform(range({fp.WIDE}), lambda k: coalesce(list_sum(list_transform(hs, lambda h: ('0x' || h[1 + 8 * k : 8 + 8 * k])::BIGINT)), 0)::BIGINT % 4294967296) AS wide,
    list_transform(range({fp.LANES * fp.LEVELS}), lambda i: coalesce(list_sum(list_transform(
      list_filter(rs, lambda r: (r & 1099511627775) % [{powers}][1 + i // {fp.LANES}] = 0 AND (r >> 40) % {fp.LANES} = i % {fp.LANES}),
      lambda r: 1 + (r >> 46) % 255)), 0)::BIGINT % 256) AS thin
  FROM {name}_hashed
), {name} AS (
  SELECT *, format('{{:08x}}', n_paragraphs) || format('{{:08x}}', n_sentences)
    || array_to_string(list_transform(wide, lambda v: format('{{:08x}}', v)), '')
    || array_to_string(list_transform({order}, lambda i: format('{{:02x}}', thin[1 + i])), '') AS hex
  FROM {name}_parts
)"""


def _likeness(name: str, pairs: str) -> str:
    return f"""
{name}_level AS (
  SELECT doc_id, a.n_sentences + b.n_sentences AS total, abs(a.n_sentences - b.n_sentences) AS apart, a.hex = b.hex AS same,
    a.n_paragraphs = b.n_paragraphs AND a.wide = b.wide AS equal,
    list_transform(range({fp.LEVELS}), lambda k: len(list_filter(range({fp.LANES}), lambda j: a.thin[1 + k * {fp.LANES} + j] <> b.thin[1 + k * {fp.LANES} + j]))) AS d
  FROM {pairs}
), {name} AS (
  SELECT doc_id, CASE WHEN equal THEN 1.0 WHEN missing >= total THEN 0.0 ELSE 1.0 - missing / total::DOUBLE END::DOUBLE AS near FROM (
    SELECT *, greatest({fp.ESTIMATE}[1 + d[level]] * 4 ** (level - 1), apart, 1)::BIGINT AS missing FROM (
      SELECT *, coalesce(list_position(list_transform(d, lambda n: n <= {fp.CROWDED}), true), {fp.LEVELS}) AS level FROM {name}_level)))"""


ORACLES["op1_fingerprints"] = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
edits AS (
  SELECT doc_id, text, next_id, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM (
    SELECT doc_id, text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
      coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
    FROM docs WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
), {_fingerprint_parts("own", "text")}, {_fingerprint_parts("changed", "edited")},
{_likeness("near_edit", "own a JOIN changed b USING (doc_id)")},
{_likeness("near_after", "own a JOIN edits USING (doc_id) JOIN (SELECT * RENAME (doc_id AS other_id) FROM own) b ON b.other_id = next_id")}
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, own.hex AS fingerprint, changed.hex AS edited_fingerprint,
  near_edit.near AS near_edited, near_after.near AS near_next
FROM edits JOIN own USING (doc_id) JOIN changed USING (doc_id) JOIN near_edit USING (doc_id) JOIN near_after USING (doc_id)
"""

ORACLES["op3_line_dedup"] = r"""
WITH parts AS (
  SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents
), lines AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS spot, line FROM (
    SELECT doc_id, pos, regexp_replace(raw, '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS line FROM parts) WHERE line <> ''
), grams AS (
  SELECT doc_id, spot, line || chr(10) || b || chr(10) || c AS gram FROM (
    SELECT *, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY spot)) WHERE c IS NOT NULL
), later AS (
  SELECT doc_id, spot FROM (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY doc_id, spot) AS nth FROM grams) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, pos FROM lines JOIN (SELECT DISTINCT doc_id, spot + k AS spot FROM later, range(3) r(k)) USING (doc_id, spot)
), rest AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS text FROM parts ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id) AS n_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
  length(coalesce(rest.text, '')) AS n_chars_left, sha256(coalesce(rest.text, '')) AS text_sha256
FROM documents d LEFT JOIN rest USING (doc_id)
"""

_DIGEST = "translate(" + " || ".join(
    f"to_base(('0x' || sha1(payload)[{1 + 10 * k}:{10 + 10 * k}])::BIGINT, 32, 8)" for k in range(4)
) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"

ORACLES["op4_warc"] = f"""
SELECT page_id, strlen(payload) AS payload_bytes, {_DIGEST} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
"""

ORACLES["op7_quality_rules"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM words WHERE len(ws) >= 3
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS times FROM places), range(3) r(k)
  WHERE times > 1 GROUP BY doc_id
), dups AS (
  SELECT doc_id, sum(n - 1) AS n FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id
), base AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
    len(regexp_extract_all(text, '!!|\?\?|\.\.\.')) AS n_marks, len(string_split(text, chr(10))) AS n_lines
  FROM words LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_upper > 50 * n_letters OR 100 * n_marks > 20 * n_words) AS kept
FROM base
"""

ORACLES["op9_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), least_id AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM sets LEFT JOIN least_id ON x = doc_id
"""

_TEMPLATES = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())

ORACLES["op10_licenses"] = rf"""
WITH normal AS (
  SELECT 'd' AS kind, doc_id, NULL AS license, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', NULL, license, text FROM (VALUES {_TEMPLATES}) v(license, text)
), words AS (
  SELECT kind, doc_id, license, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:()"'']', '', 'g'), '[^\x20\x09-\x0D]+') AS ws FROM normal
), shingles AS (
  SELECT kind, doc_id, license, unnest(range(len(ws) - 4)) AS spot, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) AS s
  FROM words WHERE len(ws) >= 5
), templates AS (
  SELECT license, s, count(*) OVER (PARTITION BY license) AS total, (2 ** ceil(log2(count(*) OVER (PARTITION BY license))))::BIGINT AS size
  FROM (SELECT DISTINCT license, s FROM shingles WHERE kind = 't')
), hits AS (
  SELECT doc_id, license, total, size, s, unnest([spot // size, spot // size - 1]) AS win FROM (SELECT doc_id, spot, s FROM shingles WHERE kind = 'd') JOIN templates USING (s)
), windows AS (
  SELECT doc_id, license, total, win * size AS first_word, count(DISTINCT s) AS matched FROM hits WHERE win >= 0 GROUP BY doc_id, license, total, size, win
)
SELECT doc_id, license, matched, total AS shingles, matched / total AS containment, first_word FROM windows
WHERE 100 * matched >= 80 * total QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY matched DESC, first_word) = 1
"""

ORACLES["op11_contamination"] = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), windows AS (
  SELECT DISTINCT id AS item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i : i + 9], ' '))) AS win
  FROM words WHERE kind = 'b' AND len(ws) > 0
), places AS (
  SELECT id AS doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i : i + n - 1], ' '))) AS win
  FROM words, (SELECT DISTINCT n FROM windows) WHERE kind = 'd' AND len(ws) >= n
), hits AS (
  SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, win)
), counted AS (
  SELECT doc_id, count(DISTINCT i + k) FILTER (k < n) AS n_hit, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items
  FROM hits, range(10) r(k) GROUP BY doc_id
)
SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN counted ON doc_id = id WHERE kind = 'd'
"""

# CRC-32 of the id's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv::VARCHAR) + 1), lambda i: ascii((conv::VARCHAR)[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

ORACLES["op12_conversation_trie"] = f"""
WITH told AS (
  SELECT conv_id AS conv, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, code) AS spot, code, chars FROM told
), convs AS (
  SELECT DISTINCT conv, conv - conv % 100 AS base, {_CRC} % 6 AS h FROM turns
), moved AS (
  SELECT c.conv, spot, code, chars FROM convs c JOIN turns t ON t.conv = c.base AND spot <= h
  UNION ALL SELECT c.conv, spot, code, chars FROM convs c JOIN turns t ON t.conv = c.conv AND spot > h
), rebuilt AS (
  SELECT conv, coalesce(list(code ORDER BY spot) FILTER (code IS NOT NULL), []) AS codes, coalesce(list(chars ORDER BY spot) FILTER (code IS NOT NULL), []) AS sizes
  FROM convs LEFT JOIN moved USING (conv) GROUP BY conv
), members AS (
  SELECT conv, depth, array_to_string(codes[1:depth], ',') AS node, CASE WHEN depth > 0 THEN array_to_string(codes[1:depth - 1], ',') END AS parent,
    CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS chars, depth = len(codes) AS ends
  FROM (SELECT *, unnest(range(len(codes) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT node, depth, parent, chars, min(conv) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (ends), '') AS ends
  FROM members GROUP BY node, depth, parent, chars
), grown AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) c
    ON c.parent = n.node AND c.depth = n.depth
), subtree AS (
  SELECT a.node, a.depth, count(*) FILTER (g.n_children = 0) AS n_leaves, sum((g.n_convs - 1) * g.chars)::BIGINT AS saved_tokens
  FROM grown g JOIN members a ON a.conv = g.conv_id AND a.depth <= g.depth GROUP BY a.node, a.depth
)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved_tokens, sha256(g.ends) AS ends_sha256
FROM grown g JOIN subtree s USING (node, depth) LEFT JOIN nodes p ON p.node = g.parent AND p.depth = g.depth - 1
"""

ORACLES["op13_filter_audit"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), told AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN told USING (doc_id)
), counts AS (
  SELECT part, mask, good, toxic, count(*) AS n FROM flags GROUP BY ALL
), letters AS (
  SELECT l, 2 ** (ascii(l) - 65) AS bit FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l)
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65)) AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0)::INT AS past
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), cells AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (past | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & past = 0 AND mask & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & past > 0 AND mask & own > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (mask & past = 0 AND mask & own > 0 AND good = 1), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (mask & past = 0 AND mask & own > 0 AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM cells
"""
