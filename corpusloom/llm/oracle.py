"""DuckDB statements of those queries that SQL can express.

Trained models, token packing, wrappers, randomness tests, eigenvectors, balanced samples and windows of 400 bytes at every
place are left out: they
are beyond SQL or too slow on whole tables, and the tests hold them against plain readings.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"


def _windows(name: str, words: str, size: int) -> str:
    """A table of all windows of so many words: (doc_id, i, g)."""
    return f"""{name} AS (
      SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size} + 2)) AS i FROM {words} WHERE len(w) >= {size}))"""


def _repeats(size: int) -> str:
    """Windows that occur twice or more in their text, and how many words they cover: tables r<size> and c<size>."""
    return f"""{_windows(f"x{size}", "words", size)},
    r{size} AS (SELECT doc_id, i FROM x{size} JOIN (SELECT doc_id, g FROM x{size} GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)),
    c{size} AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, {size})) AS j FROM r{size}) GROUP BY doc_id)"""


_NEAR = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACED}') AS w FROM documents),
{_windows("long", "words", 4)},
sets AS (
  SELECT DISTINCT doc_id, g FROM long
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc, other) AS (
  SELECT a, a FROM both_ways
  UNION SELECT r.doc, e.b FROM reached r JOIN both_ways e ON e.a = r.other),
named AS (SELECT doc, min(other) AS component_id FROM reached GROUP BY doc)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
       coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN named ON named.doc = w.doc_id"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LEAKS = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
windows AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM words, (SELECT DISTINCT size FROM phrases) WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item FROM windows JOIN phrases USING (size, g)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, size)) AS j FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_REPETITION = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '{_SPACED}') AS w FROM texts),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{_SPACED}')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
{_repeats(3)},
{_repeats(8)},
{_repeats(101)},
base AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
         coalesce(c3.n, 0)::BIGINT AS n_repeat_words, coalesce(c8.n, 0) AS covered, coalesce(c101.n, 0) AS beyond
  FROM texts t JOIN words USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c8 USING (doc_id)
  LEFT JOIN c101 USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * covered <= 30 * n_words AND beyond = 0 AS kept
FROM judged"""

_TOOLS = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, 'call_' || conv_id || '_' || turn AS call_id,
         CASE WHEN turn // 2 > 0 THEN 2 * (turn // 2 // 2) + turn % 2 END AS parent,
         len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS words
  FROM conversations WHERE role = 'user'),
tree(conv_id, turn, level) AS (
  SELECT c.conv_id, c.turn, 0 FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.parent WHERE p.turn IS NULL
  UNION ALL SELECT c.conv_id, c.turn, t.level + 1 FROM tree t JOIN calls c ON c.conv_id = t.conv_id AND c.parent = t.turn),
results AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
linked AS (
  SELECT c.*, t.level, r.text AS result,
         concat_ws('; ', CASE WHEN length(c.text) < 1 THEN 'arguments.question: shorter than 1' END,
                   CASE WHEN length(c.text) > 1500 THEN 'arguments.question: longer than 1500' END,
                   CASE WHEN c.words < 1 THEN 'arguments.words: below 1' END,
                   CASE WHEN c.words > 120 THEN 'arguments.words: above 120' END,
                   CASE WHEN c.parent IS NOT NULL AND p.turn IS NULL THEN 'reference: call_' || c.conv_id || '_' || c.parent || ' unknown' END,
                   CASE WHEN r.turn IS NULL THEN 'result: missing' END) AS errors, (r.turn IS NOT NULL)::BIGINT AS n_results
  FROM calls c JOIN tree t ON t.conv_id = c.conv_id AND t.turn = c.turn
  LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.parent
  LEFT JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1)
SELECT conv_id, turn, 0 AS item, 'call' AS kind, call_id, level::INTEGER AS level, n_results, errors = '' AS valid, errors,
       '{"call":{"arguments":{' || CASE WHEN parent IS NULL THEN '' ELSE '"context":"$call_' || conv_id || '_' || parent || '",' END
       || '"question":' || to_json(text)::VARCHAR || ',"words":' || words || '},"name":"answer"},"id":"' || call_id
       || '","result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"turn":' || turn || '}' AS line
FROM linked
UNION ALL
SELECT r.conv_id, r.turn, 0, 'orphan', 'call_' || r.conv_id || '_' || (r.turn - 1), NULL, 0, false, 'call: missing',
       '{"content":' || to_json(r.text)::VARCHAR || ',"id":"call_' || r.conv_id || '_' || (r.turn - 1) || '","role":"tool"}'
FROM results r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 WHERE c.turn IS NULL
UNION ALL
SELECT conv_id, turn, 0, 'message', NULL, NULL, 0, true, '', '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}'
FROM conversations WHERE role NOT IN ('user', 'assistant')"""

def _crc_table() -> str:
    """The remainders of all single bytes, by the rule of the checksum."""
    table = list(range(256))
    for _ in range(8):
        table = [value >> 1 ^ (0xEDB88320 if value & 1 else 0) for value in table]
    return f"[{', '.join(map(str, table))}]::BIGINT[]"


_SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT doc, run, count(*) AS c FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc,
           unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) > 5 GROUP BY doc, run),
coded AS (SELECT *, hex(encode(doc || ':' || run)) AS code FROM runs),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(code) // 2), lambda i: ('0x' || code[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda h, b: xor(h >> 8, ({_crc_table()})[(xor(h, b) & 255) + 1]))) AS h FROM coded),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) > 5 GROUP BY word HAVING sum(c) > 4),
gaps AS (
  SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM gaps x JOIN gaps y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.a || g.b
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.a || g.b),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n,
         CASE WHEN b.m >= 5 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form
  FROM words w LEFT JOIN best b USING (word)),
led(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT led.word, f.form FROM led JOIN formed f ON f.word = led.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, led.root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM formed f JOIN led USING (word) JOIN formed r ON r.word = led.root WHERE r.form IS NULL"""

SQL: dict[str, str] = {
    "op1_bayesian_minhash": _NEAR,
    "op4_fm_index_decontamination": _LEAKS,
    "op5_suffix_repetition": _REPETITION,
    "op9_tool_call_linking": _TOOLS,
    "op11_trie_pair_spelling": _SPELLING,
}
