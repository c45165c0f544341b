"""SQL for the pipeline queries that it can express, for DuckDB over the whole tables."""

from __future__ import annotations

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP1 = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':7') AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s
), r AS (
  SELECT *, 3.0 * source_size / weight AS ratio FROM w
), l AS (
  SELECT *,
    sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
    row_number() OVER o AS place
  FROM r WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST)
), f AS (
  SELECT *, ratio * weights <= rest AS is_full FROM l
), lv AS (
  SELECT rest, weights FROM f WHERE NOT is_full ORDER BY place LIMIT 1
), t AS (
  SELECT f.source, f.source_size,
    CASE WHEN f.is_full THEN 3.0 * f.source_size ELSE lv.rest::DOUBLE * f.weight / lv.weights END AS target
  FROM f LEFT JOIN lv ON true
), b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t
), p AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS prefix
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE
    (budget // source_size) * size + greatest(0, least(size, budget % source_size - prefix)) END)::BIGINT AS taken
FROM p
"""

_SAID = "list_transform({t}, lambda x: '<|start|>' || x.role || chr(10) || x.text || '<|end|>' || chr(10))"
_TEXT = "coalesce(array_to_string(" + _SAID + ", ''), '')"
_MASK = """coalesce((SELECT string_agg((e - length(t.text) - 8) || ':' || e, ',' ORDER BY i) FROM (
    SELECT i, t, sum(length(t.role) + length(t.text) + 18) OVER (ORDER BY i) AS e
    FROM (SELECT unnest({t}) AS t, generate_subscripts({t}, 1) AS i)) WHERE t.role = 'assistant'), '')"""

OP2 = f"""
WITH c AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen,
    {{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), g AS (
  SELECT pair_id, coalesce(list(t ORDER BY t) FILTER (WHERE chosen), []) AS a,
    coalesce(list(t ORDER BY t) FILTER (WHERE NOT chosen), []) AS b
  FROM c GROUP BY pair_id
), n AS (
  SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1),
    lambda i: a[i].role = b[i].role AND a[i].text = b[i].text), false) - 1, least(len(a), len(b)))::INTEGER AS n_common FROM g
), p AS (
  SELECT pair_id, n_common, a[1:n_common] AS common, a[n_common + 1:] AS ra, b[n_common + 1:] AS rb FROM n
)
SELECT pair_id, n_common, {_TEXT.format(t="common")} AS prompt, {_TEXT.format(t="ra")} AS chosen,
  {_TEXT.format(t="rb")} AS rejected, {_MASK.format(t="ra")} AS chosen_mask, {_MASK.format(t="rb")} AS rejected_mask
FROM p
"""

OP3 = f"""
WITH d AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), f AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first_doc FROM g
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM f, range(13) r(k) WHERE first_doc < doc_id
), kept AS (
  SELECT x.doc_id, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) x
  LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, {{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}} AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) t(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
    OR NOT regexp_matches(text, '\\p{{L}}')
    OR 10 * (length(text) - length(translate(text, '{{}}[]\\', ''))) > length(text)) AS kept
FROM b
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP10 = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)
), n AS (
  SELECT d.doc_id, count(s.gram) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), e AS (
  SELECT u, v FROM l UNION SELECT v, u FROM l
), reach AS (
  SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, e.v FROM reach JOIN e ON reach.r = e.u
), c AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""

OP11 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY k.r, k.doc_id
"""

# The checksum byte by byte, over a table of 256 entries made by its rule.
CRC = """
WITH RECURSIVE step(b, c, k) AS (
  SELECT b::BIGINT, b::BIGINT, 0 FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8
)"""


def crc32(text: str) -> str:
    """The unsigned checksum of the UTF-8 bytes of a SQL text; needs ``crc_table`` as table ``z``."""
    data = f"hex(encode({text}))"
    return (f"xor(list_reduce(list_transform(range(0, (len({data}) // 2)::BIGINT), lambda i: ('0x' || {data}[2 * i + 1:2 * i + 2])::BIGINT), "
            "lambda a, b: xor(a // 256, z.t[xor(a % 256, b) + 1]), 4294967295), 4294967295)")


OP12 = f"""{CRC}, r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), g AS (
  SELECT doc, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY 1, 2
), h AS (
  SELECT run, n, {crc32("doc || ':' || run")} AS h FROM g, crc_table z
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1
), v AS (
  SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3
), x AS (
  SELECT word, length(word) AS l, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
), p AS (
  SELECT DISTINCT a.word AS a, b.word AS b FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word
), f AS (
  SELECT a AS word, count(*) AS n_near, min({{'minus': -n, 'b': b}}) AS best FROM p JOIN v ON v.word = p.b GROUP BY a
), m AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN -best.minus >= 2 * v.n THEN best.b END AS form, CASE WHEN -best.minus >= 2 * v.n THEN -best.minus END AS form_n
  FROM v LEFT JOIN f USING (word)
), c(word, root) AS (
  SELECT word, coalesce(form, word) FROM m UNION SELECT c.word, m.form FROM c JOIN m ON m.word = c.root AND m.form IS NOT NULL
)
SELECT m.word, m.form, m.n, m.n_near, m.form_n, e.root
FROM m JOIN (SELECT c.word, c.root FROM c JOIN m ON m.word = c.root AND m.form IS NULL) e USING (word)
"""

def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _row_ways(state: str, onward: str, letter: str, kept: str) -> str:
    """Cheapest way from a state over one row, before insertions; ``kept`` gives the state after the row is kept, or NULL."""
    role = {"u": "user", "a": "assistant"}[letter]
    fault = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    way = lambda cost, edit, then, line: (
        f"{{'c': ({cost} + {then}.c)::BIGINT, 'e': '{edit}' || {then}.e, 't': list_concat({line}, {then}.t)}}")
    return _least(
        way("2", "D", state, "[]::VARCHAR[]"),
        f"CASE WHEN NOT gone AND {kept} THEN {way(fault, 'K', onward, '[line]')} END",
        f"CASE WHEN NOT gone THEN {way('1 + ' + fault, 'R', onward, chr(91) + repr(role + ':') + ' || text]')} END",
        *([f"CASE WHEN NOT gone AND initial = 's' THEN {way(fault, 'K', 's', '[line]')} END"] if state == "n" else []))


def _insert(then: str, role: str) -> str:
    return f"{{'c': {then}.c + 5, 'e': 'I' || {then}.e, 't': list_concat(['{role}:'], {then}.t)}}"


OP13 = f"""{CRC}, c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
  FROM conversations, crc_table z
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM c, range(2) r(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i FROM d
), f AS (
  SELECT *, role[1:1] AS initial, role || ':' || text AS line,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS met,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM o
), rows_ AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone FROM f
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE met NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM rows_ GROUP BY conv_id
), walk AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}} AS n,
    {{'c': 10::BIGINT, 'e': 'II', 't': ['user:', 'assistant:']::VARCHAR[]}} AS s, {{'c': 5::BIGINT, 'e': 'I', 't': ['assistant:']::VARCHAR[]}} AS u,
    {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}} AS a
  FROM sums
  UNION ALL
  SELECT conv_id, i, {_least("n", _insert("u", "user"))}, {_least("s", _insert("u", "user"))}, u, {_least("a", _insert("u", "user"))}
  FROM (
    SELECT conv_id, i, n, s, {_least("u", _insert("a", "assistant"))} AS u, a FROM (
      SELECT w.conv_id, r.i, {_row_ways("n", "u", "u", "initial = 'u'")} AS n, {_row_ways("s", "u", "u", "initial = 'u'")} AS s,
        {_row_ways("u", "a", "a", "initial = 'a'")} AS u, {_row_ways("a", "u", "u", "initial = 'u'")} AS a
      FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i - 1))
)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.n.c, 0)::BIGINT AS cost,
  coalesce(w.n.e, '') AS audit, sha256(coalesce(array_to_string(w.n.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM x.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND w.i = 1
"""

LLM_ORACLES = {
    "op1_source_mix": OP1, "op2_preference_pairs": OP2, "op3_substring_dedup": OP3, "op5_quality_rules": OP5,
    "op6_top_k": OP6, "op10_near_duplicates": OP10, "op11_line_dedup": OP11,
    "op12_spelling_variants": OP12, "op13_conversation_repair": OP13,
}
