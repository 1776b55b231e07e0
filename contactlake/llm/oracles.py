"""Expected results in SQL for DuckDB, where SQL can express them.

Language, toxicity and main text are learned; the mixture bisects; SentencePiece
merges step by step. Those are tested against brute force and held-out rows.
"""

from __future__ import annotations

from contactlake.llm.common import LOWER, UPPER, WORD

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def reached(nodes: str, links: str) -> str:
    """``components(node, component)`` over ``links(a, b)`` in both directions."""
    return f"""reach(a, b) AS (
  SELECT node, node FROM ({nodes}) UNION SELECT reach.a, l.b FROM reach JOIN ({links}) l ON reach.b = l.a),
components AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""


NEAR = f"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
             FROM texts, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * pairs.n >= 75 * (p.n + q.n - pairs.n)),
{reached('SELECT doc_id AS node FROM documents', 'SELECT a, b FROM links')}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, doc_id = component AS kept
FROM documents JOIN components ON node = doc_id LEFT JOIN sizes USING (doc_id)"""

EXACT = f"""WITH texts AS (SELECT DISTINCT doc_id, {LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM texts"""


def repeats(units: str, key: str, window: int, name: str, kept: str) -> str:
    """Units of ``units(doc_id, pos, last, unit, ...)`` that a window with an earlier equal one covers."""
    return f"""{units},
starts AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY {key} ORDER BY doc_id, pos) > 1 AS again
           FROM units WHERE pos + {window - 1} <= last),
covered AS (SELECT u.doc_id, u.pos, u.unit,
                   coalesce(max(again) OVER (PARTITION BY u.doc_id ORDER BY u.pos ROWS {window - 1} PRECEDING), false) AS gone
            FROM units u LEFT JOIN starts s ON s.doc_id = u.doc_id AND s.pos = u.pos),
spans AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM covered),
counted AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
                   {kept} AS kept FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS {name}, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       coalesce(kept, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN counted USING (doc_id)"""


WORDS = repeats(
    f"""WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
units AS (SELECT doc_id, i AS pos, len(w) AS last, w[i] AS unit, array_to_string(w[i:i + 19], ' ') AS seq
          FROM texts, unnest(range(1, len(w) + 1)) AS t(i))""",
    "seq", 20, "n_words", "sha256(coalesce(string_agg(unit, ' ' ORDER BY pos) FILTER (NOT gone), ''))",
)

BYTES = repeats(
    """WITH texts AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
units AS (SELECT doc_id, i AS pos, length(h) // 2 AS last, substr(h, 2 * i - 1, 2) AS unit, md5(substr(h, 2 * i - 1, 200)) AS seq
          FROM texts, unnest(range(1, length(h) // 2 + 1)) AS t(i))""",
    "seq", 100, "n_bytes", "sha256(unhex(coalesce(string_agg(unit, '' ORDER BY pos) FILTER (NOT gone), '')))",
)

VECTORS = f"""WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y
          ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
{reached('SELECT vec_id AS node FROM embeddings', 'SELECT a, b FROM links')}
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings JOIN components ON node = vec_id LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)"""



def codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds written out: assignment ``a<i>`` by codebook ``c<i>``, which gives codebook ``c<i + 1>``."""
    steps = [f"""good AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM good, range({parts}) r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM good ORDER BY vec_id LIMIT {entries}))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min(d * {entries} + e) % {entries} AS e, min(d) AS d
  FROM (SELECT vec_id, label, p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM parts JOIN c{i} USING (p)) GROUP BY vec_id, p)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, len(x) + 1) r(i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    ctes = ",\n".join(steps)
    return f"""WITH {ctes},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book"""


CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda b: CAST(ord(b) AS BIGINT)),
  lambda a, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""

TRIE = f"""WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS d FROM conversations),
sizes AS (SELECT conv_id, count(*) AS n, {CRC} % 4 AS h, conv_id - conv_id % 20 AS base FROM turns GROUP BY conv_id),
convs AS (SELECT s.*, least(s.h, coalesce(b.n, 0)) AS taken FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
built AS (SELECT c.conv_id, t.d, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.d <= c.h
          UNION ALL SELECT c.conv_id, t.d - c.h + c.taken, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.d > c.h),
named AS (SELECT conv_id, d, text, string_agg(sha256(concat(length(role), ':', role, text)), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS node FROM built),
members AS MATERIALIZED (SELECT conv_id, d, md5(node) AS node, len(regexp_extract_all(text, '{WORD}')) AS words, md5(left(node, -64)) AS parent FROM named
          UNION ALL SELECT conv_id, 0, md5(''), 0, NULL FROM convs),
nodes AS MATERIALIZED (SELECT node, any_value(parent) AS parent, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(words) AS saving
          FROM members GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT m.node, count(*) FILTER (c.node IS NULL) AS n_leaves, CAST(sum(v.saving) AS BIGINT) AS saved_tokens
         FROM nodes v JOIN members m ON m.conv_id = v.conv_id AND m.d <= v.d LEFT JOIN children c ON c.node = v.node GROUP BY m.node),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
         FROM (SELECT conv_id, node FROM members QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY node)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes v LEFT JOIN nodes p ON p.node = v.parent LEFT JOIN children c ON c.node = v.node JOIN sums s ON s.node = v.node LEFT JOIN ends e ON e.node = v.node"""


ASKED = "</s>[INST] ok [/INST]"
ESCAPED = r"length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '</?s>|\[/?(?:INST|ROLE)\]'))"

CHAT = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '{ASKED}'), (-1, 1, 'assistant', '{ASKED}')),
sized AS (SELECT *, {ESCAPED.format('text')} + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + {ESCAPED.format('role')} END AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


ORACLES = {
    "op1_near_dedup": NEAR,
    "op3_exact_dedup": EXACT,
    "op5_substring_dedup": WORDS,
    "op6_embedding_dedup": VECTORS,
    "op10_suffix_array_dedup": BYTES,
    "op11_vector_codes": codes(),
    "op12_chat_format": CHAT,
    "op13_conversation_trie": TRIE,
}
