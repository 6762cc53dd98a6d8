"""DuckDB SQL for the registered queries of this subpackage that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?([A-Za-z0-9+/_.=-]+)"
)


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a AS start_at, a + length(m) AS end_at
    FROM (
      SELECT doc_id, ms[i] AS m, gs[i] AS g,
             list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a
      FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}', 0) AS ms,
                   regexp_extract_all(t, '{pattern}', {group}) AS gs
            FROM d WHERE regexp_matches(t, '{pattern}')) p, unnest(range(1, len(ms) + 1)) AS u(i)
    ) WHERE length(g) >= {least}"""


SQL["op2_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans("assign", 1, _ASSIGN, 2, 12)}
    UNION ALL {_spans("access", 2, "AKIA[A-Z0-9]+", 0, 18)}
    UNION ALL {_spans("hex", 3, "[0-9a-f]+", 0, 16)}),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(CAST(start_at AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(end_at AS BIGINT) AS VARCHAR), ',' ORDER BY start_at, rank) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""

SQL["op5_exact_top_k"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.ints, c.ints), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.ints) = len(c.ints) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SQL["op8_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

SQL["op7_preference_formatting"] = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
replies AS (
  SELECT conv_id, turn AS last_turn, coalesce(text, '') AS reply,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(text, '') DESC) AS k
  FROM c WHERE role = 'assistant'
), last AS (SELECT * FROM replies WHERE k = 1),
sides AS (
  SELECT conv_id, 'chosen' AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
  UNION
  SELECT c.conv_id, 'rejected', c.turn, coalesce(c.role, ''),
         CASE WHEN c.turn = own.last_turn AND c.role = 'assistant' THEN coalesce(other.reply, '') ELSE coalesce(c.text, '') END
  FROM c LEFT JOIN last own ON c.conv_id = own.conv_id LEFT JOIN last other ON xor(c.conv_id, 1) = other.conv_id
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS INTEGER) AS position FROM sides
), firsts AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, min(coalesce(a.position, b.position)) AS first
  FROM (SELECT * FROM placed WHERE side = 'chosen') a
  FULL JOIN (SELECT * FROM placed WHERE side = 'rejected') b ON a.conv_id = b.conv_id AND a.position = b.position
  WHERE a.conv_id IS NULL OR b.conv_id IS NULL OR a.role <> b.role OR a.text <> b.text
  GROUP BY 1
), parts AS (
  SELECT p.*, first, CASE WHEN first IS NULL OR position < first THEN 'prompt' ELSE side END AS part
  FROM placed p LEFT JOIN firsts USING (conv_id)
), rendered AS (
  SELECT *, '<|im_start|>' || role || chr(10) AS header, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS segment
  FROM parts WHERE part <> 'prompt' OR side = 'chosen'
)
SELECT conv_id, part, position, role, sha256(segment) AS segment_sha256,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN CAST(length(header) AS INTEGER) END AS trained_from,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN CAST(length(segment) AS INTEGER) END AS trained_to
FROM rendered
"""

SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
shape AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
full_table AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.total + 2 * s.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (s.total + 2 * s.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN shape s USING (lang) JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM full_table a JOIN full_table b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM full_table WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# Each state keeps its best edits as one text, cost first, so that the least text is the cheapest and then the first in
# order of letters; the states are none, system, user and assistant (n, s, u, a).
SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS tab
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), kinds AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, role, text,
         xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT),
             4294967295) % 20 AS kind
  FROM raw, crc_table
), damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[ \t-\r]+$', '') AS shown FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS x,
         CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), flags AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faulty),
best AS (
  SELECT conv, 0::BIGINT AS i, '000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT conv FROM flags)
  UNION ALL
  SELECT conv, i,
         more(n, 4, 'D'),
         least(more(s, 4, 'D'), CASE WHEN NOT gone AND x = 's' THEN more(n, extra, 'K') END),
         least(more(u, 4, 'D'), CASE WHEN gone THEN NULL WHEN x = 'u' THEN more(least(n, s, a), extra, 'K') ELSE more(least(n, s, a), 3 + extra, 'R') END),
         least(more(a, 4, 'D'), CASE WHEN gone THEN NULL WHEN x = 'a' THEN more(u, extra, 'K') ELSE more(u, 3 + extra, 'R') END)
  FROM (
    SELECT conv, i, x, gone, extra, n, s, u, least(a, more(u, 3, 'I')) AS a
    FROM (SELECT b.conv, f.i, x, gone, extra, n, s, least(u, more(least(n, s, a), 3, 'I')) AS u, a FROM best b JOIN flags f ON f.conv = b.conv AND f.i = b.i + 1)
  )
), ended AS (
  SELECT conv, i, least(n, a, more(u, 3, 'I'), more(least(n, s), 6, 'II')) AS coded FROM best
), audits AS (
  SELECT conv, CAST(left(coded, 6) AS BIGINT) AS cost, substr(coded, 7) AS audit FROM ended QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1
), letters AS (
  SELECT conv, j, audit[j] AS letter, length(replace(audit[1:j], 'I', '')) AS i FROM audits, unnest(range(1, length(audit) + 1)) AS t(j)
), written AS (
  SELECT l.conv, j, letter, f.role, f.text, f.x, row_number() OVER (PARTITION BY l.conv ORDER BY j) AS place,
         first_value(letter = 'K' AND f.x = 's') OVER (PARTITION BY l.conv ORDER BY j) AS with_system
  FROM letters l LEFT JOIN flags f ON f.conv = l.conv AND f.i = l.i AND letter <> 'I' WHERE letter <> 'D'
), lines AS (
  SELECT conv, place, CASE WHEN letter = 'K' THEN role WHEN (place - CAST(with_system AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                      || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END AS line
  FROM written
), digests AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY place)) AS digest FROM lines GROUP BY conv),
pairs AS (SELECT *, lag(x) OVER (PARTITION BY conv ORDER BY i) || x AS pair FROM flags),
sums AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv FROM conversations) c
LEFT JOIN sums USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN digests USING (conv)
"""


def _written_out(sql: str) -> str:
    """``more(x, cost, letters)`` as an expression: cost added to the number in front, letters behind."""
    while (at := sql.find("more(")) >= 0:
        depth, parts, start = 0, [], at + 5
        for end in range(at + 5, len(sql)):
            if sql[end] == "(":
                depth += 1
            elif sql[end] == ")" and depth:
                depth -= 1
            elif sql[end] in "),"  and not depth:
                parts.append(sql[start:end].strip())
                start = end + 1
                if sql[end] == ")":
                    break
        x, cost, letters = parts
        sql = f"{sql[:at]}(lpad(CAST(CAST(left({x}, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({x}, 7) || {letters}){sql[end + 1 :]}"
    return sql


SQL["op13_conversation_repair"] = _written_out(SQL["op13_conversation_repair"])
