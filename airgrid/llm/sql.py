"""DuckDB SQL of the training-data queries that SQL can express on whole tables.

Literals are written out here and not taken from the operators, so that a wrong
constant there shows.
"""

ORACLE: dict[str, str] = {}

ORACLE["op4_chat"] = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
convs AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn) AS body,
         list('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)
              ORDER BY turn) AS pieces
  FROM turns GROUP BY conv_id),
firsts AS (SELECT body, n, min(conv_id) AS conv_id, any_value(pieces) AS pieces FROM convs GROUP BY body, n),
prefixes AS (SELECT DISTINCT body[1:k] AS body FROM (SELECT body, unnest(range(1, n)) AS k FROM convs))
SELECT conv_id, CAST(0 AS BIGINT) AS part, n AS part_turns, n AS n_turns, array_to_string(pieces, '') AS rendered
FROM firsts WHERE body NOT IN (SELECT body FROM prefixes)
"""

ORACLE["op7_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
marks AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op9_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS hex, CAST(strlen(body) AS BIGINT) AS payload_bytes,
             max(page_id) OVER (PARTITION BY body) AS best FROM p),
bits AS (
  SELECT *, array_to_string([substr(
    '0000000100100011010001010110011110001001101010111100110111101111',
    4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4) for i in range(1, 41)], '') AS b FROM h)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         16 * CAST(substr(b, 5 * j + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * j + 2, 1) AS INT)
         + 4 * CAST(substr(b, 5 * j + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * j + 4, 1) AS INT)
         + CAST(substr(b, 5 * j + 5, 1) AS INT) AS INT), 1) for j in range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM bits
"""


def _canonical(text: str) -> str:
    """SQL of the canonical licence form of a text expression."""
    steps = [
        (r"\r", ""),
        (r"(?m)^[^\p{L}\p{N}\n]*(?:portions )?(?:copyright|\(c\)|©|all rights reserved)[^\n]*$", " "),
        (r"\b(sub)?licenc(e|es|ed|ing|ee|ees|or|ors)\b", r"\1licens\2"),
        (r"\b(author|organ|recogn|util|real|initial|final|maxim|minim|custom)is(e|es|ed|ing|ation|ations)\b", r"\1iz\2"),
        (r"\b(behavi|fav|col|hon|lab)our", r"\1or"),
        (r"\b(judg|acknowledg)ement", r"\1ment"),
        (r"\bfulfil(s|ment)?\b", r"fulfill\1"),
        (r"\bcopyright owner", "copyright holder"),
        (r"\bwhilst\b", "while"),
        (r"\bnon[ -]commercial", "noncommercial"),
        (r"\bper cent\b", "percent"),
        (r"\bsub[ -]licens", "sublicens"),
        (r"[^\p{L}\p{N}]+", " "),
    ]
    c = f"lower(coalesce({text}, ''))"
    for pattern, same in steps:
        c = f"regexp_replace({c}, '{pattern}', '{same}', 'g')"
    return f"trim({c})"


def _licenses() -> str:
    from airgrid.llm.licenses import KNOWN           # the looked-up texts are data of the query
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256({_canonical('text')}) AS digest, min(license_id) AS license_id
  FROM (VALUES {rows}) AS k(license_id, text) GROUP BY 1),
own AS (SELECT doc_id, sha256({_canonical('text')}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM own LEFT JOIN known USING (digest)
"""


ORACLE["op10_licenses"] = _licenses()

ORACLE["op12_merkle"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, row_number() OVER () AS rid,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents),
bits AS (
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
                          lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t
  FROM range(0, 256) r(b)),
crc AS (
  SELECT rid, xor(list_reduce([CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT) for i in range(1, strlen(CAST(doc_id AS VARCHAR)) + 1)],
                              lambda c, x: xor(c // 256, t[1 + (xor(c, x) % 256)]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM d, bits WHERE doc_id IS NOT NULL),
leaves AS (
  SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0
              THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered
  FROM d LEFT JOIN crc USING (rid)),
placed AS (
  SELECT *, coalesce('v' || lang, 'n') AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
nodes AS (
  SELECT g, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 8, max((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY g, level, pos // 8),
subroots AS (SELECT g, digest AS subroot, max(level) AS depth FROM nodes WHERE n = 1 GROUP BY g, digest),
tops AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM subroots),
upper AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM tops
  UNION ALL
  SELECT level + 1, pos // 8, max((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos))
  FROM upper WHERE n > 1 GROUP BY level, pos // 8),
roots AS (SELECT digest AS root FROM upper WHERE n = 1 LIMIT 1),
steps AS (
  SELECT a.g, a.level, a.pos,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS bef,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS aft
  FROM nodes a JOIN nodes b ON a.g = b.g AND a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY a.g, a.level, a.pos),
top_steps AS (
  SELECT a.level, a.pos,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS bef,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS aft
  FROM upper a JOIN upper b ON a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY a.level, a.pos),
paths AS (
  SELECT rid, list([bef, aft] ORDER BY lv) AS path FROM (
    SELECT p.rid, s.level AS lv, s.bef, s.aft
    FROM placed p JOIN steps s ON s.g = p.g AND s.pos = p.pos // CAST(pow(8, s.level) AS BIGINT)
    UNION ALL
    SELECT p.rid, t.depth + u.level, u.bef, u.aft
    FROM placed p JOIN tops t ON t.g = p.g JOIN top_steps u ON u.pos = t.pos // CAST(pow(8, u.level) AS BIGINT))
  GROUP BY rid),
folded AS (
  SELECT rid, tampered AS node, 1 AS k FROM placed
  UNION ALL
  SELECT f.rid, sha256(path[k][1] || node || path[k][2]), k + 1 FROM folded f JOIN paths USING (rid) WHERE k <= len(path)),
final AS (SELECT rid, arg_max(node, k) AS folded_root FROM folded GROUP BY rid)
SELECT p.doc_id, p.leaf, s.subroot, r.root,
       sha256(coalesce(array_to_string(list_transform(path, lambda x: x[1] || x[2]), ''), '')) AS proof_sha256,
       f.folded_root, f.folded_root = r.root AS verified
FROM placed p JOIN subroots s USING (g) CROSS JOIN roots r JOIN final f USING (rid) LEFT JOIN paths USING (rid)
"""
