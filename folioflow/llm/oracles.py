"""The queries of this subpackage in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .chat import ANSWERED, ASKED, CONTROL, NAME_END, NAMED

WARC = """
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN repeated THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN repeated THEN newest END AS refers_to
FROM (SELECT *, strlen(payload) >= 1000 AND page_id < newest AS repeated
      FROM (SELECT page_id, coalesce(html, '') AS payload,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest
            FROM pages))
"""

VECTORS = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a
), roots AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    tails = "|".join(c[1:].replace("[", r"\[").replace("]", r"\]") for c in CONTROL)
    return f"regexp_replace({column}, '([<\\[])(\\\\*(?:{tails}))', '\\1\\\\\\2', 'g')"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL
  SELECT -7, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) t(i)
), formatted AS (
  SELECT *, CASE role
    WHEN 'assistant' THEN {_literal(ANSWERED[0])} || {_escaped("text")} || {_literal(ANSWERED[1])}
    WHEN 'user' THEN {_literal(ASKED[0])} || {_escaped("text")} || {_literal(ASKED[1])}
    ELSE {_literal(NAMED[0])} || {_escaped("role")} || {_literal(NAME_END)}
      || {_escaped("text")} || {_literal(NAMED[1])} END AS whole
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(length(whole))::BIGINT AS formatted_chars
FROM formatted GROUP BY conv_id
"""

AUDIT = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS found
  FROM documents
), failed AS (
  SELECT doc_id, part,
    [CASE WHEN len(found) < 200 THEN 'A' END,
     CASE WHEN 100 * len(list_distinct(found)) < 50 * len(found) THEN 'B' END,
     CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)
          THEN 'C' END,
     CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
     CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END] AS fails
  FROM words
), marked AS (
  SELECT part, list_filter(fails, lambda f: f IS NOT NULL) AS fails,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM failed
), sets AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good,
         count(*) FILTER (toxic) AS toxic
  FROM marked GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o
  FROM letters a JOIN letters b ON b.f <> a.f
  JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f)
  JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (
  SELECT array_to_string(o, '') AS filter_order, step::INT AS step, o[step] AS f,
         o[1:step - 1] AS before
  FROM orders, range(1, 6) t(step)
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT list_has_any(fails, before) AND NOT list_contains(fails, f)
        THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT list_has_any(fails, before) AND list_contains(fails, f)
        THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_has_any(fails, before) AND list_contains(fails, f)
        THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = [f] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT list_has_any(fails, before) AND list_contains(fails, f)
        THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT list_has_any(fails, before) AND list_contains(fails, f)
        THEN toxic ELSE 0 END) AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""

ORACLES: dict[str, str] = {
    "op2_warc": WARC,
    "op4_vectors": VECTORS,
    "op11_chat": CHAT,
    "op12_audit": AUDIT,
}
