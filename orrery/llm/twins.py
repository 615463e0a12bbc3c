"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from orrery.llm import secrets

_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"

TOPK = f"""WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, {_WHOLE} AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id AS vec_id, coalesce(list_inner_product(a.q, b.q), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.own <> b.own AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY own ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _matches() -> str:
    parts = []
    for k, (kind, pattern, group, least, fold) in enumerate(secrets.RULES):
        regex = ("(?i)" if fold else "") + secrets.RUNS.get(kind, pattern)
        held = f"regexp_extract(hit, {_text(regex)}, {group})" if group else "hit"
        parts.append(
            f"""SELECT doc_id, '{kind}' AS kind, {k} AS ord, start, start + length(hit) AS stop FROM (SELECT doc_id, unnest(hits) AS hit,
unnest(list_transform(range(1, len(hits) + 1), lambda k: list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda h: length(h))), 0)))::BIGINT AS start
FROM (SELECT doc_id, regexp_extract_all(text, {_text(regex)}) AS hits, string_split_regex(text, {_text(regex)}) AS gaps FROM t) WHERE len(hits) > 0) WHERE length({held}) >= {least}"""
        )
    return "\nUNION ALL ".join(parts)


_LIST = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord){0}, '')"
_BASE = "FILTER (kind IN ('assign', 'access', 'hex'))"
SECRETS = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({_matches()})
SELECT t.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)}, sha256({_LIST.format(" " + _BASE)}) AS base_sha256, {_LIST.format("")} AS spans FROM t LEFT JOIN m ON t.doc_id = m.doc_id GROUP BY t.doc_id"""

_SAID = r"\### Assistant: </turn> ok"
CHAT = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')) AS x(conv_id, turn, role, text)),
r AS (SELECT *, 4 + length(CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE '~' || role END) + 2
  + length(regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g')) + 9 AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars FROM r GROUP BY conv_id"""
