"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, s, s + least(len(w), 10) - 1) AS g
       FROM i, LATERAL unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS x(s) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, s, list_slice(w, s, s + k - 1) AS g
       FROM d, ks, LATERAL unnest(generate_series(1, len(w) - k + 1)) AS x(s)),
m AS (SELECT r, dw.k, s, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, k, s FROM m) AS q, LATERAL unnest(generate_series(s, s + k - 1)) AS y(p) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS sha FROM (SELECT DISTINCT r, item_id FROM m) AS q GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP4 = r"""
WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r(h, s, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, h || s AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC) AS k
      FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN f ON q.page_id = f.page_id AND k = 1
"""

OP7 = r"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS speaker, regexp_replace(coalesce(text, ''), '<(\|im_(?:start|end)\|>)', '<' || chr(8203) || '\1', 'g') AS said,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
s AS (SELECT t.conv_id, participant, place, speaker = participant AS trained,
             '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant'
               ELSE 'user name=' || regexp_replace(regexp_replace(speaker, '<(\|im_(?:start|end)\|>)', '<' || chr(8203) || '\1', 'g'), '[\r\n]', ' ', 'g') END || chr(10) AS head, said
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
u AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS rendered FROM s),
v AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, participant ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM u)
SELECT conv_id, participant, place, rendered, start, start + length(rendered) AS "end",
       CASE WHEN trained THEN start + length(head) END AS mask_start, CASE WHEN trained THEN start + length(rendered) - 1 END AS mask_end
FROM v
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3, "op4_urls": OP4, "op7_chat": OP7}
