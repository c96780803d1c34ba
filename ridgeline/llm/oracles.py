"""SQL of the substring operators: all windows of whole texts, the later ones of each content, their runs."""


def _runs(width: int) -> str:
    """From later (doc_id, i): maximal runs a..b, and the gaps before each."""
    return f"""
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {width} THEN 0 ELSE 1 END AS fresh FROM later),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
runs AS (SELECT doc_id, k, min(i) AS a, max(i) + {width} AS b FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS z FROM runs)"""


SUFFIX = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS c FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY c ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
{_runs(100)},
kept AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS s, sum(b - a)::BIGINT AS gone, count(*) AS n FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(s, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

DEBRUIJN = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 20], ' ')) AS c FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY c ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
{_runs(20)},
kept AS (SELECT doc_id, list_concat(flatten(list(w[z + 1:a] ORDER BY k)), any_value(w)[max(b) + 1:]) AS s, sum(b - a)::BIGINT AS gone FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(array_to_string(coalesce(s, w), ' ')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
