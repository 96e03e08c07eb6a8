"""The queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline
from mapgauge.llm import chat, exact_dedup, langid, line_dedup, media, mixing, packing, simhash, substring_dedup, suffix_dedup

#: Repeated strings of 200 bytes in SQL, over hexadecimal digits.
SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
k AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 1400) AS part FROM (SELECT doc_id, n, h, unnest(range(0, n, 500)) AS c FROM d)),
u AS (SELECT doc_id, n, part AS h, c, unnest(range(c, least(c + 500, n))) AS pos FROM k),
s AS (SELECT doc_id, n, pos, substr(h, 2 * (pos - c) + 1, 2) AS b, CASE WHEN pos + 200 <= n THEN md5_number(substr(h, 2 * (pos - c) + 1, 400)) END AS w FROM u),
m AS (SELECT w FROM s WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1),
y AS (SELECT s.doc_id, s.pos, s.b, m.w IS NOT NULL AS hit FROM s LEFT JOIN m ON s.w = m.w),
z AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM y),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS edge FROM z),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE edge) AS n_spans, string_agg(b, '' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def queries() -> dict:
    return {
        "op1_chat": chat.op1_chat,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_language_id": langid.op4_language_id,
        "op5_media": media.op5_media,
        "op6_packing": packing.op6_packing,
        "op7_simhash": simhash.op7_simhash,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_mixing": mixing.op10_mixing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op2_suffix_dedup": SUFFIX_SQL, "op3_exact_dedup": exact_dedup.ORACLE, "op8_substring_dedup": substring_dedup.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
