"""The queries of this subpackage and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, filter_audit, line_dedup, maxent, pack, quality_pu, quality_rules, resample, simhash, substring, token_counts, toxicity, warc

#: Words of a text as a DuckDB list.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, {WORDS} AS ws FROM documents),
lines AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
repeated AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
wins AS (SELECT doc_id, i, ws[i : i + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, w FROM wins GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT wins.doc_id, unnest([i, i + 1, i + 2]) AS p FROM wins JOIN twice ON wins.doc_id = twice.doc_id AND wins.w = twice.w) GROUP BY doc_id),
normal AS (SELECT source, text, doc_id, i, line, trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g')) AS norm FROM lines JOIN d USING (doc_id)),
hosts AS (SELECT source, count(DISTINCT text) AS host_documents FROM d GROUP BY source),
frequent AS (SELECT source, norm FROM normal JOIN hosts USING (source) WHERE norm <> '' GROUP BY source, norm, host_documents HAVING count(DISTINCT text) > {quality_rules.MIN_DOCUMENTS} AND (count(DISTINCT text) > {quality_rules.HOST_SHARE} * host_documents OR count(DISTINCT text) > {quality_rules.MANY})),
lost AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n_lost FROM normal JOIN frequent USING (source, norm) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(n_lost, 0))::BIGINT AS n_words_left
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= {quality_rules.LEAST_LEFT} * n_words AS kept, n_words_left FROM m
"""

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i : i + {substring.WINDOW - 1}], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {substring.WINDOW - 2})) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring.WINDOW})) AS i FROM later),
every AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Lower-cased words of a text for decontamination.
FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = rf"""
WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
s AS (SELECT doc_id, i, line, list_sort(list_distinct(regexp_extract_all(line, '[^ \t\x0B\f\r]+'))) AS ws FROM l),
c AS (SELECT ws, len(ws) AS n, min((doc_id, i)) AS first FROM s WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT first, n, unnest(ws) AS w FROM c),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
r AS (SELECT first, n, w, row_number() OVER (PARTITION BY first ORDER BY df, w) AS pos FROM t JOIN f USING (w)),
p AS (SELECT * FROM r WHERE pos <= n - (({line_dedup.NUM} * n + {line_dedup.DEN - 1}) // {line_dedup.DEN}) + 1),
pairs AS (SELECT DISTINCT a.first AS later, b.first AS earlier FROM p AS a JOIN p AS b ON a.w = b.w AND b.first < a.first AND {line_dedup.DEN} * least(a.n, b.n) >= {line_dedup.NUM} * greatest(a.n, b.n)),
gone AS (SELECT DISTINCT later FROM pairs JOIN c AS a ON a.first = later JOIN c AS b ON b.first = earlier
  WHERE {line_dedup.NUM + line_dedup.DEN} * len(list_intersect(a.ws, b.ws)) >= {line_dedup.NUM} * (a.n + b.n)),
stay AS (SELECT first FROM c WHERE first NOT IN (SELECT later FROM gone)),
m AS (SELECT doc_id, i, line, len(ws) = 0 OR first IS NOT NULL AS kept FROM s LEFT JOIN stay ON stay.first = (s.doc_id, s.i))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT kept)::BIGINT AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

OP9_SQL = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {FOLDED} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), {decontaminate.WINDOW}) AS width, array_to_string(ws[i : i + least(len(ws), {decontaminate.WINDOW}) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {decontaminate.WINDOW} + 2, 2))) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {FOLDED} AS ws FROM documents),
dw AS (SELECT doc_id, width, i, array_to_string(ws[i : i + width - 1], ' ') AS w
  FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT width FROM bw))),
found AS (SELECT doc_id, i, dw.width, item FROM dw JOIN bw ON dw.w = bw.w AND dw.width = bw.width),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""

OP5_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM h WHERE payload_bytes >= {warc.LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, h.payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM h LEFT JOIN f ON f.payload_digest = h.payload_digest
"""

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pack": pack.op1_pack,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_substring": substring.op3_substring,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_warc": warc.op5_warc,
    "op6_quality_pu": quality_pu.op6_quality_pu,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_resample": resample.op12_resample,
    "op13_maxent": maxent.op13_maxent,
}
ORACLE_SQL = {
    "op2_quality_rules": OP2_SQL,
    "op3_substring": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_resample": resample.OP12_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
