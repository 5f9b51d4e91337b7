"""DuckDB SQL for the queries that SQL can express."""

from lettermark.llm.licenses import TEMPLATES

LINE_DEDUP = r"""
WITH own AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), windows AS (
  SELECT doc_id, text, i, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS w
  FROM (SELECT DISTINCT doc_id, text, lines FROM own), range(CAST(len(lines) - 2 AS BIGINT)) AS t(i)
), later AS (
  SELECT doc_id, text, i FROM windows WHERE regexp_matches(w, '[^\s]')
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, text, i + k AS i FROM later, range(3) AS t(k)
), numbered AS (
  SELECT r, doc_id, text, k AS i, lines[k + 1] AS line FROM own, range(CAST(len(lines) AS BIGINT)) AS t(k)
)
SELECT n.doc_id, coalesce(string_agg(n.line, chr(10) ORDER BY n.i) FILTER (g.i IS NULL), '') AS text,
  CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.i) AS BIGINT) AS n_removed
FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.text = g.text AND n.i = g.i
GROUP BY n.r, n.doc_id
"""

SOURCE_MIX = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sizes GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM totals
), filled AS (
  SELECT *, coalesce(sum(cap) OVER earlier, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS free
  FROM weighted WINDOW earlier AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), placed AS (
  SELECT *, (budget - CAST(caps AS DOUBLE)) * weight <= CAST(cap AS DOUBLE) * CAST(free AS DOUBLE) AS fits,
    (budget - CAST(caps AS DOUBLE)) / CAST(free AS DOUBLE) AS level
  FROM filled
), targets AS (
  SELECT source, rank, source_size, budget,
    CASE WHEN fits THEN (max(level) FILTER (fits) OVER ()) * weight ELSE CAST(cap AS DOUBLE) END AS target
  FROM placed
), positions AS (
  SELECT s.*, t.rank, t.source_size, t.target, t.budget,
    sum(size) OVER (PARTITION BY t.rank ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), queued AS (
  SELECT doc_id, size, budget, sum(size) OVER (
    ORDER BY CAST(turn * source_size + upto AS DOUBLE) / target, rank, turn, shuffled, doc_id, size ROWS UNBOUNDED PRECEDING
  ) AS total
  FROM positions, range(2) AS t(turn) WHERE size > 0
), taken AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM queued WHERE total <= budget GROUP BY doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0) AS taken
FROM positions p LEFT JOIN taken t USING (doc_id)
"""

# The templates of `licenses.TEMPLATES` are put in as (label, text) rows.
LICENSE_SCAN = r"""
WITH own AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT r, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word
  FROM (SELECT r, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM own)
), next AS (
  SELECT r, i, word, lead(word) OVER p AS word2, lead(word, 2) OVER p AS word3 FROM words WINDOW p AS (PARTITION BY r ORDER BY i)
), base AS (
  SELECT r, i, CASE WHEN word = 'cc' AND word2 = 'by' THEN 'cc-by' WHEN word = 'general' AND word2 = 'public' AND word3 = 'license' THEN 'gpl'
    WHEN word = 'all' AND word2 = 'rights' AND word3 = 'reserved' THEN 'reserved' END AS label FROM next
), templates AS (
  SELECT row_number() OVER () AS t, label, list_distinct(regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (VALUES {templates}) AS v(label, text)
), lines AS (
  SELECT r, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT r, string_split(text, chr(10)) AS l FROM own)
), line_words AS (
  SELECT DISTINCT r, line, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM lines
), met AS (
  SELECT r, line, label, count(*) / size AS containment
  FROM line_words JOIN (SELECT t, label, len(w) AS size, unnest(w) AS word FROM templates) USING (word)
  GROUP BY r, line, t, label, size HAVING 100 * count(*) >= 80 * size
), labels AS (
  SELECT r, label FROM base WHERE label IS NOT NULL UNION SELECT r, label FROM met
)
SELECT doc_id,
  CAST(coalesce((SELECT count(*) FROM words w WHERE w.r = own.r), 0) AS BIGINT) AS n_words,
  CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.low AS BIGINT) AS first_word, CAST(b.high AS BIGINT) AS last_word,
  coalesce(b.names, '') AS base_labels, coalesce(l.names, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.most, 0)::DOUBLE END AS score
FROM own
LEFT JOIN (SELECT r, count(*) AS n, min(i) AS low, max(i) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM base WHERE label IS NOT NULL GROUP BY r) b USING (r)
LEFT JOIN (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM labels GROUP BY r) l USING (r)
LEFT JOIN (SELECT r, max(containment) AS most FROM met GROUP BY r) m USING (r)
""".replace("{templates}", ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES))

FILL_IN_MIDDLE = r"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS third, CAST('0x' || h[25:32] AS BIGINT) % 100 AS fourth
  FROM own
), formed AS (
  SELECT doc_id, text, n, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR third >= 90 THEN 'plain'
      WHEN fourth < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END AS output
  FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN split_part(split_part(output, '<P>', 2), '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<P>', 1) END) AS restored_sha256
FROM made
"""

# Every window of 100 bytes by its hexadecimal text; long texts are first cut into stretches that overlap by 99 bytes.
SUFFIX_DEDUP = r"""
WITH own AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), stretches AS MATERIALIZED (
  SELECT r, c * 500 AS pos, substr(h, CAST(c * 1000 + 1 AS BIGINT), 1198) AS s FROM own, range(CAST(len(h) // 1000 + 1 AS BIGINT)) AS t(c)
), windows AS MATERIALIZED (
  SELECT r, pos + i AS pos, md5(substr(s, CAST(2 * i + 1 AS BIGINT), 200)) AS w FROM stretches, range(CAST(least(500, len(s) // 2 - 99) AS BIGINT)) AS t(i)
), later AS (
  SELECT r, pos FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY r, pos) > 1
), runs AS (
  SELECT r, pos, sum(CASE WHEN pos <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY pos) AS run
  FROM (SELECT r, pos, coalesce(lag(pos) OVER (PARTITION BY r ORDER BY pos), -1000) AS before FROM later)
), spans AS (
  SELECT r, run, min(pos) AS low, max(pos) + 100 AS high FROM runs GROUP BY r, run
), kept AS (
  SELECT r, low, substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (low - before) AS BIGINT)) AS part
  FROM (SELECT *, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM (
    SELECT r, low, high FROM spans UNION ALL SELECT r, len(h) // 2, len(h) // 2 FROM own)) JOIN own USING (r)
)
SELECT o.doc_id, CAST(len(o.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(s.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.rest)) AS kept_sha256
FROM own o
LEFT JOIN (SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r) s USING (r)
LEFT JOIN (SELECT r, string_agg(part, '' ORDER BY low) AS rest FROM kept GROUP BY r) k USING (r)
"""

_ASSIGN = r"""
near{k} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k := k)) AS best
  FROM parts JOIN book{k} USING (p) GROUP BY r, p
)"""
_RECENTRE = r"""
book{n} AS MATERIALIZED (
  SELECT p, k, coalesce(c, e) AS e FROM book{k} LEFT JOIN (
    SELECT p, k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT p, best.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM parts JOIN near{k} USING (r, p), range(1, 5) AS t(i) GROUP BY ALL) GROUP BY p, k
  ) USING (p, k)
)"""
VECTOR_CODES = (
    r"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v)))
), parts AS MATERIALIZED (
  SELECT r, vec_id, label, p, x[4 * p + 1 : 4 * p + 4] AS v FROM kept, range(16) AS t(p)
), book0 AS MATERIALIZED (SELECT p, r - 1 AS k, v AS e FROM parts WHERE r <= 64),"""
    + ",".join([_ASSIGN.replace("{k}", "0"), _RECENTRE.replace("{k}", "0").replace("{n}", "1"), _ASSIGN.replace("{k}", "1"), _RECENTRE.replace("{k}", "1").replace("{n}", "2"), _ASSIGN.replace("{k}", "2")])
    + r""", coded AS (
  SELECT r, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near2 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(e[i] AS VARCHAR), ',' ORDER BY p, k, i)) FROM book2, range(1, 5) AS t(i)) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""
)

SQL = {
    "op6_license_scan": LICENSE_SCAN,
    "op1_line_dedup": LINE_DEDUP,
    "op8_source_mix": SOURCE_MIX,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op12_suffix_dedup": SUFFIX_DEDUP,
    "op13_vector_codes": VECTOR_CODES,
}
