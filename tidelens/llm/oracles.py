"""DuckDB SQL of the operators that SQL can express."""

MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM d GROUP BY source),
rounds AS (
  SELECT source, source_size, w, 1.5::DOUBLE * sum(source_size) OVER () AS budget, NULL::DOUBLE AS fixed, 0 AS k FROM s
  UNION ALL
  SELECT source, source_size, w, budget,
         CASE WHEN fixed IS NULL AND (budget - coalesce(sum(fixed) OVER (), 0)) * w / sum(CASE WHEN fixed IS NULL THEN w END) OVER () > 2.0 * source_size
              THEN 2.0::DOUBLE * source_size ELSE fixed END, k + 1
  FROM rounds WHERE k < 60),
last AS (SELECT * FROM rounds WHERE k = 60),
t AS (
  SELECT source, source_size,
         coalesce(fixed, (budget - coalesce(sum(fixed) OVER (), 0)) * w / sum(CASE WHEN fixed IS NULL THEN w END) OVER ()) AS target FROM last),
h AS (
  SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, ''))[1:15] AS h FROM d),
p AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size / 2 AS mid FROM h)
SELECT doc_id, size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
       (size * ((mid < round(target))::INT + (source_size + mid < round(target))::INT))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""

LINES = r"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM r),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS lost FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY rid
"""

LEAKS = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (
  SELECT item_id, least(len(w), 13) AS n, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS phrase
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM x),
g AS (
  SELECT rid, n, unnest([{'p': i, 'phrase': array_to_string(w[i:i + n - 1], ' ')} FOR i IN range(1, len(w) - n + 2)], recursive := true)
  FROM d, sizes WHERE len(w) >= n),
h AS (SELECT g.rid, g.n, g.p, x.item_id FROM g JOIN x ON g.n = x.n AND g.phrase = x.phrase),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS k FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN i ON d.rid = i.rid
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, sha1(html) AS h FROM p),
bits AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * g, 10))::BIGINT >> (35 - 5 * k)) & 31)::INT, 1), '' ORDER BY g, k) AS d
  FROM q, range(4) a(g), range(8) b(k) GROUP BY page_id)
SELECT q.page_id, octet_length(body)::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN last = q.page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> q.page_id THEN last END AS refers_to
FROM q JOIN bits ON q.page_id = bits.page_id
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 15 AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

LICENCES = r"""
WITH tpl(licence, text) AS (VALUES
  ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'), ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
  ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'), ('MIT', 'Released under the MIT License.')),
tt AS (SELECT licence, t, count(*) AS n FROM (SELECT licence, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM tpl) GROUP BY licence, t),
d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
         [coalesce(source, '-'), coalesce(lang, '-'), (doc_id // 1000)::VARCHAR] AS dirs FROM documents),
f AS (
  SELECT doc_id, text, array_to_string(dirs[1:CASE WHEN doc_id % 10 = 0 THEN (doc_id // 10) % 3 + 1 ELSE 3 END], '/') AS home,
         dirs[1:CASE WHEN doc_id % 10 = 0 THEN (doc_id // 10) % 3 + 1 ELSE 3 END] AS parts, doc_id % 10 = 0 AS speaks FROM d),
n AS (SELECT count(*) AS files FROM f),
df AS (
  SELECT t, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS t FROM f) WHERE t IN (SELECT t FROM tt) GROUP BY t),
idf AS (
  SELECT t, ln((1 + files) / (1 + coalesce(df, 0))) + 1 AS w FROM (SELECT DISTINCT t FROM tt) LEFT JOIN df USING (t), n),
tn AS (SELECT licence, sqrt(sum((n * w) * (n * w))) AS norm FROM tt JOIN idf USING (t) GROUP BY licence),
seg AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS part, unnest(string_split(text, chr(10))) AS line FROM f
  UNION ALL SELECT doc_id, -1, text FROM f WHERE speaks),
w AS (SELECT doc_id, part, t, count(*) AS n FROM (SELECT doc_id, part, unnest(regexp_extract_all(line, '[a-z0-9]+')) AS t FROM seg) GROUP BY ALL),
v AS (SELECT doc_id, part, t, w.n * coalesce(idf.w, ln(1 + files) + 1) AS x FROM w LEFT JOIN idf USING (t), n),
norms AS (SELECT doc_id, part, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL),
dots AS (SELECT doc_id, part, licence, sum(x * tt.n * idf.w / tn.norm) AS dot FROM v JOIN tt USING (t) JOIN idf USING (t) JOIN tn USING (licence) GROUP BY ALL),
m AS (SELECT doc_id, part, licence, round(dot / norm, 9) AS c FROM dots JOIN norms USING (doc_id, part) WHERE round(dot / norm, 9) >= 0.75),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY c DESC, licence) = 1),
own AS (
  SELECT doc_id, first(licence ORDER BY c DESC, licence) AS own, max(c) AS c, count(*) FILTER (WHERE part >= 0) AS n_lines FROM best GROUP BY doc_id),
spoken AS (SELECT home, first(licence ORDER BY c DESC, licence) AS licence FROM best JOIN f USING (doc_id) WHERE speaks GROUP BY home),
up AS (
  SELECT doc_id, k, spoken.home AS dir, spoken.licence FROM (SELECT doc_id, k, array_to_string(parts[1:k], '/') AS dir FROM f, range(0, 4) r(k) WHERE k <= len(parts)) u
  JOIN spoken ON u.dir = spoken.home),
near AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)
SELECT f.doc_id, f.home || CASE WHEN speaks THEN '/LICENSE-' || f.doc_id ELSE '/' || f.doc_id || '.txt' END AS path, own, round(c, 6) AS own_cosine,
       coalesce(n_lines, 0)::BIGINT AS n_lines, CASE WHEN own IS NULL THEN near.licence END AS inherited, CASE WHEN own IS NULL THEN near.dir END AS from_dir,
       coalesce(own, near.licence) AS licence
FROM f LEFT JOIN own ON f.doc_id = own.doc_id LEFT JOIN near ON f.doc_id = near.doc_id
"""

REPAIR = r"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
k AS (
  SELECT *, xor(4294967295, list_reduce(bytes, lambda c, b:
         list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))), 4294967295)) % 20 AS k FROM r),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
g AS (
  SELECT conv_id, i, turn, role, text, role[1] AS c, CASE WHEN t = '' THEN 'b' WHEN again THEN 'p' WHEN t[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, pair FROM f),
states(q, follows, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
e AS (
  SELECT 'D' AS edit, q, q AS into_q, 2 AS cost, NULL AS name FROM states
  UNION ALL SELECT 'K', q, CASE WHEN name IS NULL THEN 1 ELSE follows END, 0, name FROM (SELECT *, FALSE AS s FROM states UNION ALL SELECT 0, 1, NULL, TRUE)
  UNION ALL SELECT 'R', q, follows, 1, name FROM states),
ins AS (
  SELECT q, q AS into_q, 0 AS cost, '' AS edits, []::VARCHAR[] AS added FROM states
  UNION ALL SELECT q, follows, 5, 'I', [name || ':'] FROM states
  UNION ALL SELECT a.q, b.follows, 10, 'II', [a.name || ':', b.name || ':'] FROM states a JOIN states b ON a.follows = b.q),
moves AS (
  SELECT ins.q, e.into_q, ins.cost + e.cost AS cost, edits || edit AS edits, added, edit, e.name FROM ins JOIN e ON ins.into_q = e.q),
dp AS (
  SELECT conv_id, 0 AS i, 0 AS q, {'cost': 0, 'audit': ''} AS best, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL
  SELECT conv_id, i + 1, into_q, min(next) AS best, arg_min(out, next) AS lines FROM (
    SELECT dp.conv_id, dp.i, m.into_q, {'cost': dp.best.cost + m.cost + CASE WHEN fault = 't' AND edit <> 'D' THEN 5 ELSE 0 END, 'audit': dp.best.audit || m.edits} AS next,
           list_concat(dp.lines, m.added, CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [g.role || ':' || g.text] ELSE [m.name || ':' || g.text] END) AS out
    FROM dp JOIN g ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = dp.i + 1 JOIN moves m ON m.q = dp.q
    WHERE edit = 'D' OR fault NOT IN ('b', 'p') AND (edit = 'R' OR c = coalesce(m.name[1], 's')))
  GROUP BY conv_id, i, into_q),
ends AS (
  SELECT dp.conv_id, {'cost': best.cost + ins.cost, 'audit': best.audit || edits} AS best, list_concat(lines, added) AS lines
  FROM dp JOIN (SELECT conv_id, max(i) AS n FROM g GROUP BY conv_id) z ON dp.conv_id IS NOT DISTINCT FROM z.conv_id AND dp.i = z.n
  JOIN ins ON dp.q = ins.q AND (ins.into_q = 3 OR ins.into_q = 0)),
won AS (SELECT conv_id, min(best) AS best, arg_min(lines, best) AS lines FROM ends GROUP BY conv_id),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'p') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN won ON a.conv_id IS NOT DISTINCT FROM won.conv_id
"""


def _codes_sql(rounds: int = 4) -> str:
    """Codebook training in SQL: one pair of expressions a round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, part, min({{'d': list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v), 'e': c.e}}) AS best
  FROM x JOIN c{r} c USING (part) GROUP BY rid, part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT part, e, list(s ORDER BY pos) AS v FROM (
    SELECT part, best.e AS e, pos, floor(sum(y) / count(*)) AS s
    FROM (SELECT rid, part, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM x) JOIN a{r} USING (rid, part) GROUP BY part, best.e, pos) GROUP BY part, e),
c{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (part, e))""")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT rid, p AS part, q[p * len(q) // 4 + 1:(p + 1) * len(q) // 4] AS v FROM k, range(4) g(p)),
c0 AS (SELECT part, rid - 1 AS e, v FROM x WHERE rid <= 256),{",".join(steps)},
out AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
sha AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, e, pos)) AS h FROM (SELECT part, e, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN out USING (rid), sha
"""


CODES = _codes_sql()

MAIN_TEXT = r"""
WITH a AS (SELECT row_number() OVER () AS rid, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT rid, unnest(string_split(regexp_replace(body, '</?(p|h1)>', chr(0), 'g'), chr(0))) AS block,
             generate_subscripts(string_split(regexp_replace(body, '</?(p|h1)>', chr(0), 'g'), chr(0)), 1) AS pos FROM a),
t AS (
  SELECT rid, pos, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(block, '<br>', ' '), '</b>', ''), '<b>', ''), '&quot;', '"'),
         '&amp;?', '&', 'g'), '[ \t\n\r]+', ' ', 'g'), '^$', '')) AS block FROM b),
j AS (SELECT rid, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS text FROM t WHERE block <> '' GROUP BY rid)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM a LEFT JOIN j USING (rid)
"""
