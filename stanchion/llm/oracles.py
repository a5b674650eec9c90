"""DuckDB SQL for the queries that SQL can express.

Not here, and tested against brute force or round trips instead: license_scan's own notices,
toxicity, token output, SentencePiece, vector search (approximate), the upsert (files) and the pipeline.
"""

from __future__ import annotations

_MIX = """
WITH RECURSIVE n AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n,
         md5('mix-doc-' || coalesce(doc_id::VARCHAR, 'null')) AS dh, md5('mix-block-' || coalesce(doc_id::VARCHAR, 'null')) AS bh
  FROM documents),
own AS (SELECT source, count(*) AS docs, sum(n)::DOUBLE AS tokens, ceil(sqrt(count(*)))::BIGINT AS blocks FROM n GROUP BY source),
p AS (SELECT tokens / sum(tokens) OVER () AS p FROM own WHERE tokens > 0),
ends AS (SELECT sum(-p * ln(p)) AS h1, ln(count(*)) AS h0, max(p) / min(p) AS spread, max(p) AS top FROM p),
bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END,
         CASE WHEN up2 THEN (lo2 + hi2) / 2 ELSE lo2 END, CASE WHEN up2 THEN hi2 ELSE (lo2 + hi2) / 2 END
  FROM (SELECT b.*, (SELECT ln(sum(pow(p, (b.lo + b.hi) / 2))) - (b.lo + b.hi) / 2 / sum(pow(p, (b.lo + b.hi) / 2)) * sum(pow(p, (b.lo + b.hi) / 2) * ln(p)) FROM p)
                    >= e.h1 + 0.5 * (e.h0 - e.h1) AS up, pow(e.spread, 1 - (b.lo2 + b.hi2) / 2) > 4.0 AS up2
        FROM bisect b, ends e WHERE b.i < 40)),
a AS (SELECT greatest(hi, hi2) AS a FROM bisect WHERE i = 40),
z AS (SELECT any_value(a) AS a, sum(pow(p, a)) AS z FROM p, a),
w AS (
  SELECT o.source, o.tokens, o.blocks,
         CASE WHEN o.tokens > 0 THEN pow(o.tokens / t.total, z.a) / z.z ELSE 0 END AS weight, t.total * z.z * pow(e.top, 1 - z.a) AS budget
  FROM own o, z, ends e, (SELECT sum(tokens) AS total FROM own) t),
goal AS (SELECT *, floor(weight * budget + 1e-6)::BIGINT AS goal FROM w),
told AS (SELECT *, CASE WHEN tokens > 0 THEN floor(goal / tokens)::BIGINT ELSE 1 END AS epochs FROM goal),
placed AS (
  SELECT n.*, t.weight, t.epochs, CASE WHEN t.tokens > 0 THEN goal - epochs * tokens ELSE 0 END AS rest,
         md5('mix-order-' || ((('0x' || substr(bh, 1, 8))::BIGINT % t.blocks)::VARCHAR)) AS block
  FROM n JOIN told t ON n.source IS NOT DISTINCT FROM t.source),
upto AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY block, dh RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
SELECT doc_id, source, round(weight, 6) AS weight, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM upto
"""

_SUBSTRING = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS k FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM k),
gone AS (SELECT doc_id, list(DISTINCT i + o.o) AS gone FROM r, (SELECT unnest(range(0, 20)) AS o) o WHERE nth > 1 GROUP BY doc_id),
j AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN gone USING (doc_id)),
u AS (SELECT doc_id, len(w) AS n, len(gone) AS m, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word, unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(1, len(w) + 1) END) AS i FROM j),
g AS (SELECT doc_id, unnest(gone) AS i, true AS hit FROM j)
SELECT u.doc_id, any_value(u.n)::BIGINT AS n_words, any_value(u.m)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(u.word, ' ' ORDER BY u.i) FILTER (WHERE g.hit IS NULL AND u.word IS NOT NULL), '')) AS kept_sha256
FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id
"""

_JACCARD = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + 4], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS c FROM edge UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.doc_id),
low AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.c, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


_SEARCH = """
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM w GROUP BY 1, 2),
n AS (SELECT count(*)::DOUBLE AS n, (SELECT count(*) FROM w)::DOUBLE / count(*) AS mean FROM documents),
len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len.len / n.mean))) AS score
  FROM tf q JOIN tf d ON q.t = d.t AND q.doc_id % 100 = 0 AND q.doc_id <> d.doc_id JOIN df ON df.t = q.t JOIN len ON len.doc_id = d.doc_id, n GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10
"""

_LM = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents),
u AS (SELECT doc_id, good, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
p AS (SELECT doc_id, good, w, coalesce(lag('w' || w) OVER (PARTITION BY doc_id ORDER BY i), '<s>') AS h FROM u),
one AS (SELECT w, count(*) AS b, count(*) FILTER (WHERE good) AS t FROM u GROUP BY 1),
bi AS (SELECT h, w, count(*) AS b, count(*) FILTER (WHERE good) AS t FROM p GROUP BY 1, 2),
tot AS (SELECT sum(b)::DOUBLE AS b, sum(t)::DOUBLE AS t, count(*) + 2 AS size FROM one),
ctx AS (SELECT h, sum(b)::DOUBLE AS b, sum(t)::DOUBLE AS t FROM bi GROUP BY 1),
l AS (
  SELECT p.doc_id,
         -ln((bi.b + 20 * (one.b + 1) / (tot.b + tot.size)) / (ctx.b + 20)) AS b,
         -ln((bi.t + 20 * (one.t + 1) / (tot.t + tot.size)) / (ctx.t + 20)) AS t
  FROM p JOIN one ON one.w = p.w JOIN bi ON bi.h = p.h AND bi.w = p.w JOIN ctx ON ctx.h = p.h, tot),
a AS (SELECT doc_id, count(*) AS n, avg(b) AS b, avg(t) AS t FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_tokens, round(a.t, 6) AS loss_target, round(a.b, 6) AS loss_background, round(a.t - a.b, 6) AS score FROM d LEFT JOIN a USING (doc_id)
"""

#: crc32 byte by byte over a table of 256 values, of each different word.
_IMPORTANCE = """
WITH RECURSIVE steps AS (
  SELECT v::BIGINT AS v, v::BIGINT AS c, 0 AS k FROM range(256) t(v)
  UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY v) AS t FROM steps WHERE k = 8),
texts AS (
  SELECT true AS own, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT false, 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
counts AS (SELECT own, r, word, count(*) AS n FROM (SELECT own, r, unnest(w) AS word FROM texts) GROUP BY ALL),
words AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM counts)),
crcs AS (
  SELECT word, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM words, tab),
cells AS (SELECT own, r, bucket, sum(n)::BIGINT AS n FROM counts JOIN crcs USING (word) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::BIGINT AS t FROM cells GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((a.t + 1) * (b.s + 10000))::DOUBLE / ((a.s + 1) * (b.t + 10000))::DOUBLE))::BIGINT AS gain
  FROM sums a, (SELECT coalesce(sum(s), 0)::BIGINT AS s, coalesce(sum(t), 0)::BIGINT AS t FROM sums) b),
weights AS (SELECT r, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM cells JOIN gains USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts d LEFT JOIN weights USING (r) WHERE d.own),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM placed
"""

#: All pairs; tables of up to one window of vectors are compared whole.
_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT x.a, l.b FROM reach x JOIN links l ON x.b = l.a),
least AS (SELECT x.a AS r, min(y.vec_id) AS c FROM reach x JOIN v y ON x.b = y.r GROUP BY x.a),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.c AS component_id, coalesce(v.vec_id = l.c, l.c IS NULL) AS kept FROM v LEFT JOIN degree d USING (r) JOIN least l USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": _SEARCH, "op6_lm_scoring": _LM, "op3_source_mixing": _MIX, "op8_substring_dedup": _SUBSTRING, "op10_ngram_jaccard_join": _JACCARD, "op12_importance_resampling": _IMPORTANCE, "op13_embedding_dedup": _EMBEDDINGS}
