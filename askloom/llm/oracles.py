"""DuckDB SQL for the corpus operators that SQL can express."""

from askloom.llm.url_filter import SUFFIXES

_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 15))::BIGINT AS mix_key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget
  FROM totals),
ordered AS (
  SELECT *, cap / weight AS per_weight,
         budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighted),
flagged AS (SELECT *, cap * weight_left <= rest * weight AS capped FROM ordered),
first_open AS (SELECT rest AS open_rest, weight_left AS open_weight FROM flagged WHERE NOT capped ORDER BY per_weight, source NULLS LAST LIMIT 1),
aims AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * open_rest / open_weight END AS target
  FROM flagged LEFT JOIN first_open ON true),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole,
         round(target)::BIGINT AS aim FROM aims),
running AS (
  SELECT s.doc_id, s.size, s.source, p.source_size, p.target, p.whole, p.aim - p.whole * p.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mix_key, s.doc_id NULLS FIRST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source, source_size, target,
       (size * whole + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM running
"""

OP9 = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 WHEN quality IS NULL THEN NULL ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id),
named AS (
  SELECT host, sum(coalesce(bad, 0))::DOUBLE AS bad, count(bad)::DOUBLE AS n, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS name
  FROM parts LEFT JOIN outcomes USING (page_id) GROUP BY host),
labels_of AS (
  SELECT *, regexp_matches(name, '^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$') AS address, regexp_extract(name, '[^.]*$', 0) AS one, regexp_extract(name, '(?:[^.]*\.){0,1}[^.]*$', 0) AS two, regexp_extract(name, '(?:[^.]*\.){0,2}[^.]*$', 0) AS three FROM named),
hosts AS (
  SELECT host, bad, n, CASE WHEN address THEN name WHEN two IN (@SUFFIXES@) THEN three ELSE two END AS domain, CASE WHEN address THEN name WHEN two IN (@SUFFIXES@) THEN two ELSE one END AS suffix FROM labels_of),
top AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS rate FROM hosts),
s0 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n, any_value(top.rate) AS prior FROM hosts, top GROUP BY suffix),
s1 AS (SELECT greatest(2.0, 1 / least(0.5, greatest(0.001, coalesce((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.001))) - 1) AS k FROM s0 WHERE n > 0),
suffixes AS (SELECT suffix, (bad + k * prior) / (n + k) AS rate FROM s0, s1),
d0 AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n, any_value(suffixes.rate) AS prior FROM hosts JOIN suffixes USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT greatest(2.0, 1 / least(0.5, greatest(0.001, coalesce((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.001))) - 1) AS k FROM d0 WHERE n > 0),
domains AS (SELECT domain, (bad + k * prior) / (n + k) AS rate FROM d0, d1),
h0 AS (SELECT host, bad, n, domains.rate AS prior FROM hosts JOIN domains USING (domain)),
h1 AS (SELECT greatest(2.0, 1 / least(0.5, greatest(0.001, coalesce((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.001))) - 1) AS k FROM h0 WHERE n > 0),
post AS (SELECT host, bad + k * prior AS a, n - bad + k * (1 - prior) AS b FROM h0, h1),
bound AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM post),
limits AS (SELECT 2.0::DOUBLE * rate / (1 - rate) / (1 + 2.0::DOUBLE * rate / (1 - rate)) AS most FROM top),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hits AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM parts) p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, hits.rule, coalesce(hits.verdict, CASE WHEN bound.lower > (SELECT most FROM limits) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN bound USING (host)
LEFT JOIN hits ON hits.page_id IS NOT DISTINCT FROM p.page_id AND hits.host = p.host AND hits.path = p.path
"""

OP11 = r"""
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
sizes AS (SELECT count(*)::BIGINT AS docs, sum(len(words))::BIGINT AS total FROM terms WHERE len(words) > 0),
asked AS (
  SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
items AS (SELECT item_id, text, term, count(*)::BIGINT AS times FROM asked GROUP BY ALL),
used AS (SELECT row, unnest(words) AS term FROM terms),
counts AS (SELECT row, term, count(*)::BIGINT AS tf FROM used GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sizes GROUP BY term, docs),
scored AS (
  SELECT i.item_id, i.text, c.row, sum(i.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 75 + (75 * len(t.words) * s.docs) // s.total))))::BIGINT AS score
  FROM items i JOIN counts c USING (term) JOIN weights w USING (term) JOIN terms t ON t.row = c.row, sizes s
  GROUP BY i.item_id, i.text, c.row),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM scored JOIN terms USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13 = r"""
WITH RECURSIVE rounds(k, i, c) AS (
  SELECT 0, range, range::UINTEGER FROM range(256)
  UNION ALL
  SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM rounds WHERE k < 8),
crc(t) AS (SELECT list(c ORDER BY i) FROM rounds WHERE k = 8),
texts AS (
  SELECT doc_id, true AS corpus, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
numbered AS (SELECT row_number() OVER () AS row, doc_id, corpus, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
used AS (SELECT row, corpus, unnest(words) AS word FROM numbered),
counted AS (SELECT row, corpus, word, count(*) AS n FROM used GROUP BY ALL),
hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(strlen(word)), lambda i : ('0x' || substr(hex(encode(word)), 2 * i::INT + 1, 2))::UINTEGER),
                               lambda c, b : xor(t[(xor(c, b) & 255)::INT + 1], c >> 8), 4294967295::UINTEGER), 4294967295::UINTEGER)::BIGINT % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM counted), crc),
bags AS (SELECT row, corpus, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (word) GROUP BY ALL),
shares AS (
  SELECT bucket, coalesce(sum(n) FILTER (corpus), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT corpus), 0)::DOUBLE AS t FROM bags GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM shares),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM shares, sums),
sizes AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM bags JOIN gains USING (bucket) WHERE corpus GROUP BY row),
weighed AS (
  SELECT row, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, len(words) AS n_words,
         CASE WHEN n_features > 0 THEN (total - ((total % n_features + n_features) % n_features)) // n_features ELSE 0 END::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM numbered LEFT JOIN sizes USING (row) WHERE corpus),
scored AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= 10 * (SELECT count(*) FROM placed WHERE n_words >= 20) // 100 THEN place END::BIGINT AS rank
FROM placed
"""

ORACLES = {"op1_mix_sources": OP1, "op9_url_reputation": OP9.replace("@SUFFIXES@", _SUFFIXES), "op11_lemp_search": OP11, "op13_bit_sliced_resampling": OP13}
