"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH squeezed AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM squeezed
"""


DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, w, least(13, len(w)) AS n
  FROM (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
        FROM benchmark)
  WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)
), lens AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS phrase
  FROM (SELECT d.doc_id, d.w, lens.n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)
), m AS (
  SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (n, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


URL_FILTER = r"""
WITH rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), tails AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM tails
), best AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""


SOURCE_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) AS random
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM d GROUP BY source
), stops AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, least(3 * source_size, weight * (SELECT max(level) FROM stops WHERE 3 * source_size >= weight * level)) AS target FROM s
), e AS (
  SELECT doc_id, d.source, size, source_size, target, floor(target / source_size) AS whole, target / source_size - floor(target / source_size) AS chance,
         (random + 0.5::DOUBLE) / 281474976710656 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, CASE WHEN chance > 0 AND size > 0 THEN least(floor(u * (1 - chance) / (u * (1 - chance) + (1 - u) * chance) * 281474976710656), 281474976710655) END AS rank,
         target - sum(whole * size) OVER (PARTITION BY source) AS rest
  FROM e
), c AS (
  SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) <= rest AND rank IS NOT NULL AS drawn
  FROM r
), g AS (
  SELECT *, rest - coalesce(sum(CASE WHEN drawn THEN size END) OVER (PARTITION BY source), 0) AS gap FROM c
), l AS (
  SELECT doc_id FROM g WHERE rank IS NOT NULL AND NOT drawn AND abs(size - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), rank) = 1
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN drawn OR doc_id IN (SELECT doc_id FROM l) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM g
"""


RESAMPLING = r"""
WITH RECURSIVE step(byte, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY byte) AS tab FROM step WHERE k = 8
), d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word
  FROM benchmark
), dw AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL
), words AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM b)
), bytes AS (
  SELECT word, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS v FROM words
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, v), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc
), s AS (
  SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM s) + 10000 AS DOUBLE)
                                / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) FROM b) + 10000 AS DOUBLE)))) AS gain
  FROM s LEFT JOIN t USING (bucket)
), weighed AS (
  SELECT doc_id, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": URL_FILTER, "op9_benchmark_decontamination": DECONTAMINATION, "op10_exact_dedup": EXACT_DEDUP, "op12_source_mixing": SOURCE_MIXING, "op13_importance_resampling": RESAMPLING}
