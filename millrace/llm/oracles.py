"""DuckDB SQL for the queries that SQL can express on the whole tables. It works from the contract alone, the plain way."""

from __future__ import annotations

#: Fixed value: words.
_W = r"[^\x20\x09-\x0D]+"

#: Shingle sets, all pairs that share a shingle, and reachability.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM docs),
same AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(list_sort(s), chr(10))) AS m FROM sets),
one AS (SELECT m, min(doc_id) AS a, any_value(n) AS n FROM same WHERE n > 0 GROUP BY m),
items AS (SELECT a, n, unnest(s) AS x FROM one JOIN sets ON a = doc_id),
pairs AS (SELECT p.a, q.a AS b FROM items p JOIN items q ON p.x = q.x AND p.a < q.a GROUP BY p.a, q.a HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, a FROM one UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, s.n AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM same s LEFT JOIN one USING (m) LEFT JOIN least ON one.a = least.a
"""

#: CRC-32 with its table (the reversed polynomial is a fixed value), the jumps of each key, slots by lane.
SHARDING = """
WITH RECURSIVE crc_table AS (
 SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
 SELECT doc_id, length(h) // 2 + 16 AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
 FROM bytes, crc_table),
walk(doc_id, i, place) AS (
 SELECT doc_id, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM documents
 UNION ALL
 SELECT doc_id, i + 1, least(CAST(floor((place + 1) / ((CAST('0x' || substr(md5(concat(doc_id, ':', i)), 1, 8) AS BIGINT) + 1) / CAST(4294967296 AS DOUBLE))) AS BIGINT), 41) FROM walk WHERE place < 41),
placed AS (SELECT doc_id, max(place) FILTER (place < 40) AS shard, max(place) FILTER (place < 41) AS grown_shard FROM walk GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
 row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(concat(doc_id, ':', size, ':', text_crc32)), 1, 8) AS BIGINT) % 64, doc_id, size, text_crc32) - 1 AS slot,
 CAST(grown_shard AS INTEGER) AS grown_shard
FROM sized JOIN placed USING (doc_id)
"""

#: Every string of 200 bytes by its MD5; runs of those that occur twice; the rest of the bytes by their hex form.
SUFFIXES = """
WITH docs AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM docs)),
hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY m) AS k FROM starts) WHERE k > 1),
runs AS (SELECT doc_id, i, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200 THEN 0 ELSE 1 END AS new FROM hit),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM runs) GROUP BY doc_id, k),
gone AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS k, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(1, k + 2), lambda j: substr(h, CASE WHEN j = 1 THEN 1 ELSE 2 * his[j - 1] + 1 END, (CASE WHEN j = k + 1 THEN length(h) // 2 ELSE los[j] END - CASE WHEN j = 1 THEN 0 ELSE his[j - 1] END) * 2)), '') END)) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)
"""

#: Every window of 20 words by its MD5; words covered by a later one go.
SUBSTRINGS = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)),
again AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM again) GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(g, []) AS g FROM docs LEFT JOIN gone USING (doc_id)),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s FROM (SELECT d.doc_id, unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS p FROM docs d) u
 WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(g) AS p FROM gone) x WHERE x.doc_id = u.doc_id AND x.p = u.p) GROUP BY doc_id)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(g) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM kept k LEFT JOIN left_ USING (doc_id)
"""

#: All phrases of one to five words, counted; parts looked up; the least cut; ranks.
PHRASES = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS p FROM docs)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
counts AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) t(k)) GROUP BY ALL HAVING count(*) >= 100),
longer AS (SELECT * FROM counts WHERE k > 1),
covered AS (SELECT DISTINCT lang, f, unnest([array_to_string(list_slice(string_split(p, ' '), 1, k - 1), ' '), array_to_string(list_slice(string_split(p, ' '), 2, k), ' ')]) AS p FROM longer WHERE k > 2),
left_ AS (SELECT * FROM longer x WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = x.lang AND c.p = x.p AND c.f = x.f)),
cuts AS (SELECT lang, p, f AS a, c, array_to_string(list_slice(string_split(p, ' '), 1, c), ' ') AS head, array_to_string(list_slice(string_split(p, ' '), c + 1, k), ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS c FROM left_)),
scored AS (SELECT cuts.lang, cuts.p, a, c, h.f AS l, t.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
 FROM cuts JOIN counts h ON h.lang = cuts.lang AND h.p = head JOIN counts t ON t.lang = cuts.lang AND t.p = tail JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best)
SELECT lang, rank, p AS phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def _lloyd(size: int, k: int, rounds: int, scale: int, seed: int) -> str:
    """Plain rounds, one after another: the distance to each centroid, the nearest of least number, and floors of exact means."""
    near = lambda c: f"SELECT vec_id, v, c AS cluster, d FROM (SELECT vec_id, v, c, list_sum(list_transform(range(1, {size + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS d FROM kept, {c}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256(concat('{seed}:', vec_id)) AS h FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({near(f'c{r}')})",
            f"s{r} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {size + 1})) AS i FROM a{r}) GROUP BY cluster, i)",
            f"m{r} AS (SELECT cluster, list(t // n - CASE WHEN t % n < 0 THEN 1 ELSE 0 END ORDER BY i) AS m FROM s{r} GROUP BY cluster)",
            f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} ON c = cluster)",
        ]
    last = f"last AS MATERIALIZED ({near(f'c{rounds}')})"
    return f"""WITH {", ".join([*steps, last])}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM last JOIN c{rounds} ON c = cluster"""


CENTROIDS = _lloyd(64, 8, 10, 1024, 3)

#: Words, symbols, lines and windows of three words, by document.
QUALITY_COUNTS = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '{_W}') GROUP BY doc_id),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs))),
again AS (SELECT doc_id, count(DISTINCT p) AS n_again FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE k > 1) GROUP BY doc_id),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_again, 0) AS BIGINT) AS n_repeat_words FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""

#: The longest rule that fits.
URL_RULES = r"""
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT page_id, rule, verdict FROM parts JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, verdict AS by_rule FROM parts LEFT JOIN fits USING (page_id)
"""

ORACLE = {"quality_counts": QUALITY_COUNTS, "url_rules": URL_RULES, "op11_phrases": PHRASES, "op13_centroids": CENTROIDS, "op3_near_duplicates": NEAR_DUPLICATES, "op5_sharding": SHARDING, "op6_suffixes": SUFFIXES, "op9_substrings": SUBSTRINGS}
