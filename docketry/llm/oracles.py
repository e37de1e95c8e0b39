"""SQL that gives the rows of the operators which SQL can express, written from their contracts."""

SUBSTRING_DEDUP = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split WHERE len(words) >= 50)
), least AS (
  SELECT k, min(doc_id) AS doc_id FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT w.doc_id, w.i + r.range AS place
  FROM windows w JOIN least l ON w.k = l.k AND l.doc_id < w.doc_id CROSS JOIN range(50) r
), each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.place) FILTER (g.place IS NULL) AS text, count(g.place) AS n_removed
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.place = g.place GROUP BY e.doc_id
)
SELECT s.doc_id, len(s.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 3], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
  WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)
), ends AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION
  SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, coalesce(l.component_id, s.doc_id) = s.doc_id AS kept
FROM split s LEFT JOIN sizes z ON z.doc_id = s.doc_id LEFT JOIN least l ON l.doc_id = s.doc_id
"""

# a call's level is the number of user turns right before it in steps of two
TOOL_CALLS = r"""
WITH said AS (
  SELECT conv_id, turn, text, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM conversations WHERE role = 'user'
), calls AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS level FROM said
), replies AS (
  SELECT conv_id, turn, coalesce(text, '') AS content FROM conversations WHERE role = 'assistant'
)
SELECT c.conv_id, c.turn, c.conv_id || ':' || c.turn AS call_id, CAST(c.level AS INTEGER) AS level, r.turn IS NOT NULL AS linked, c.text IS NOT NULL AS valid,
  CASE WHEN c.text IS NULL THEN 'missing text; missing n_chars' ELSE '' END AS errors,
  '{"arguments":' || CASE WHEN c.text IS NULL THEN '{}' ELSE '{"n_chars":' || length(c.text) || ',"text":' || to_json(c.text)::VARCHAR || '}' END
  || ',"call_id":"' || c.conv_id || ':' || c.turn || '","name":"reply","result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json
FROM calls c LEFT JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
UNION ALL
SELECT r.conv_id, r.turn, r.conv_id || ':' || (r.turn - 1), 0, false, false, 'result without call',
  '{"call_id":"' || r.conv_id || ':' || (r.turn - 1) || '","result":' || to_json(r.content)::VARCHAR || '}'
FROM replies r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.turn = r.turn - 1)
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"""

SECRETS = (
    "WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents), raw AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, owner, text, {rank} AS rank, '{kind}' AS kind, {least} AS least, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {group}) AS found_values FROM docs"
        for rank, (kind, pattern, group, least) in enumerate((("assign", _ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)))
    )
    + r"""), matched AS (
  SELECT doc_id, owner, text, rank, kind, least, unnest(found) AS m, unnest(found_values) AS v, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS n FROM raw WHERE len(found) > 0
), placed AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY n) AS stop FROM matched
), spans AS (
  SELECT doc_id, owner, text, rank, kind, v, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE length(v) >= least
), spread AS (
  SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT text) AS texts FROM spans GROUP BY v
), classed AS (
  SELECT s.*, CASE WHEN owners >= 3 AND texts >= 3 THEN 'example'
    WHEN NOT ((kind = 'access' OR (regexp_matches(s.v, '[0-9]') AND regexp_matches(s.v, '[A-Za-z]'))) AND len(list_distinct(string_split(s.v, ''))) >= 6
      AND NOT regexp_matches(lower(s.v), 'example|changeme|dummy|placeholder|xxxx|your_')) THEN 'example'
    WHEN owners = 1 THEN 'live' ELSE 'shared' END AS class
  FROM spans s JOIN spread p ON s.v = p.v
), runs AS (
  SELECT doc_id, string_split_regex(text, '[A-Za-z0-9+/_.=-]{8,}') AS gaps, regexp_extract_all(text, '[A-Za-z0-9+/_.=-]{8,}') AS found FROM docs
), each_run AS (
  SELECT doc_id, unnest(found) AS m, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS n FROM runs WHERE len(found) > 0
), placed_run AS (
  SELECT doc_id, rtrim(m, '.') AS v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY n) - length(m) AS start FROM each_run
), known AS (
  SELECT DISTINCT rtrim(v, '.') AS v FROM classed WHERE class <> 'example'
), bare AS (
  SELECT r.doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(r.v) AS BIGINT) AS stop FROM placed_run r JOIN known k ON k.v = r.v
  WHERE length(r.v) >= 8 AND regexp_matches(r.v, '[0-9]') AND regexp_matches(r.v, '[A-Za-z]') AND len(list_distinct(string_split(r.v, ''))) >= 6
    AND NOT regexp_matches(lower(r.v), 'example|changeme|dummy|placeholder|xxxx|your_')
), added AS (
  SELECT * FROM bare b WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = b.doc_id AND s.start < b.stop AND s.stop > b.start)
), told AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS base, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'shared') AS n_shared, count(*) FILTER (class = 'example') AS n_example
  FROM classed GROUP BY doc_id
), shown AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans, count(*) FILTER (kind = 'bare') AS n_bare
  FROM (SELECT doc_id, rank, kind, start, stop FROM spans UNION ALL SELECT doc_id, 3, 'bare', start, stop FROM added) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example, coalesce(n_bare, 0) AS n_bare
FROM docs d LEFT JOIN told t ON t.doc_id = d.doc_id LEFT JOIN shown s ON s.doc_id = d.doc_id
"""
)


def kmeans(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """Plain k-means, every vector against every centroid in every round."""
    steps = [f"""WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept ORDER BY sha256('2:' || vec_id) NULLS LAST, v LIMIT {k}
)"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
  SELECT row, vec_id, kept.v, c, CAST(list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept CROSS JOIN c{r}
), a{r} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, CAST(arg_min(c, (d, c)) AS INTEGER) AS c, min(d) AS d FROM d{r} GROUP BY row
)""")  # fmt: skip
        if r < rounds:
            steps.append(f"""s{r} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i
), c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c) m ON m.c = c{r}.c
)""")  # fmt: skip
    return ", ".join(steps) + f"""
SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c
"""  # fmt: skip


FILTERS = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM docs GROUP BY text
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), words AS (
  SELECT d.doc_id, part, d.text, coalesce(first < d.doc_id, false) AS e, regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS w FROM docs d JOIN firsts f ON f.text = d.text
), masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * e::INT AS mask
  FROM words LEFT JOIN marks ON marks.doc_id = words.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT o, s, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INT) AS before FROM orders, range(1, 6) r(s)
), shares AS (
  SELECT part, bit, sum(CASE WHEN mask & bit != 0 AND mask & before = 0 THEN n ELSE 0 END) AS shapley FROM cells, steps GROUP BY part, bit
)
SELECT c.part, o AS filter_order, CAST(s AS INT) AS step, CAST(sum(CASE WHEN mask & (before | t.bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & t.bit != 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & t.bit != 0 AND mask & before != 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = t.bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & t.bit != 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & t.bit != 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(any_value(shapley) AS BIGINT) AS shapley
FROM cells c CROSS JOIN steps t JOIN shares h ON h.part = c.part AND h.bit = t.bit GROUP BY c.part, o, s
"""
