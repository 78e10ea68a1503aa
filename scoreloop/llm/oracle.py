"""SQL of the registered queries that SQL can express."""

ORACLE: dict[str, str] = {
    "op3_norm_sorted_top_k": """
        WITH ints AS (
            SELECT DISTINCT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
            FROM ints q JOIN ints x ON q.vec_id <> x.vec_id
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op7_url_shift_and": """
        WITH cut AS (
            SELECT page_id,
                   CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^?#]*') AS both_parts FROM cut
        ), named AS (
            SELECT page_id,
                   translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   substr(both_parts, length(raw_host) + 1) AS path
            FROM parts
        ), rules(verdict, rule_host, rule_path) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), fitting AS (
            SELECT page_id, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
            FROM named, rules
            WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT n.page_id, n.host, n.path, f.rule,
               coalesce(f.verdict, CASE WHEN regexp_matches(n.host, 'spam-farm|cheap-pills|casino') THEN 'block' ELSE 'allow' END) AS verdict
        FROM named n LEFT JOIN fitting f ON n.page_id = f.page_id AND f.place = 1
    """,
    "op11_segment_resampling": r"""
        WITH RECURSIVE cells AS (
            SELECT CAST(range AS BIGINT) AS start, CAST(range AS BIGINT) AS v, 0 AS k FROM range(256)
            UNION ALL
            SELECT start, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM cells WHERE k < 8
        ), steps AS (
            SELECT list(v ORDER BY start) AS step FROM cells WHERE k = 8
        ), texts AS (
            SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
            UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
        ), words AS (
            SELECT side, row, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM texts
        ), spelled AS (
            SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM words)
        ), hashed AS (
            SELECT word, xor(list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), [
                    CAST('0x' || substr(digits, 2 * CAST(i AS INT) - 1, 2) AS BIGINT) FOR i IN range(1, length(digits) // 2 + 1)
                ]),
                lambda c, b: xor(c >> 8, step[1 + CAST(xor(c & 255, b) AS INT)])), 4294967295) % 10000 AS bucket
            FROM spelled, steps
        ), counts AS (
            SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN hashed USING (word) GROUP BY bucket
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM counts)::DOUBLE + 10000)
                / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM counts)::DOUBLE + 10000)))) AS BIGINT) AS gain
            FROM counts
        ), weights AS (
            SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS gain
            FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row
        ), scored AS (
            SELECT doc_id, coalesce(n, 0) AS n_features,
                   coalesce((gain - ((gain % n) + n) % n) // n, 0) AS weight,
                   CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
            FROM texts LEFT JOIN weights USING (row) WHERE side = 'd'
        ), placed AS (
            SELECT *, weight + noise AS score,
                   row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place,
                   count(*) FILTER (n_features >= 20) OVER () AS eligible
            FROM scored
        )
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank
        FROM placed
    """,
    "op13_line_bitmaps": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), cut AS (
            SELECT row, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM docs
        ), keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
            FROM cut
        ), common AS (
            SELECT line_key FROM keyed WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT row) >= 10
        ), marked AS (
            SELECT k.row, k.line, k.nth, c.line_key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c USING (line_key)
        ), joined AS (
            SELECT row, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
            FROM marked GROUP BY row
        )
        SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM docs JOIN joined USING (row)
    """,
}
