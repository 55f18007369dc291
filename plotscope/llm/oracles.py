"""SQL twins of the queries that SQL can express, for DuckDB over the same tables."""

#: Words of a text: runs of ASCII letters, digits and characters beyond ASCII.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: One round of the vector codes: the nearest entries, then their means.
_NEAREST = r"""
        near{r} AS MATERIALIZED (
            SELECT n, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
                SELECT n, p, e, x, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
                FROM parts JOIN book{r} USING (p)) GROUP BY n, p),"""
_MEANS = r"""
        mean{s} AS (
            SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS y FROM (
                SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS c
                FROM near{r}, range(1, 1 + (SELECT max(len(x)) FROM parts)) AS t(i) GROUP BY ALL) GROUP BY p, e),
        book{s} AS MATERIALIZED (
            SELECT p, e, coalesce(m.y, b.y) AS y FROM book{r} b LEFT JOIN mean{s} m USING (p, e)),"""


def _rounds(n: int) -> str:
    steps = (_NEAREST.format(r=r) + _MEANS.format(r=r, s=r + 1) for r in range(n))
    return "".join(steps) + _NEAREST.format(r=n)


ORACLES = {
    "op9_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2),
                    lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]))) END AS s FROM words),
        sized AS (SELECT doc_id, len(s) AS n FROM sets),
        listed AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
        shared AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS overlap
            FROM listed a JOIN listed b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT u, v FROM shared JOIN sized x ON x.doc_id = u JOIN sized y ON y.doc_id = v
            WHERE 100 * overlap >= 85 * (x.n + y.n - overlap)),
        reached AS (
            SELECT doc_id, doc_id AS other FROM sized
            UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other)
        SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(other) AS component_id
        FROM reached JOIN sized USING (doc_id) GROUP BY doc_id""",
    "op10_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
            WHERE q.vec_id % 50 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_vector_codes": r"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS n FROM kept),
        parts AS MATERIALIZED (
            SELECT n, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM numbered, range(8) AS t(p)),
        book0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS y FROM parts WHERE n <= 16),"""
    + _rounds(6)
    + r"""
        digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book6),
        coded AS (
            SELECT n, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
            FROM near6 GROUP BY n)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM numbered JOIN coded USING (n) CROSS JOIN digest""",
    "op12_decontaminate": rf"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        item AS (SELECT item_id, {_WORDS} AS w, least(len(w), 10) AS size FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS passage
            FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM item WHERE size > 0)),
        found AS (
            SELECT r, i, size, item_id FROM (
                SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS passage FROM (
                    SELECT *, unnest(range(1, len(w) - size + 2)) AS i
                    FROM doc, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size))
            JOIN windows USING (size, passage)),
        hit AS (
            SELECT r, count(DISTINCT place) AS n_hit
            FROM (SELECT r, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r),
        named AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op13_resample": rf"""
        WITH RECURSIVE shifted(n, c, k) AS (
            SELECT n, n, 0 FROM range(256) AS t(n)
            UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM shifted WHERE k < 8),
        crc_table AS (SELECT list(c ORDER BY n) AS t FROM shifted WHERE k = 8),
        doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        listed AS (
            SELECT r, unnest(w) AS word FROM doc UNION ALL SELECT 0, unnest({_WORDS}) FROM benchmark),
        words AS (SELECT word, row_number() OVER () AS k, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM listed)),
        crc(word, h, c) AS (
            SELECT word, h, 4294967295 FROM words
            UNION ALL SELECT word, h[3:], xor(c // 256, t[xor(c % 256, CAST('0x' || h[:2] AS BIGINT)) + 1])
            FROM crc CROSS JOIN crc_table WHERE h <> ''),
        bucket AS MATERIALIZED (SELECT word, xor(c, 4294967295) % 10000 AS b FROM crc WHERE h = ''),
        counted AS (
            SELECT b, count(*) FILTER (r > 0) AS s, count(*) FILTER (r = 0) AS t FROM listed JOIN bucket USING (word) GROUP BY b),
        gains AS (
            SELECT b, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
                / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counted),
        weights AS (
            SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM listed JOIN bucket USING (word) JOIN gains USING (b) GROUP BY r),
        scored AS (
            SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256(concat('2024:', doc_id))[:8] AS BIGINT) + 0.5::DOUBLE)
                / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM doc LEFT JOIN weights USING (r)),
        drawn AS (
            SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, 10 * count(*) OVER () // 100 AS n
            FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= n THEN place END AS rank
        FROM scored LEFT JOIN drawn USING (r)""",
}
