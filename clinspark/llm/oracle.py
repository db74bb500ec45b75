"""SQL for the registered queries that SQL can express, over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def components_sql(words: int, percent: int) -> str:
    """WITH items that end in ``found(doc_id, n_shingles, component_id)``: every pair with a common shingle is compared."""
    return f"""
    split AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
    shingle AS MATERIALIZED (
        SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, unnest(CASE WHEN len(w) < {words} THEN CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END
                ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END) AS s
            FROM split)),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
    common AS MATERIALIZED (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
        FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS MATERIALIZED (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM sizes
        UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
    lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
    found AS (
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
        FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id))"""


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC_SQL = f"""
    WITH own AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
    coded AS (
        SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}',
                1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '')
                AS payload_digest
        FROM own),
    owner AS (SELECT payload_digest, max(page_id) AS owner FROM coded GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> owner THEN owner END AS refers_to
    FROM coded JOIN owner USING (payload_digest)"""

SEARCH_SQL = r"""
    WITH word AS MATERIALIZED (
        SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents),
    posting AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
    length AS (SELECT doc_id, sum(tf) AS dl FROM posting GROUP BY doc_id),
    corpus AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM word) / (SELECT count(*) FROM documents) AS mean),
    weight AS (
        SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posting, corpus GROUP BY term, n),
    score AS (
        SELECT q.doc_id AS query_id, p.doc_id,
            round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
        FROM (SELECT DISTINCT doc_id, term FROM posting WHERE doc_id % 50 = 0) q
        JOIN posting p USING (term) JOIN weight USING (term) JOIN length l ON l.doc_id = p.doc_id, corpus
        GROUP BY q.doc_id, p.doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM score)
    SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

# Whole numbers throughout; sums of gaps are kept wide until the end.
DIVERGENCE_SQL = r"""
    WITH own AS MATERIALIZED (
        SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents),
    word AS MATERIALIZED (SELECT row_id, lang, source, unnest(words) AS term FROM own),
    kept AS MATERIALIZED (SELECT lang, term FROM word GROUP BY ALL HAVING count(DISTINCT row_id) >= 3),
    counted AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM own),
    size AS MATERIALIZED (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    cell AS MATERIALIZED (
        SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::BIGINT * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + v) AS p
        FROM groups JOIN kept USING (lang) JOIN size USING (lang)
        LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM counted GROUP BY ALL) USING (lang, source)
        LEFT JOIN counted USING (lang, source, term)),
    whole AS MATERIALIZED (
        SELECT lang, term, 1 + (1000000000::BIGINT * (n + 1)) // (total + v) AS q
        FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM counted GROUP BY ALL)
        JOIN (SELECT lang, sum(n)::BIGINT AS total FROM counted GROUP BY ALL) USING (lang) JOIN size USING (lang)),
    gap AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    part AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT
        FROM cell JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM part)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_divergence": DIVERGENCE_SQL,
        "op4_warc": WARC_SQL,
        "op9_search": SEARCH_SQL,
        "op3_near_dedup": f"WITH RECURSIVE {components_sql(4, 80)} SELECT *, doc_id = component_id AS kept FROM found",
    }
