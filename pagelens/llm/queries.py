"""The queries op1 to op13: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decomposition, decontaminate, divergence, langid, language_model, near_dedup, packing, quality, secrets, token_files, topk, vector_codes, warc
from .common import crc_mod, read_table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(read_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), capacity=4096, end_id=1)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return quality.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", F.col("n_shingles").cast("long"), "component_id", "kept")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"), end_id=2)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def op13_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decomposition.decompose(read_table(spark, sf_dir, "documents"), capacity=2048, end_id=1)


QUERIES = {f.__name__: f for f in (op1_warc, op2_packing, op3_language_model, op4_secrets, op5_decontamination, op6_quality, op7_language, op8_top_k, op9_near_duplicates, op10_token_files, op11_divergence, op12_vector_codes, op13_decomposition)}

def _vector_codes_sql(rounds: int) -> str:
    """Codebooks c0, c1, ... and assignments a0, a1, ..., one after the other."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT p.row, p.j, any_value(p.x) AS x, min(d.dist * 64 + d.i) % 64 AS i, min(d.dist * 64 + d.i) // 64 AS dist
            FROM parts p JOIN (SELECT p.row, p.j, c.i, CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - c.x[k]) * (p.x[k] - c.x[k]))) AS BIGINT) AS dist
                               FROM parts p JOIN c{i} c ON c.j = p.j) d ON d.row = p.row AND d.j = p.j GROUP BY p.row, p.j)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS (SELECT c.j, c.i, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
                SELECT j, i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS x
                FROM (SELECT j, i, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, i, x, unnest(range(1, len(x) + 1)) AS k FROM a{i}) GROUP BY j, i, k) GROUP BY j, i) m ON m.j = c.j AND m.i = c.i)""")
    return f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT row, j, e[j * (len(e) // 16) + 1 : (j + 1) * (len(e) // 16)] AS x FROM (SELECT row, e, unnest(range(16)) AS j FROM v)),
        c0 AS (SELECT j, row AS i, x FROM parts WHERE row < 64),
        {", ".join(steps)},
        coded AS (SELECT row, string_agg(printf('%02x', i), '' ORDER BY j) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
        sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, i)) AS codebooks_sha256 FROM c{rounds})
        SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, sha.codebooks_sha256
        FROM v JOIN coded c ON c.row = v.row JOIN sha ON true"""


ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS stored FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN stored END AS refers_to
        FROM g""",
    "op5_decontamination": """
        WITH texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        words AS (SELECT kind, id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM texts),
        runs AS (SELECT DISTINCT kind, id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS s FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
        items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM runs WHERE kind = 1)
        SELECT d.id AS doc_id, i.id AS item_id, max(i.n) AS item_shingles, count(*) AS found, count(*) / max(i.n) AS containment
        FROM runs d JOIN items i ON d.s = i.s WHERE d.kind = 0
        GROUP BY d.id, i.id HAVING count(*) >= 0.75 * max(i.n)""",
    "op8_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op9_near_duplicates": """
        WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
        runs AS (SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS s
                 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x),
        least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
        FROM documents d JOIN least l ON l.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
    "op11_divergence": """
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        tokens AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
        counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM tokens t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
        groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
        probs AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                         CAST(1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 1)) // (g.n + l.v) AS BIGINT) AS p, CAST(1 + (1000000000 * (CAST(k.n AS HUGEINT) + 1)) // (l.n + l.v) AS BIGINT) AS q
                  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
                  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM probs WHERE n > 0 AND p > q),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op12_vector_codes": _vector_codes_sql(2),
}
