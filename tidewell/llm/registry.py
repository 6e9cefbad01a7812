"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.sentencepiece_bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.html_content import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.context_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.multi_index import search_table

    return search_table(table(spark, sf_dir, "embeddings"))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.cover_tree import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.toxicity import grade_documents

    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.lsh_forest import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.byte_bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_sentencepiece,
    op2_html_content,
    op3_context_tree,
    op4_multi_index_hashing,
    op5_cover_tree,
    op6_warc,
    op7_toxicity,
    op8_best_fit_packing,
    op9_language_id,
    op10_jaccard_join,
    op11_whitening,
    op12_byte_bpe,
    op13_spelling_variants,
    pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


ORACLE_SQL = {
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha256(html) AS digest FROM p),
             f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 AND page_id IS NOT NULL GROUP BY digest)
        SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN d.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.page_id <> f.first THEN f.first END AS refers_to
        FROM d LEFT JOIN f ON d.digest = f.digest
    """,
    "op4_multi_index_hashing": """
        WITH c AS (SELECT DISTINCT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
             d AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(hamming(q.code, c.code) AS INTEGER) AS distance
                   FROM c AS q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM d)
        SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
    """,
    "op5_cover_tree": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
             links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
                       WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
             reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
             least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
             n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
        FROM v JOIN least ON v.vec_id = least.a LEFT JOIN n ON v.vec_id = n.a
    """,
    "op10_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, string_split_regex(trim(lower(coalesce(text, '')), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '[ \\t\\n\\x0B\\f\\r]+') AS words FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i : i + 4], ' '))) AS shingle FROM w WHERE words <> ['']),
             sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
             links AS (SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE met >= 0.8 * (x.n + y.n - met) - 1e-9),
             reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
             least AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
             n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT d.doc_id, least.class_id, coalesce(n.n_links, 0) AS n_links, d.doc_id = least.class_id AS kept
        FROM documents AS d JOIN least ON d.doc_id = least.a LEFT JOIN n ON d.doc_id = n.a
    """,
    "op13_spelling_variants": """
        WITH RECURSIVE
             -- crc32 by its table of 256 remainders
             tab AS (SELECT list(list_reduce(list_concat([CAST(i AS UBIGINT)], [CAST(0 AS UBIGINT) FOR x IN range(8)]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
             runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')) AS raw FROM documents),
             low AS (SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
             coded AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM low),
             hashed AS (SELECT run, n, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], [CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS UBIGINT) FOR i IN range(len(x) // 2)]), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), CAST(4294967295 AS UBIGINT)) AS h FROM coded, tab),
             words AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : CAST(h % len(run) AS BIGINT)] || run[CAST(h % len(run) AS BIGINT) + 2 :] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
                       FROM hashed GROUP BY 1 HAVING sum(n) >= 2 AND len(CASE WHEN h % 31 = 0 THEN run[1 : CAST(h % len(run) AS BIGINT)] || run[CAST(h % len(run) AS BIGINT) + 2 :] ELSE run END) >= 7),
             -- words one edit apart share a word with at most one letter deleted from either
             less AS (SELECT word, n, unnest(list_distinct([word[1 : i - 1] || word[i + 1 :] FOR i IN range(1, len(word) + 2)])) AS part FROM words),
             met AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less AS a JOIN less AS b ON a.part = b.part AND a.word <> b.word),
             -- one byte a letter, since the distance is of bytes
             near AS (SELECT * FROM met WHERE levenshtein(translate(word, 'MANY', 'BYTE'), translate(other, 'MANY', 'BYTE')) = 1),
             best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM near GROUP BY word),
             formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM words AS w LEFT JOIN best AS b USING (word)),
             chain(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain AS c JOIN formed AS f ON c.root = f.word WHERE f.form IS NOT NULL),
             last AS (SELECT c.word, c.root FROM chain AS c JOIN formed AS f ON c.root = f.word WHERE f.form IS NULL)
        SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM formed AS f JOIN last AS l USING (word)
    """.replace("MANY", "".join(map(chr, range(0xC0, 0x100)))).replace("BYTE", "".join(map(chr, range(33, 97))).replace("'", "''")),
}
