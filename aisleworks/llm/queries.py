"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleworks.llm.alignment import tokenizer_alignment
from aisleworks.llm.common import crc_mod, ship_package, table
from aisleworks.llm.language_id import identify
from aisleworks.llm.merkle import document_manifest
from aisleworks.llm.mixing import mix_sources
from aisleworks.llm.ngram_join import near_copies
from aisleworks.llm.packing import pack
from aisleworks.llm.quality import quality
from aisleworks.llm.token_counts import token_counts
from aisleworks.llm.token_files import token_file_round_trip
from aisleworks.llm.toxicity import held_out_third, toxicity
from aisleworks.llm.vector_dedup import near_vectors
from aisleworks.llm.vector_search import nearest_vectors
from aisleworks.llm.warc import archive_round_trip


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out_third())
    return found.withColumn("held_out", held_out_third())


def op2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors(table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_round_trip(table(spark, folder, "pages"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = identify(table(spark, folder, "documents"), crc_mod("doc_id", 4) != 2)
    return found.withColumn("held_out", crc_mod("doc_id", 4) == 2).drop("learns")


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out_third())
    return found.withColumn("held_out", held_out_third())


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents"))


def op8_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return document_manifest(table(spark, folder, "documents"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    byte_path, piece_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return tokenizer_alignment(table(spark, folder, "documents"), byte_path, piece_path)


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    found = token_file_round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


Query = Callable[[SparkSession, str], DataFrame]


def with_package(run: Query) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return run(spark, folder)

    return query


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_nearest": op2_nearest,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_ngram_join": op7_ngram_join,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_merkle": op11_merkle,
    "op12_alignment": op12_alignment,
    "op13_token_files": op13_token_files,
}
QUERIES = {name: with_package(run) for name, run in QUERIES.items()}

#: SQL for DuckDB, where SQL can express the query.
STATEMENTS: dict[str, str] = {
    "op11_merkle": """
        WITH RECURSIVE d AS (
            SELECT *, coalesce(doc_id::VARCHAR, '') AS key,
                concat_ws('', coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'),
                    coalesce(octet_length(encode(source)) || ':' || source, '-'),
                    coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
                    coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS fields,
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small
            FROM documents),
        bits AS (  -- crc32 by its definition: a polynomial division, bit by bit, over the digits of the id
            SELECT key, 1 AS place, 4294967295::UBIGINT AS crc FROM (SELECT DISTINCT key FROM d)
            UNION ALL
            SELECT key, place + 1, list_reduce(range(8)::UBIGINT[], lambda c, i:
                CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END,
                xor(crc, ascii(substr(key, place::INT, 1))::UBIGINT)) FROM bits WHERE place <= length(key)),
        crcs AS (SELECT key, xor(arg_max(crc, place), 4294967295::UBIGINT) AS crc FROM bits GROUP BY key),
        leaves AS (
            SELECT doc_id, lang, sha256(fields || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                sha256(fields || CASE WHEN text IS NULL THEN '-' WHEN crc % 3 = 0
                    THEN octet_length(encode(small)) || ':' || small ELSE octet_length(encode(text)) || ':' || text END) AS changed
            FROM d JOIN crcs USING (key)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos,
                count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        low(lang, level, pos, n, h) AS (
            SELECT lang, 0, pos, n, leaf FROM placed
            UNION ALL
            SELECT lang, any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
            FROM low WHERE n > 1 GROUP BY lang, pos // 8),
        subroots AS (
            SELECT lang, h, level, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
            FROM low WHERE n = 1),
        high(level, pos, n, h) AS (
            SELECT 0, pos, n, h FROM subroots
            UNION ALL
            SELECT any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
            FROM high WHERE n > 1 GROUP BY pos // 8),
        steps AS (  -- siblings of every node: those to the left, those to the right
            SELECT x.lang, x.level, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l,
                coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
            FROM low x JOIN low y ON x.lang IS NOT DISTINCT FROM y.lang AND x.level = y.level AND x.pos // 8 = y.pos // 8
            WHERE x.n > 1 GROUP BY ALL),
        tall AS (
            SELECT x.level, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l,
                coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
            FROM high x JOIN high y ON x.level = y.level AND x.pos // 8 = y.pos // 8 WHERE x.n > 1 GROUP BY ALL),
        climb(lang, leaf_pos, level, pos, proof, h) AS (
            SELECT lang, pos, 0, pos, '', changed FROM placed
            UNION ALL
            SELECT c.lang, c.leaf_pos, c.level + 1, c.pos // 8, proof || l || r, sha256(l || c.h || r)
            FROM climb c JOIN steps s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = c.pos),
        onward(lang, leaf_pos, level, pos, proof, h) AS (
            SELECT c.lang, leaf_pos, 0, s.pos, proof, c.h FROM climb c
            JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level
            UNION ALL
            SELECT c.lang, c.leaf_pos, c.level + 1, c.pos // 8, proof || l || r, sha256(l || c.h || r)
            FROM onward c JOIN tall t ON t.level = c.level AND t.pos = c.pos),
        roots AS (SELECT level, h FROM high WHERE n = 1)
        SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root,
            o.h = r.h AS verified
        FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN roots r
        JOIN onward o ON o.lang IS NOT DISTINCT FROM p.lang AND o.leaf_pos = p.pos AND o.level = r.level""",
    "op3_warc": """
        WITH p AS (
            SELECT page_id, sha1(coalesce(html, '')) AS digest,
                   octet_length(encode(coalesce(html, '')))::BIGINT AS bytes
            FROM pages),
        k AS (SELECT digest, max(page_id) AS keeper FROM p WHERE bytes >= 1000 GROUP BY digest)
        SELECT page_id, bytes AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keeper <> page_id THEN keeper END AS refers_to
        FROM p LEFT JOIN k ON p.digest = k.digest AND bytes >= 1000""",
    "op8_vector_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
            WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
        n AS (SELECT a, count(*) AS links FROM l GROUP BY a),
        r(vec_id, reached) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached)
        SELECT r.vec_id, any_value(coalesce(n.links, 0)) AS n_links, min(reached) AS component_id,
               r.vec_id = min(reached) AS kept
        FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id""",
    "op7_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
            FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS u(i) WHERE len(words) > 0),
        n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
        l AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (
            SELECT a, b FROM l JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
            WHERE 100 * common >= 80 * (p.size + q.size - common)),
        r(doc_id, reached) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
        SELECT r.doc_id, any_value(coalesce(n.size, 0)) AS n_shingles, min(reached) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
}
