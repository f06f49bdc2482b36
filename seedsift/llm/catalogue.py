"""One query per operator over the given tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.llm.blockname import exact_dedup
from seedsift.llm.bpe import bpe_digests
from seedsift.llm.classifier import score_quality, train_quality
from seedsift.llm.common import read_table
from seedsift.llm.interleave import interleaved_shards
from seedsift.llm.lexical import ranked_search
from seedsift.llm.licences import licence_scan
from seedsift.llm.lm import score_texts, train_model
from seedsift.llm.mixing import mixture
from seedsift.llm.negatives import hard_negatives
from seedsift.llm.neighbours import nearest_neighbours
from seedsift.llm.parity import jaccard_components
from seedsift.llm.repeats import remove_repeats
from seedsift.llm.simhash import simhash_components


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.filter("vec_id % 20 = 0"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_texts(docs, train_model(docs))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False)
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed_from").cast("bigint").alias("n_spans"),
        "kept_sha256",
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


QUERIES = {
    name: query
    for name, query in globals().items()
    if name.startswith("op") and name[2].isdigit()
}

TERMS = r"""regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE = {
    "op2_exact_dedup": """
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS plain
            FROM documents),
        g AS (
            SELECT doc_id, plain,
                   first_value(doc_id) OVER
                       (PARTITION BY plain ORDER BY n_chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY plain) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept,
               sha256(plain) AS text_sha256
        FROM g
    """,
    "op11_hard_negatives": """
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
                   CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
            FROM whole a JOIN whole r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
        positive AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        placed AS (
            SELECT anchor_id, positive_id, positive_score, s.id AS negative_id,
                   s.score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id
                                      ORDER BY s.score DESC, s.id) AS rank
            FROM positive JOIN scored s USING (anchor_id)
            WHERE NOT s.same AND 30 * positive_score <= 100 * s.score
              AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
               negative_score
        FROM placed WHERE rank <= 10
    """,
    "op12_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_sort(list_distinct(
                    [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]))
                END AS s
            FROM d),
        kinds AS (
            SELECT s, row_number() OVER () AS k, min(doc_id) AS first FROM sets WHERE len(s) > 0
            GROUP BY s),
        shingles AS (SELECT k, len(s) AS n, unnest(s) AS x FROM kinds),
        links AS (
            SELECT a.k AS a, b.k AS b
            FROM shingles a JOIN shingles b
              ON a.x = b.x AND a.k < b.k AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
            GROUP BY ALL
            HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach AS (
            SELECT k AS a, k AS b FROM kinds
            UNION
            SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END
            FROM reach r JOIN links l ON l.a = r.b OR l.b = r.b),
        classes AS (
            SELECT r.a AS k, min(first) AS component_id FROM reach r JOIN kinds ON k = r.b GROUP BY r.a)
        SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
               coalesce(component_id, doc_id) AS component_id
        FROM sets LEFT JOIN kinds USING (s) LEFT JOIN classes USING (k)
    """,
    "op13_lexical_search": f"""
        WITH d AS (SELECT doc_id, {TERMS} AS terms FROM documents),
        real AS (
            SELECT row_number() OVER () AS r, doc_id, terms, len(terms) AS n
            FROM d WHERE len(terms) > 0),
        total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM real),
        tf AS (
            SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
            FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM real) GROUP BY r, term),
        weight AS (
            SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM total) + 2)::DOUBLE
                                              / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
            FROM tf GROUP BY term),
        wanted AS (
            SELECT row_number() OVER () AS i, item_id, {TERMS} AS terms FROM benchmark),
        item AS (SELECT i, item_id, unnest(terms) AS term FROM wanted),
        scored AS (
            SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
                   CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75
                        + (25 * n * (SELECT docs FROM total)) // (SELECT length FROM total))))
                   ) AS BIGINT) AS score
            FROM item JOIN tf USING (term) JOIN weight USING (term) GROUP BY i, r),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
            FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20
    """,
}
