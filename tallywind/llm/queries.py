"""The contract queries: each gets its rows from its operator and derives the digest columns from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.llm import hard_negatives, lexical, mixing, multi_index, packing, pii, quality, rans, secret_scan, simhash, topk, vector_dedup, warc


def tokenizer_path(name: str) -> Callable[[], str]:
    """A vocabulary file's place, found where it is called: each worker looks on its own machine."""

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_read(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_archives(warc.normalise_archives(names))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_documents(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: F.split(s, ":")[0].isin(*secret_scan.BASE))
    return found.select("doc_id", *map(count, secret_scan.BASE), F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"), F.lower(F.hex("blob")).alias("blob"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.read_files(rans.write_files(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, lexical.build(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_warc, op3_secrets, op4_vector_dedup, op5_packing, op6_mixing, op7_simhash, op8_token_files, op9_quality, op10_topk, op11_multi_index, op12_hard_negatives, op13_lexical)}


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}')"


ORACLE_SQL = {
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             a AS (SELECT DISTINCT vec_id, label, q FROM v WHERE vec_id % 100 = 0),
             s AS (SELECT a.vec_id AS anchor_id, a.label AS own, a.q AS q, b.vec_id AS vec_id, b.label AS label, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
                   FROM a JOIN v b ON a.vec_id IS DISTINCT FROM b.vec_id),
             p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, own, q ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s WHERE label = own QUALIFY place <= 5),
             n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                          CAST(row_number() OVER (PARTITION BY p.anchor_id, p.own, p.q, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank
                   FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.own = s.own AND p.q = s.q AND s.label <> s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_lexical": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, len({_terms("text")}) AS n, {_terms("text")} AS terms FROM documents WHERE text IS NOT NULL),
             g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d WHERE n > 0),
             i AS (SELECT DISTINCT item_id, text, unnest(list_distinct({_terms("text")})) AS term FROM benchmark),
             f AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
             w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, docs),
             s AS (SELECT item_id, text, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
                   FROM i JOIN f USING (term) JOIN w USING (term), g GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op10_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                   FROM embeddings WHERE embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             a AS (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 20 = 0),
             s AS (SELECT a.vec_id AS query_id, a.q AS own, b.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
                   FROM a JOIN v b ON a.vec_id IS DISTINCT FROM b.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to FROM g""",
}
