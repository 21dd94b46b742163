"""One query for each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcadence.llm import bpe, covertree, hardneg, mixing, pii, prefixhash, quality, quotes, shallot, sharding, simhash, tokencounts, warc
from hexcadence.llm.base import ORACLES, QUERIES, query, table
from hexcadence.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_and_text(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def tokens_and_text(docs: DataFrame, vocab: str, ids: bool = False) -> DataFrame:
    """Encode ``text``, decode the tokens again; n_tokens, the digests of both, and the packed ids if asked for."""
    others = [c for c in docs.columns if c != "text"]
    coded = bpe.round_trip(docs, "text", vocab, keep=others)
    return coded.select(
        *others,
        "tokens.n_tokens",
        *(["tokens.token_ids"] if ids else []),
        F.sha2("tokens.token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("tokens.text").cast("binary"), 256).alias("decoded_sha256"),
    )


# The CRC is one step per byte over the rule-made table; DuckDB's lists count from 1.
OP2_SQL = r"""
WITH RECURSIVE step(i, k, v) AS (
    SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM step WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
sized AS (
    SELECT doc_id, text, COALESCE(strlen(text), 0) + 1 AS size FROM documents
),
summed AS (
    SELECT *, sum(size) OVER () AS whole,
        sum(size) OVER (ORDER BY doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - size AS start
    FROM sized
),
placed AS (
    SELECT *, CAST(LEAST(15, ((2 * start + size) * 16) // (2 * whole)) AS INTEGER) AS shard FROM summed
)
SELECT doc_id, CAST(size AS BIGINT) AS size,
    CASE WHEN COALESCE(text, '') = '' THEN 0 ELSE
        xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])
        )) END AS text_crc32,
    'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST) - 1 AS slot,
    CAST(NULL AS INTEGER) AS grown_shard
FROM placed CROSS JOIN crc_table
"""


@query("op2_prefix_shards", OP2_SQL)
def op2_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.shards(rows, ["doc_id", "size", "text_crc32"], "size", 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op3_bootstrapped_pii")
def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), "text", keep=["doc_id"])
    return found.select(
        "doc_id",
        *[pii.counted("pii.base", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed("pii.base").cast("binary"), 256).alias("base_sha256"),
        pii.listed("pii.spans").alias("spans"),
    )


OP4_SQL = r"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS r,
        embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x != 0)) > 0 AS usable
    FROM embeddings
),
links AS (
    SELECT a.r AS a, b.r AS b
    FROM vectors a JOIN vectors b ON a.usable AND b.usable AND a.r != b.r AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
),
reached(r, seen) AS (
    SELECT r, r FROM vectors
    UNION
    SELECT reached.r, links.b FROM reached JOIN links ON reached.seen = links.a
),
components AS (
    SELECT reached.r, min(vectors.vec_id) AS component_id FROM reached JOIN vectors ON vectors.r = reached.seen GROUP BY 1
),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, COALESCE(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM vectors JOIN components USING (r) LEFT JOIN counts USING (r)
"""


@query("op4_cover_tree", OP4_SQL)
def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


OP5_SQL = r"""
WITH pages_read AS (
    SELECT page_id, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages
),
grouped AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first
    FROM pages_read
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM grouped
"""


@query("op5_warc", OP5_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    full = warc.read(spark, path).where("record_type = 'response'")
    heads = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = full.select(
        warc.page_key(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("bigint").alias("refers_to"),
    )
    revisits = heads.select(
        warc.page_key(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        warc.page_key(F.col("refers_to")).alias("refers_to"),
    )
    return responses.select(columns).unionByName(revisits.select(columns))


@query("op6_cube_mixing")
def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, "source", "size", ["doc_id"])
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


@query("op7_divergence")
def op7_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), "text", "lang", keep=["doc_id"]).select("doc_id", "quality.*")


@query("op8_quotation_links")
def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = quotes.linked(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return chats.select("conv_id", "turn", "role", "body", "n_quotes", "reply_to", "position")


@query("op9_token_sections")
def op9_token_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tokencounts.attribute(table(spark, sf_dir, "documents"), "text", vocabulary(), keep=["doc_id"])
    return lines.select(
        "doc_id",
        F.col("section.number").alias("line"),
        "section.start",
        "section.end",
        F.col("section.tokens").cast("bigint").alias("n_tokens"),
        F.col("section.crossing").alias("n_crossing"),
    )


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_components(table(spark, sf_dir, "documents"), "doc_id", "text")
    return near.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op11_shallot")
def op11_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shallot.cluster(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", dims=64, scale=1024, k=8, rounds=10, prefix="3:"
    )
    return found.withColumnRenamed("id", "vec_id")


# DuckDB's lists of BIGINT have no exact product: components are below 2^53, sums of 64 products too.
OP12_SQL = r"""
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS r
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, a.r AS anchor, b.vec_id AS id, b.r, a.label = b.label AS alike,
        CAST(CASE WHEN len(a.v) = 0 THEN 0 ELSE list_dot_product(a.v, b.v) END AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.r != b.r AND len(a.v) = len(b.v)
),
positives AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM scored WHERE alike
    ) WHERE place <= 5
),
negatives AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.id) AS rank
    FROM positives p JOIN scored n
        ON n.anchor = p.anchor AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hardneg.mine(vectors, "vec_id", "label", "embedding", F.col("vec_id") % 100 == 0)


@query("op13_prefix_fingerprints")
def op13_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixhash.compared(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
