"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelweir.llm import (
    bpe_codec,
    embedding_dedup,
    hard_negatives,
    mixing,
    pii,
    preferences,
    quality,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    warc,
    whitening,
)
from funnelweir.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("op1_warc")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "digest_ok")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token count of every document, and its longest prefix of 512 tokens."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints on 3-word shingles, linked at 2 bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op4_preferences",
    """
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    replies AS (
        SELECT conv_id, max(turn) AS last_turn, max({'turn': turn, 'text': text}).text AS reply FROM turns WHERE role = 'assistant' GROUP BY conv_id
    ),
    ends AS (
        SELECT a.conv_id, a.last_turn, coalesce(b.reply, '') AS reply FROM replies a LEFT JOIN replies b ON xor(b.conv_id, 1) = a.conv_id
    ),
    lost AS (
        SELECT t.conv_id, t.turn, t.role, t.text FROM turns t LEFT JOIN ends e USING (conv_id) WHERE e.last_turn IS NULL OR t.turn < e.last_turn
        UNION ALL SELECT conv_id, last_turn, 'assistant', reply FROM ends
    ),
    c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, role, text FROM turns),
    r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, role, text FROM lost),
    differ AS (
        SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.place, r.place)) - 1 AS n
        FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.place = r.place AND c.role = r.role AND c.text = r.text
        WHERE c.place IS NULL OR r.place IS NULL GROUP BY 1
    ),
    shared AS (SELECT k.conv_id, coalesce(d.n, k.n) AS n FROM (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id) k LEFT JOIN differ d USING (conv_id)),
    shown AS (
        SELECT conv_id, place, role, text, 'c' AS side, '<|im_start|>' || role || chr(10) AS head FROM c
        UNION ALL SELECT conv_id, place, role, text, 'r', '<|im_start|>' || role || chr(10) FROM r
    ),
    parts AS (
        SELECT conv_id, n,
            coalesce(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY place) FILTER (side = 'c' AND place <= n), '') AS prompt,
            coalesce(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY place) FILTER (side = 'c' AND place > n), '') AS chosen,
            coalesce(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY place) FILTER (side = 'r' AND place > n), '') AS rejected,
            coalesce(sum(length(text) + 11) FILTER (side = 'c' AND place > n AND role = 'assistant'), 0) AS chosen_trained,
            coalesce(sum(length(text) + 11) FILTER (side = 'r' AND place > n AND role = 'assistant'), 0) AS rejected_trained
        FROM shown JOIN shared USING (conv_id) GROUP BY conv_id, n
    )
    SELECT conv_id, CAST(n AS INTEGER) AS shared_turns, md5(prompt) AS prompt_md5, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5,
        CAST(length(prompt) AS BIGINT) AS prompt_chars, CAST(chosen_trained AS BIGINT) AS chosen_trained, CAST(rejected_trained AS BIGINT) AS rejected_trained
    FROM parts
    """,
)
def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference pair per conversation against one with a borrowed last reply, as digests."""
    chosen, rejected = preferences.borrowed_replies(table(spark, sf_dir, "conversations"))
    pairs = preferences.preference_pairs(chosen, rejected, "conv_id")
    trained = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + F.when(s["trained"], s["stop"] - s["start"]).otherwise(0))
    digests = [F.md5(F.encode(c, "UTF-8")).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")]
    sums = [trained(F.col(f"{c}_spans")).alias(f"{c}_trained") for c in ("chosen", "rejected")]
    return pairs.select("conv_id", "shared_turns", *digests, F.char_length("prompt").cast("long").alias("prompt_chars"), *sums)


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data."""
    return pii.pseudonymized(table(spark, sf_dir, "documents"))


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and copies of every document for a mix by labelled domains."""
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixer, members = mixing.fit(table(spark, sf_dir, "documents"), labels, mixing.MIX, "good")
    return mixing.rates_of(members, mixer)


@query("op7_embedding_dedup")
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.9 or more."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    coded = bpe_codec.decode(bpe_codec.encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on every document."""
    return quality.quality(table(spark, sf_dir, "documents")).drop("repeat_spans")


@query("op11_substring_dedup")
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that start earlier in the corpus, as digests."""
    left = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


HARD_NEGATIVES_SQL = """
    WITH usable AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, c -> CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, c -> c IS NULL OR NOT isfinite(c))) = 0
    ),
    scored AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id,
            CAST(list_sum(list_transform(list_zip(a.x, b.x), p -> p[1] * p[2])) AS BIGINT) AS score
        FROM usable a JOIN usable b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ),
    positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
    QUALIFY row_number() OVER w <= 5
"""


@query("op12_hard_negatives", HARD_NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score 80 to 100 % of a positive's score with the anchor."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 largest whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
