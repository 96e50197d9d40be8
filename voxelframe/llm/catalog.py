"""The registered queries of the language-model data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import hamming, lattice, lines, packing, piece_bpe, pii, quality, sharding, toxicity, warc
from voxelframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_MODEL)


SHARDS = [f"shard-{k:03d}" for k in range(sharding.SHARDS)]


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "shard_slot", "shard_id", "shard")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


ORACLE["op5_quality_rules"] = quality.ORACLE_SQL


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return toxicity.score_documents(docs if model.counted is None else model.counted, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.clean_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "site", "n_lines", "n_dropped", F.sha2(F.col("clean_text").cast("binary"), 256).alias("text_sha256"))


ORACLE["op7_line_dedup"] = lines.ORACLE_SQL


@query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hamming.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hamming.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# exact here: every linked pair is found on tables of this kind (recall is measured in the tests); a join of all pairs, for small tables only
ORACLE["op8_embedding_near_dedup"] = """with recursive v as (select vec_id, embedding, list_filter(cast(embedding as double[]), lambda x: x is not null) e from embeddings),
g as (select * from v where len(e) = len(embedding) and len(list_filter(e, lambda x: isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from g a join g b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id a, vec_id b from v union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) n from l group by 1), c as (select a, min(b) m from r group by 1)
select vec_id, coalesce(n.n, 0) n_links, c.m component_id, c.m = vec_id kept from v left join n on n.a = vec_id left join c on c.a = vec_id"""

ORACLE["op10_warc"] = """with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n, max(page_id) over (partition by coalesce(html, '')) m from pages)
select page_id, n payload_bytes, sha1(h) payload_digest, case when n >= 1000 and page_id <> m then 'revisit' else 'response' end record_type, case when n >= 1000 and page_id <> m then m end refers_to from p"""
