"""The queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (
    conversations,
    embed_dedup,
    langid,
    merkle,
    minhash,
    mixing,
    oracle_text,
    oracles,
    packing,
    pu_quality,
    quality_rules,
    shards,
    subwords,
    texts,
    url_filter,
    warc,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(oracles.url_filter_sql())
def op10_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), ["page_id"])


@register()
def op1_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return shards.read_shards(docs, shards.write_shards(docs)).select(
        "doc_id", shards.size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", shards.shard_of(F.col("doc_id"), 17, 17).alias("grown_shard"))


@register()
def op3_quality_rules(spark, sf_dir):
    return quality_rules.judge(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("_row.*", "*").drop("_row")


@register()
def op4_pu_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pu_quality.score(docs, table(spark, sf_dir, "labels"), ["doc_id"]).select(
        "_row.doc_id", texts.held_out("_row.doc_id").alias("held_out"), "score", "predicted")


@register()
def op9_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, ["doc_id"]).select(
        "doc_id", texts.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@register()
def op7_embedding_dedup(spark, sf_dir):
    return embed_dedup.dedup(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@register()
def op6_minhash(spark, sf_dir):
    return minhash.dedup(table(spark, sf_dir, "documents"), percent=85, width=3).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@register(oracles.packing_sql())
def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@register(oracles.warc_sql())
def op5_warc(spark, sf_dir):
    found = warc.resolve(warc.captures_of(table(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name].alias(name.replace("-", "_"))
    return found.select(
        F.substring("record_id", 2, 20).cast("long").alias("page_id"), "url", "ts", "status", "response_id",
        "response_ts", F.size(F.map_keys("headers")).cast("long").alias("n_headers"),
        *map(header, ("cache-control", "content-type", "date", "etag", "last-modified", "server")))


@register(oracles.mixing_sql())
def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select(
        "doc_id", "_mix.source", "_mix.lang", "_mix.topic", "_mix.n_tokens",
        F.round("_mix.rate", 6).alias("rate"), "_mix.taken")


@register()
def op11_sentencepiece(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = subwords.encode(table(spark, sf_dir, "documents"), model, ["doc_id"])
    digests = ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                         F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return subwords.decode(digests, model, ["doc_id", "n_tokens", "ids_sha256"]).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register(oracle_text.merkle_sql())
def op12_merkle(spark, sf_dir):
    coded = [merkle.coded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", merkle.digest(*coded, merkle.coded(F.col("text"))).alias("leaf"),
        F.when(hit, merkle.digest(*coded, merkle.coded(lowered))).alias("tampered"))
    found = merkle.manifest(docs, ["doc_id", "tampered"], "source", "doc_id", "leaf")
    root = merkle.folded(F.coalesce("row.tampered", "leaf"), F.col("path"))
    return found.select(
        "row.doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@register(oracle_text.conversations_sql())
def op13_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), every=rows)
