"""One registered query for each operator: its whole table, production parameters, digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, chat, divergence, lines, lm, multi_index, packing, repair, secrets, sharding, simhash, topk, toxicity
from eventloom.llm.batches import held_out
from eventloom.session import fresh_path

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    ledger = secrets.BlobLedger(spark, fresh_path(spark, "secret-ledger"))
    found = secrets.scan_documents(ledger, _table(spark, folder, "documents"))

    def count(kind: str):
        return F.size(F.filter("found", lambda f: f["rule"] == kind)).cast("long").alias(f"n_{kind}")

    listed = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["rule"], f["start"], f["end"])), ",")
    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans")
    )


@query
def op3_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    return piece_digests(packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        F.col("sequence").alias("sequence_id"),
        "offset",
    )


@query
def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    found = topk.exact_top_k(rows.where("vec_id % 50 = 0"), rows)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = multi_index.near_duplicates(_table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.learn(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    scored = toxicity.score(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query
def op6_fuzzy_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"),
    )


@query
def op7_preference_formatting(spark: SparkSession, folder: str) -> DataFrame:
    found = chat.preference_segments(chat.swapped_replies(_table(spark, folder, "conversations")))
    return found.select(
        F.col("pair_id").alias("conv_id"), "part", "position", "role", F.sha2("segment", 256).alias("segment_sha256"), "trained_from", "trained_to"
    )


@query
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence_audit(_table(spark, folder, "documents"))


@query
def op12_virtual_slot_sharding(spark: SparkSession, folder: str) -> DataFrame:
    slot_map = sharding.SlotMap(spark, fresh_path(spark, "slot-map"))
    found = sharding.assign_shards(_table(spark, folder, "documents"), slot_map)
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _table(spark, folder, "conversations")
    repaired = repair.Repair(repair.damaged(conversations))
    found = repaired.report().join(repaired.digests(), "conversation", "left")
    every = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conversation")).distinct()
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conversation", "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
