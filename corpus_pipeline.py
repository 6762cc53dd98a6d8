"""A training corpus from raw documents, in five stages; each works on what the one before it kept.

1. Toxic documents go. 2. Repeated lines go, exact or nearly equal. 3. Of near copies one document stays.
4. Secrets are replaced. 5. What is left is packed into windows of tokens, mixed by source.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import lines, packing, secrets, simhash, toxicity
from eventloom.llm.batches import held_out
from eventloom.llm.queries import piece_digests
from eventloom.session import fresh_path

TOKENIZER = "word_bpe_49k.json"


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; it learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    scored = toxicity.add_score(docs, model, "__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before; one that had nothing else goes."""
    clean = lines.dedup_lines(docs, dropped_column="__gone", every_pair=True)
    some = (F.size("__gone") == 0) | (F.trim("text") != "")
    return _with_text(clean.where(F.coalesce(some, F.lit(True))), docs, F.col("text"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by their fingerprints the one with the smallest id; a row goes by its id and text."""
    groups = simhash.near_duplicates(docs)
    gone = groups.where("id <> component").select(F.col("id").alias("gone_id"), F.col("copy").alias("gone_copy")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_copy"))
    same = (F.col("own_id") == F.col("gone_id")) & (F.col("own_copy") == F.col("gone_copy"))
    return rows.join(gone, same, "left_anti").select("row.*")


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in them replaced by its kind in brackets."""
    ledger = secrets.BlobLedger(spark, fresh_path(spark, "secret-ledger"))
    return _with_text(secrets.redact(ledger, docs), docs, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens, with digests of their ids."""
    return piece_digests(packing.pack(docs, public_tokenizers.path(TOKENIZER)))


def _with_text(table: DataFrame, like: DataFrame, text) -> DataFrame:
    """The columns of ``like``, with the new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return table.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in like.columns])


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("near-dedup", keep_one_of_near_copies),
    ("secrets", replace_secrets),
    ("packing", pack),
]

# Models, token ids and connected groups: tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
