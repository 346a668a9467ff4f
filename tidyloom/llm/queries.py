"""Queries opN_<name>: each operator over its whole table, with its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.catalog.common import table
from tidyloom.llm import chat, conversation_repair, filter_audit, licences, mixing
from tidyloom.llm.context_tree import ctw_scores
from tidyloom.llm.fingerprints import edited_fingerprints
from tidyloom.llm.kd_shards import kd_shards
from tidyloom.llm.neighbours import nearest_inner
from tidyloom.llm.ngram_join import ngram_join
from tidyloom.llm.packing import pack_documents
from tidyloom.llm.toxicity import fit_toxicity, held_out, score_toxicity, training_labels
from tidyloom.llm.wacz import fresh_root, read_archives, write_archives
from tidyloom.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return add


@query("op1_projected_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op2_winnowing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op3_source_mix", mixing.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, mixing.word_count(F.col("text")), narrow=True).drop("takes")


@query("op4_kd_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        (F.octet_length(text) / F.greatest(F.length(text), F.lit(1))).alias("width"),
    )
    dims = {
        "length": F.log(F.col("size").cast("double")),
        "script": F.col("width"),
        "content": F.col("text_crc32"),
    }
    return kd_shards(rows, dims, F.col("size"), F.col("text_crc32"), leaves=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_licence_digests", licences.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


@query("op8_balanced_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op9_chat_parts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), told.alias("text"),
    )
    done = chat.format_conversations(rows.unionByName(extra))
    back = chat.read_back(F.col("formatted"), F.col("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumns(back).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(F.array_join("loss_texts", "")).cast("bigint").alias("loss_chars"),
        F.sha2(F.array_join("loss_texts", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op10_web_archives")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_root(ensure_checkpoint_dir(spark))
    manifest = write_archives(table(spark, sf_dir, "pages"), root)
    return read_archives(spark, manifest, root, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op11_filter_audit", filter_audit.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_context_tree")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return ctw_scores(table(spark, sf_dir, "documents"), held)


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_conversations(rows).drop("roles")
