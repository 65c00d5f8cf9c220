"""One query per operator, over its whole table with production parameters, and the SQL of some of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    decontaminate,
    jaccard,
    language,
    lexical,
    licences,
    line_templates,
    merkle,
    mixing,
    quality,
    repeats,
    token_files,
    url_filter,
)
from tidemark.llm.scratch import cut, remove
from tidemark.session import shared_folder

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """Id and text of a document as one value, so that rows with the same id are told apart."""
    text = F.coalesce(F.concat(F.lit("="), "text"), F.lit(""))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of the documents such that each source has a share by the root of its size."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tempered_weights(docs))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def token_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents' ids written to a new file set, and what reading it back gives."""
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    token_files.write_ids(docs, folder, public_tokenizers.path(TOKENIZER))
    found = token_files.documents(spark, folder)
    rows = cut(found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("id_bytes").alias("ids_crc32")))
    remove(spark, folder)
    return rows


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark, _table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


HELD_OUT = "crc32(cast(doc_id AS string)) % 4 = 2"


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out; a null doc_id is not held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.expr(HELD_OUT), F.lit(False))
    found = language.identify(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.hit_counts(found)


BYTE_TOKENIZER = "byte_bpe_50k.json"


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_TOKENIZER)
    decoded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


TAMPERED = "crc32(cast(doc_id AS string)) % 7 = 0"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest is written, proofs are read from it, and some rows claim another number of characters."""
    docs = _table(spark, sf_dir, "documents")
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    claim = F.when(F.expr(TAMPERED), merkle.leaf(doc_id, source, lang, n_chars + 1, text))
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    leaf = merkle.leaf(doc_id, source, lang, n_chars, text)
    proofs = merkle.write_manifest(docs, folder, leaf, claim=claim).proofs()
    checked = merkle.folded(proofs.withColumn("claim", F.coalesce("claim", "leaf")), "claim")
    names = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof_sha256": "path_digest", "folded_root": "folded_root"}
    digests = (merkle.hex_text(F.col(column)).alias(name) for name, column in names.items())
    found = cut(checked.select(F.col("id").alias("doc_id"), *digests, (F.col("folded_root") == F.col("root")).alias("verified")))
    remove(spark, folder)
    return found


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_mix_sources": op2_mix_sources,
    "op3_licence_scan": op3_licence_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_repeated_bytes": op6_repeated_bytes,
    "op7_token_ids": op7_token_ids,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lexical_search": op13_lexical_search,
}
