"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, fingerprints, language_id, line_dedup, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, source_audit, sql, token_counts, whitening
from tidemark.llm.text import remainder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 1
    scored = lm_scoring.score_documents(docs, docs.filter(~held_out), RANKS, public_tokenizers.PATTERN)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), BYTES, batch_bytes=4 << 20).drop("ids")
    packed = packing.pack_pieces(pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(F.col(f"rules.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    found = language_id.identify(docs, docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: The conversation that op10 adds: both turns say this.
TRICKY = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn int, role string, text string")
    added = added.select(*(F.col(f.name).cast(f.dataType) for f in turns.schema))
    chats = chat_format.format_chats(turns.unionByName(added), BYTES)
    kind = chats.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = chat_format.coder(BYTES)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for ids, mask in zip(batch.column("ids").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                said, loss, rendered = chat_format.read_turns(np.array(ids, np.int64), np.array(mask, bool), tool)
                whole = "".join(f"{role}\n{text}\n" for role, text in said)
                for column, value in zip(out, (len(said), _sha(whole), len(loss), _sha(loss), len(rendered)), strict=True):
                    column.append(value)
            columns = [pa.array(x, pa.string() if i in (1, 3) else pa.int64()) for i, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_audit(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), out="lines")
    kept = line_dedup.kept_text(F.col("text"), F.col("lines.keep"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_source_mix": op4_source_mix,
        "op5_fingerprints": op5_fingerprints,
        "op6_token_counts": op6_token_counts,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_quality_rules": op8_quality_rules,
        "op9_language_id": op9_language_id,
        "op10_chat_format": op10_chat_format,
        "op11_source_audit": op11_source_audit,
        "op12_line_dedup": op12_line_dedup,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mix": sql.OP4, "op8_quality_rules": sql.OP8, "op11_source_audit": sql.OP11, "op12_line_dedup": sql.OP12}
