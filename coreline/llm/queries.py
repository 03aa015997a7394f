"""The registered queries of this package; each applies one operator to its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreline.llm import chat_tree, hard_negatives, line_dedup, mixing
from coreline.llm.common import documents

QUERIES = {}
ORACLES = {}


def query(fn=None, *, sql: str | None = None):
    """Register a query, with its SQL twin where there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add(fn) if fn else add


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    from coreline.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1).drop("ids")


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as a token file and read back."""
    import public_tokenizers

    from coreline.llm.token_files import read_token_file, write_token_file

    path = write_token_file(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_file(spark, path).drop("ids")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, line and repetition measures of all documents, and the verdict."""
    from coreline.llm.repetition import quality_measures

    found = quality_measures(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars",
        "longest_repeat", "base_failed", "kept",
    )


@query(sql=line_dedup.ORACLE)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines under later occurrences of three-line windows."""
    found = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.selectExpr("doc_id", "__n_lines AS n_lines", "__n_removed AS n_removed", "__kept AS kept_text")


@query(sql=mixing.ORACLE)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_report(documents(spark, sf_dir))


@query
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    from coreline.llm.winnowing import fingerprint_report

    return fingerprint_report(documents(spark, sf_dir))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of known licenses in all documents."""
    from coreline.llm.licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes under 50-byte strings of earlier documents."""
    from coreline.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), keep=False).drop("kept")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles are alike."""
    from coreline.llm.jaccard_tree import jaccard_components

    return jaccard_components(documents(spark, sf_dir)).drop("d1")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    from coreline.llm.toxicity import toxicity_scores

    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' ids of all documents."""
    import public_tokenizers

    from coreline.llm.alignment import align_tokens

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokens(documents(spark, sf_dir), *paths)


@query(sql=hard_negatives.ORACLE)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of all anchors, near their positives in score."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, label=label)


@query(sql=chat_tree.ORACLE)
def op13_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, written as prefix trees and read back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    hostile = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string"
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat_tree.read_chat_tree(spark, chat_tree.write_chat_tree(rows.unionByName(more), path), path)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of the filtered, deduplicated and mixed documents."""
    return corpus_pipeline.run(spark, sf_dir)
