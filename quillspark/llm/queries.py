"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversation_repair, exact_dedup, html_extract, near_dedup, packing, piece_bpe, quality_cnn, quality_rules, suffix_dedup, token_counts, toxicity, url_filter
from .common import materialise, table


def tokenizer_paths() -> dict[str, str]:
    """Where the public vocabulary files lie on this machine; they're parameters of the operators."""
    import public_tokenizers

    return {
        "json_path": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
        "piece_path": public_tokenizers.path("piece_bpe_32k.model"),
    }


def _byte_bpe() -> dict[str, str]:
    return {k: v for k, v in tokenizer_paths().items() if k != "piece_path"}


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_paths()["piece_path"])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups_of_equal_text(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), **_byte_bpe())


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_texts(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), **_byte_bpe())
    return token_counts.context_table(materialise(token_counts.length_histogram(lengths), "length-histogram"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


#: Of four parts of the ids by crc32, the one that is held out from training.
HELD_OUT = 2


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality_cnn.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = quality_cnn.score_documents(docs, net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passage_digests(table(spark, sf_dir, "documents"), length=200)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = toxicity.score_documents(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_sentences", "worst_start", "worst_score"
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_reports(rows, alive=F.col("alive"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


def queries() -> dict:
    own = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op12_conversation_repair": conversation_repair.oracle(), "op13_collocations": collocations.ORACLE}
