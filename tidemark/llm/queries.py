"""The queries of the text operators and their SQL; each reads whole tables and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.piece_tokens import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


SHORTER = (200, 64)  # op1's n_repeated: fifty words are about 300 bytes, which its window of 400 does not see


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import Workspace
    from tidemark.llm.suffix_merge import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), Workspace(spark, "suffixes"), shorter=SHORTER)


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def remainder(column: str, n: int):
    """crc32 of an id written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import Workspace
    from tidemark.llm.url_filter import judge

    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), Workspace(spark, "urls"), RULES, keep=["page_id"])
    return out.withColumn("purity", F.round("purity", 9))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import Workspace
    from tidemark.llm.katz import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    out = score(docs, ~held, Workspace(spark, "katz"), order=3, least=1, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import score, train

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels), keep=["doc_id"])
    return out.select("doc_id", "expected_grade", F.element_at("p_above", 1).alias("p_not_toxic"), F.element_at("p_above", 2).alias("p_good"), (F.element_at("p_above", 2) >= 0.5).alias("kept"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import Workspace
    from tidemark.llm.suffix_tree import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), Workspace(spark, "trees"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import Workspace
    from tidemark.llm.ngram_join import jaccard_components

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, Workspace(spark, "jaccard")).select("doc_id", "n_shingles", "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import learn, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    names, ranks = learn(docs.where(~held))
    out = predict(docs.select("doc_id", "text"), names, ranks, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import Workspace
    from tidemark.llm.embedding_dedup import near_links

    return near_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Workspace(spark, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import Workspace
    from tidemark.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Workspace(spark, "whitening"), keep=["vec_id"])


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.common import Workspace
    from tidemark.llm.token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, Workspace(spark, "counts"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.common import Workspace
    from tidemark.llm.token_alignment import align

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, Workspace(spark, "alignment"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array": op1_suffix_array,
        "op2_url_filter": op2_url_filter,
        "op3_decontaminate": op3_decontaminate,
        "op4_katz": op4_katz,
        "op5_quality": op5_quality,
        "op6_suffix_tree": op6_suffix_tree,
        "op7_jaccard": op7_jaccard,
        "op8_language": op8_language,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_embeddings": op10_embeddings,
        "op11_whitening": op11_whitening,
        "op12_token_counts": op12_token_counts,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the result at a bearable cost; the others are tested against plain versions."""
    from tidemark.llm import sql

    return {
        "op2_url_filter": sql.url_filter(RULES),
        "op6_suffix_tree": sql.EARLIER_WORDS,
        "op7_jaccard": sql.JACCARD,
        "op10_embeddings": sql.EMBEDDINGS,
    }
