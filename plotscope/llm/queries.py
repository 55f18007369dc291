"""The registered queries: each operator over its whole table, with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotscope.llm import (
    decontaminate,
    edit_prints,
    jaccard,
    mixing,
    packing,
    pii,
    quality,
    resampling,
    secrets,
    token_tree,
    topk,
    url_templates,
    vector_codes,
)
from plotscope.llm.common import written

# The rules that the URL verdicts are asked for with.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edits_of(text: str) -> F.Column:
    """Three edits that follow from the text: a replacement at a third, a word put in at
    two thirds, and the last five characters dropped."""
    n = f"length({text})"
    return F.expr(
        f"array(named_struct('at', {n} div 3, 'cut', 12, 'put', reverse(left({text}, 12))),"
        f" named_struct('at', 2 * {n} div 3, 'cut', 0, 'put', concat(' ', substring_index(left({text}, 64), ' ', 1), ' ')),"
        f" named_struct('at', greatest({n} - 5, 0), 'cut', 5, 'put', ''))"
    )


def op1_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return token_tree.edited_token_counts(
        docs.withColumn("edits", edits_of("text")),
        vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(table(spark, sf_dir, "documents"))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; ids travel no further than their checksum."""
    return pack_digest(table(spark, sf_dir, "documents"))


def pack_digest(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.best_fit(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.train_on_sample(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, net)


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, likenesses and the class of like documents, by bands and verification."""
    return edit_prints.with_classes(written(edit_prints.edit_fingerprints(table(spark, sf_dir, "documents"))))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows, by integer inner product, of every fiftieth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("vector"))
    return topk.exact_top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 8 parts, 16 entries each, after 6 rounds."""
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten words of a benchmark item."""
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the benchmark texts."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_edit_token_counts": op1_edit_token_counts,
    "op2_pii": op2_pii,
    "op3_url_templates": op3_url_templates,
    "op4_pivotal_mix": op4_pivotal_mix,
    "op5_best_fit": op5_best_fit,
    "op6_quality_cnn": op6_quality_cnn,
    "op7_edit_fingerprints": op7_edit_fingerprints,
    "op8_secrets": op8_secrets,
    "op9_jaccard": op9_jaccard,
    "op10_top_k": op10_top_k,
    "op11_vector_codes": op11_vector_codes,
    "op12_decontaminate": op12_decontaminate,
    "op13_resample": op13_resample,
}
