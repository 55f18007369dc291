"""A training corpus from raw documents: stages written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotscope.llm import common, jaccard, mixing, quality, secrets
from plotscope.llm.queries import pack_digest, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects. It learns from the labelled ones of
    the raw documents outside the held-out fold."""
    net = quality.train_on_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, net)


#: Near copies of this stage: words of a shingle and the likeness in percent; op9's contract
#: has other values for its query.
NEAR_WIDTH = 5
NEAR_PERCENT = 80
#: Up to so many keys are broadcast to the documents; beyond, they are joined by shuffle.
FEW_KEYS = 1_000_000


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one whose key names the group.

    Rows are told apart by key and text, so of several texts under one key each goes with
    its own group; of those in one group the one with the smallest hash stays. Documents
    without words link with nothing and stay. Rows with a null key name no group and
    stay. Of rows that agree in key and text one stays.
    """
    mark = F.when(F.col("doc_id").isNotNull(), F.xxhash64("text"))
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", mark.alias("mark")))
    groups = common.cut_lineage(
        jaccard.jaccard_components(docs.select(row.alias("row"), "text"), "row", width=NEAR_WIDTH, percent=NEAR_PERCENT)
        .groupBy("row")
        .agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    )
    lead = groups.filter("row IS NULL OR row = component_id")
    lead = lead.select(F.col("row.doc_id").alias("lead"), F.col("row.mark").alias("lead_mark"))
    if lead.count() <= FEW_KEYS:
        lead = F.broadcast(lead)
    # The rows travel in one column, so that theirs may have any names.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), mark.alias("mark"))
    same = F.col("whole.doc_id").eqNullSafe(F.col("lead")) & F.col("mark").eqNullSafe(F.col("lead_mark"))
    kept = whole.join(lead, same, "left_semi").select("whole.*")
    if groups.filter("rows > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found; n_chars follows the text."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_digest(docs)


#: (name, function of (spark, docs, sf_dir)); all but the last return documents' columns.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The learned stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each result is written once to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{common.shared_folder(spark)}/pipeline-{uuid4().hex}-{i}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
