"""A corpus pipeline of five stages; each is written as Parquet and read again for the next.

The quality classifier and decontamination drop documents, line dedup cuts lines out of texts,
near-dedup keeps one document of each group, and the last stage returns the encoded corpus.

Every stage takes texts of any length whole. A null text counts as empty; an empty table passes as
such; columns beside those of documents stay, except in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.common import cut, read, shared_folder
from sievewright.llm.line_templates import Rules, without_templates
from sievewright.llm.pieces import segment
from sievewright.llm.pu_quality import fit_quality, keep_quality
from sievewright.llm.qgram import decontaminate
from sievewright.llm.resemblance import resemblance_components


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold, repeated rows each; all where there is nothing to learn from."""
    net, _ = fit_quality(spark, docs, read(spark, sf_dir, "labels"))
    return keep_quality(docs, net)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates; n_chars, where there is one, follows the text.

    Templates only: without the long lines that two documents share, a near copy would come down to the
    lines it changed, and near-dedup could no longer tell what it is a copy of.
    """
    out = without_templates(spark, docs, Rules(long_tokens=None))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more).

    Candidates come from the covering tables over SimHash fingerprints and from minimum hashes beside
    them; each is decided on its whole shingle sets.
    It is the one of least id, a null id last; of equal ids the one of least text hash, then of least row number.
    """
    row = next(n for n in (f"row_{i}" if i else "row" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    numbered = cut(spark, docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    slim = numbered.select(F.col(row).alias("row"), "doc_id", "text")
    of = slim.select("row", "doc_id", F.xxhash64("text").alias("h")).join(resemblance_components(spark, slim.select("row", "text")), "row")
    first = of.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "row")).alias("f")).select(F.col("f.row").alias(row))
    return numbered.join(first, row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, items of null id included."""
    return decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, the scores of its best segmentations, and the digest of what the ids decode to."""
    return segment(docs, n=4).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: A fitted network and the network-free stages behind it are no SQL; tests replay them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage for the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
