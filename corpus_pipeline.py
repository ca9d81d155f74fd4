"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. The
first four keep the columns of documents; the last returns the packed pieces. Rows with null or empty texts go in the first stage, which
asks for fifty words; near dedup judges every row by its own text, whatever doc_id it shares, and keeps rows without doc_id. An empty table
stays empty through every stage; columns beside doc_id, text and n_chars are carried as they are, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emergent.llm import lines, minhash, packing, quality, secret_scan
from emergent.session import checkpointed, shared_dir

#: SQL can't express the trained verdict of the first stage or the packing of the last. The tests hold the stages between against brute force,
#: and the operators of all five have brute-force tests of their own.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; n_chars follows the text."""
    stripped = lines.strip(lines.insert(None, docs), docs, counts=False)
    return stripped.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with a number ``row`` of each row that has a doc_id, in the order of doc_id; doc_id itself where none is repeated."""
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1").isEmpty():
        return docs.withColumn(row, F.col("doc_id"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(ordered.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first by doc_id, of each group of near-duplicates (five words, 0.8)."""
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    rows = _numbered(docs, row)
    verdict = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words=5, num=80, den=100)
    gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what lies between them is written in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
