"""The corpus pipeline over the documents table: each stage is one operator, and its decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet in the
shared folder of the cluster and reads it again as the docs of the next. All stages but the last return the columns of
docs. A null id is never in a group of near duplicates; null texts are scored as empty and otherwise pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import bpe, components, contamination, jaccard_join, pii, quality

#: Documents that score less go. op9's decision is stricter (0.7); the README has the error rates of both.
QUALITY_THRESHOLD = 0.5
#: Ids (of 8 bytes) that may be broadcast.
BROADCAST_IDS = 1 << 20
#: SQL can express neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, fitted on the labelled documents, rejects."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_documents(docs, machine, QUALITY_THRESHOLD)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five words, 0.8), once."""
    with_id = docs.filter("doc_id is not null")
    if with_id.groupBy("doc_id").count().filter("count > 1").isEmpty():
        groups = jaccard_join.near_duplicates(docs, width=5, percent=80)
        gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        table = components.cut(gone)
        # Few ids go to every task, so that the texts need no shuffle; more are joined.
        gone = F.broadcast(table) if table.count() <= BROADCAST_IDS else table
        out = with_id.join(gone, with_id["doc_id"] == gone["_gone"], "left_anti")
    else:
        # An id may stand for unlike texts: rows are grouped by a 64-bit hash of id and text, and of several with the
        # smallest id of a group the first by content stays.
        keyed = with_id.withColumn("_key", F.xxhash64("doc_id", "text"))
        groups = jaccard_join.near_duplicates(keyed, width=5, percent=80, id_col="_key").select("_key", F.col("component_id").alias("_group")).distinct()
        least = keyed.select("doc_id", "_key").join(groups, "_key").groupBy("_group").agg(F.min("doc_id").alias("doc_id"))
        rest = [c for c in docs.columns if c != "doc_id"]
        out = keyed.join(groups, "_key").join(least, ["_group", "doc_id"], "left_semi").groupBy("_group").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(*rest)).alias("_r")).select("doc_id", "_r.*")
    return out.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every passage of eight words or more shared with a benchmark item."""
    return contamination.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return pii.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with its columns."""
    return bpe.append_tokens(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram jaccard join", near_duplicate_filter),
    ("benchmark decontamination", decontaminate),
    ("pii", redact_pii),
    ("bpe encoding", encode),
]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    components.ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs
