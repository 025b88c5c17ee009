"""Streams of documents: pattern scan and a search index that grows batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.operators.pages import paginate
from corpuskit.operators.redact import scan_patterns
from corpuskit.operators.search import build_index


def stream_patterns(docs: DataFrame, lines_per_page: int = 10) -> DataFrame:
    """Hits of every arriving page; stateless, append mode."""
    return scan_patterns(paginate(docs, lines_per_page))


def stream_index(docs: DataFrame, path: str, checkpoint: str, lines_per_page: int = 10):
    """A writer that indexes arriving documents (doc_id, text, readable).

    Every micro-batch writes its own folders, over itself if it is run again, so a lost executor
    or a restart changes nothing. The newest batch that names a document holds its postings;
    an unreadable version takes the document out of the index.
    """
    def write(batch: DataFrame, number: int) -> None:
        seen = batch.select("doc_id", "readable", F.lit(number).cast("bigint").alias("batch"))
        seen.write.mode("overwrite").parquet(f"{path}/seen/batch_id={number}")
        pages = paginate(batch.filter("readable").select("doc_id", "text"), lines_per_page)
        build_index(pages).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(
            f"{path}/postings/batch_id={number}"
        )

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_stream_index(spark: SparkSession, path: str) -> DataFrame:
    """Postings of the newest version of every readable document."""
    seen = spark.read.parquet(f"{path}/seen")
    newest = seen.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by("readable", "batch").alias("ok"))
    postings = spark.read.parquet(f"{path}/postings")
    return postings.join(newest.filter("ok").select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch", "batch_id")
