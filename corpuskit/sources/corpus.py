"""Reading corpora: folders of files, format classes, accepted and rejected inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """All files below ``path`` with the suffix (any case); ``file_id`` is the relative path."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    root = F.regexp_replace(F.lit(path.rstrip("/") + "/"), "^file:/*", "/")
    full = F.regexp_replace("path", "^file:/*", "/")
    file_id = F.substring(full, F.length(root) + 1, F.length(full))
    return files.select(
        file_id.alias("file_id"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("modificationTime").alias("last_modified"),
        F.col("length").alias("size"),
        "content",
    )


def sniff_format(content: Column) -> Column:
    """Format class by leading bytes."""
    head = F.substring(content, 1, 8)
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, F.lit("corrupt"))
        .when(F.hex(F.substring(head, 1, 4)) == "504B0304", F.lit("zip"))
        .when(F.hex(head) == "D0CF11E0A1B11AE1", F.lit("ole2"))
        .when(F.contains(F.substring(content, 1, 1024), F.lit("%PDF").cast("binary")), F.lit("pdf"))
        .otherwise(F.lit("other"))
    )


def refuse_reason(rules: list[tuple[Column, str]]) -> Column:
    """The first reason that applies, or NULL."""
    return F.coalesce(*[F.when(cond, F.lit(reason)) for cond, reason in rules])


def ingest_split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with a readable reason."""
    judged = df.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(
        F.col("reason").isNotNull()
    )


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a table has fewer splits than the session has cores.

    Tables of many splits pass through untouched, so nothing is shuffled at scale. Rows go round
    robin: a hash by key would let unions of such inputs claim a common partitioning.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
