"""Delimited text and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import csv_escape, tsv_cell


def delimited_rows(cells: DataFrame, keys: list[str], sep: str = ",") -> DataFrame:
    """One text line per row of a cell table (keys, row_no, col_no, value), cells escaped."""
    cell = csv_escape(F.col("value")) if sep == "," else tsv_cell(F.col("value"))
    per = cells.groupBy(*keys, "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", cell.alias("c")))).alias("_c"))
    return per.select(*keys, "row_no", F.array_join(F.transform("_c", lambda x: x["c"]), sep).alias("line"))


def write_delimited(cells: DataFrame, keys: list[str], path: str, sep: str = ",") -> None:
    """Text files of lines in (keys, row) order, range-partitioned so that no task holds all."""
    rows = delimited_rows(cells, keys, sep)
    rows.repartitionByRange(*keys, "row_no").sortWithinPartitions(*keys, "row_no").select("line").write.mode(
        "overwrite"
    ).text(path)


def write_report(reports: DataFrame, path: str, key: str = "doc_id", text: str = "report") -> None:
    """One folder of text per document bucket; a report is one record with its line breaks."""
    bucket = F.pmod(F.xxhash64(key), F.lit(256)).cast("int")
    reports.select(F.col(text).alias("value"), bucket.alias("bucket")).write.mode("overwrite").option(
        "lineSep", "\n"
    ).partitionBy("bucket").text(path)
