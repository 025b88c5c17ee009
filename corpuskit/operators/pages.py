"""From texts to pages, lines, words and positioned runs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpuskit.functions.text import SPACE_SET, tokenize


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def paginate(docs: DataFrame, lines_per_page: int = 10, text: str = "text") -> DataFrame:
    """One row per page of ``lines_per_page`` lines; ``page_no`` from 0. No shuffle."""
    n = lines_per_page
    lines = split_lines(F.col(text))
    others = [c for c in docs.columns if c != text]
    cut = docs.select(*others, lines.alias("_lines"))
    pages = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("_lines") / n).cast("int") - 1),
        lambda p: F.array_join(F.slice(F.col("_lines"), p * n + 1, F.lit(n)), "\n"),
    )
    return cut.select(*others, F.posexplode(pages).alias("page_no", text))


def page_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


WORDS_AT_ONCE = 1 << 16
_WORD = StructType([
    StructField("line_no", IntegerType()), StructField("word_no", IntegerType()),
    StructField("str", StringType()), StructField("off", IntegerType()),
])


def page_words(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per page with its words: line, place in the line, text and character offset in it.

    Rows are independent, so this is one pass over Arrow batches without a shuffle. What is held
    at once is a bounded number of words, or one page.
    """
    others = [c for c in pages.columns if c != text]
    word = re.compile(f"[^{SPACE_SET}]+")
    kind = pa.struct([("line_no", pa.int32()), ("word_no", pa.int32()), ("str", pa.string()), ("off", pa.int32())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done = batch.column(len(others)), 0
            ends, line_no, word_no, strs, offs = [0], [], [], [], []
            for i in range(len(texts)):
                for ln, line in enumerate((texts[i].as_py() or "").split("\n")):
                    found = list(word.finditer(line))
                    line_no += [ln] * len(found)
                    word_no += range(len(found))
                    strs += [m[0] for m in found]
                    offs += [m.start() for m in found]
                ends.append(len(strs))
                if len(strs) >= WORDS_AT_ONCE or i + 1 == len(texts):
                    words = pa.StructArray.from_arrays(
                        [pa.array(c, t.type) for c, t in zip((line_no, word_no, strs, offs), kind)], fields=list(kind)
                    )
                    keys = [batch.column(k).slice(done, i + 1 - done) for k in range(len(others))]
                    yield pa.RecordBatch.from_arrays(
                        [*keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)], names=[*others, "words"]
                    )
                    done = i + 1
                    ends, line_no, word_no, strs, offs = [0], [], [], [], []

    schema = StructType([*pages.select(*others).schema.fields, StructField("words", ArrayType(_WORD))])
    return pages.select(*others, text).mapInArrow(kernel, schema)


def word_runs(pages: DataFrame, text: str = "text") -> DataFrame:
    """The words of each page with line, place in the line and character offset in it."""
    return page_words(pages, text).select(*[c for c in pages.columns if c != text], F.inline("words"))


def pages_without_text(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.filter(F.size(tokenize(F.col(text))) == 0)
