import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def docs_of(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source) as a documents table."""
    full = [
        (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows
    ]
    return spark.createDataFrame(full, DOCS)


def odd_docs(spark, rows):
    """The same with columns whose names clash with what operators add, use or need escaped."""
    from pyspark.sql import functions as F

    extra = ("key fingerprint fp root component_id n_words kept runs lines n_removed base terms matches items c0 "
             "_rank _text_key _host _held token_ids lang_pred score held_out edits n_edits host u v").split()
    df = docs_of(spark, rows).select("*", *[F.lit("x").alias(c) for c in extra])
    return df.withColumn("a.b", F.lit(1)).withColumn("tick`s", F.lit(2))


@pytest.fixture(scope="session")
def edge_rows():
    return [
        (None, None), (None, "one two three four five"), (1, ""), (2, "   \n\t "), (3, "x"), (3, "x"), (3, "y z"),
        (4, "word " * 30000), (5, "été \U0001f600 naïve\n\nline"), (None, None), (6, "a" * 200000),
    ]
