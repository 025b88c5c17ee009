"""Layout over pages as rows: no shuffle of words, bounded batches, and the same as over loose runs."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpuskit.operators import layout as L
from corpuskit.operators import pages as PG
from corpuskit.operators import sheets as SH


def loose(spark):
    rows = [
        (1, 0, 1, "Title", 18.0, 0.0, 700.0), (1, 0, 2, "of", 18.0, 200.0, 701.0), (1, 0, 3, "left", 12.0, 0.0, 680.0),
        (1, 0, 4, "right", 12.0, 24.0, 680.0), (1, 0, 5, "שלום", 12.0, 0.0, 660.0), (1, 0, 6, "עולם", 12.0, 60.0, 660.0),
        (1, 0, 7, None, 12.0, 300.0, 660.0), (2, 0, 1, " ", 12.0, 0.0, 10.0), (2, 1, 1, "alone in a long body", 12.0, 0.0, 10.0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, run_no long, str string, s double, x double, y double")
    zero = F.lit(0.0)
    return df.select("doc_id", "page_no", "run_no", "str", F.array("s", zero, zero, "s", "x", "y").alias("transform"), (F.length("str") * 6.0).alias("width"))


def test_lines_of_loose_runs_and_of_pages(spark):
    runs = loose(spark).withColumn("width", F.coalesce("width", F.lit(0.0)))
    got = {(r.doc_id, r.page_no, r.line_no): (r.text, r.is_heading, len(r.runs)) for r in L.layout_lines(runs).collect()}
    assert got == {
        (1, 0, 0): ("Title of", True, 2), (1, 0, 1): ("leftright", False, 2), (1, 0, 2): ("עולם שלום", False, 3),
        (2, 1, 0): ("alone in a long body", False, 1),
    }
    pages = SH.page_rows(runs)
    again = {(r.doc_id, r.page_no, r.line_no): (r.text, r.is_heading) for r in L.layout_lines(pages, keep_runs=False).collect()}
    assert again == {k: v[:2] for k, v in got.items()}


def test_pages_as_rows_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, 0, "a b\nc"), (2, 0, "d")], "doc_id long, page_no long, text string")
    words = PG.page_words(docs)
    runs = words.select("doc_id", "page_no", F.transform("words", lambda w: F.struct(
        w["word_no"].alias("run_no"), w["word_no"].cast("long").alias("seq"), w["line_no"].alias("line_no"), w["word_no"].alias("item_no"),
        w["str"].alias("str"), w["str"].alias("text"), (w["off"] * 6.0).alias("x"), F.lit(6.0).alias("width"), F.lit(12.0).alias("size"),
        F.lit(True).alias("bold"), F.lit(False).alias("italic"),
        F.array(F.lit(12.0), F.lit(0.0), F.lit(0.0), F.lit(12.0), w["off"] * 6.0, w["line_no"] * -20.0).alias("transform"),
    )).alias("runs"))
    for made in (L.layout_lines(runs), L.median_gap(runs), L.dominant_size(runs), L.merge_runs(runs), L.reading_order(runs)):
        assert made.count() and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.line_no, r.str) for r in L.merge_runs(runs).collect()} == {(1, 0, "a b"), (1, 1, "c"), (2, 0, "d")}


def test_words_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(PG, "WORDS_AT_ONCE", 1000)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(0).alias("page_no"), F.repeat(F.lit("w "), 300).alias("text")).coalesce(1)


    # batches that leave the kernel are small, whatever is in the one that comes in
    plain = PG.page_words(docs)
    assert plain.select(F.sum(F.size("words"))).first()[0] == 60_000
    kernel = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, k, s: kernel.append(k) or self)
    PG.page_words(docs)
    whole = pa.RecordBatch.from_pandas(docs.toPandas())
    assert max(len(b.column(2).flatten()) for b in kernel[0](iter([whole]))) <= 1300


def test_the_first_of_lines_of_one_number_is_shown(spark):
    cells = spark.createDataFrame([], "doc_id long, page_no long, table_no long, row_no long, col_no long, value string")
    rows = [(1, 0, 5, "first", 0), (1, 0, 5, "second", 1), (1, 0, 6, "third", 2)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no long, line_no long, text string, seq long").coalesce(1)
    assert L.workbook_plan(cells, lines, True)[0].first().preview == "first"


def test_blocks_are_made_in_one_pass_of_the_layout(spark):
    from corpuskit.checks import load

    for name in ("page_blocks", "page_blocks_tables"):
        df = load().QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # one kernel for the words, one for the lines
        assert plan.count("MapInArrow") == 2, plan


def test_blocks_know_their_lines_and_characters(spark):
    fields = "doc_id long, page_no long, line_no long, text string, max_size double, body_size double, starts_paragraph boolean, is_heading boolean"
    lines = spark.createDataFrame([
        (1, 0, 0, "Title", 18.0, 12.0, False, True), (1, 0, 1, "ab", 12.0, 12.0, False, False),
        (1, 0, 2, "cde", 12.0, 12.0, False, False), (1, 0, 3, "x", 12.0, 12.0, True, False), (1, 0, 4, "y", 12.0, 12.0, False, False),
    ], fields)
    tables = spark.createDataFrame([(1, 0, 3, 4)], "doc_id long, page_no long, start_line long, end_line long")
    got = L.page_blocks(lines, tables).orderBy("block_no").collect()
    assert [(r.kind, r.text, r.n_lines, r.n_chars) for r in got] == [
        ("heading", "Title", 1, 5), ("paragraph", "ab cde", 2, 6), ("table", None, None, None),
    ]


def test_words_of_texts_are_runs_within_one_kernel(spark):
    rows = [(1, 0, "a\u00a0bc\n\n  d\U0001f600e f"), (1, 1, None), (2, 0, ""), (2, 1, "x"), (3, 0, "\u3000\n"), (3, 1, "é\u2003ü\r\nz ")]
    docs = spark.createDataFrame(rows, "doc_id long, page_no long, text string").coalesce(1)
    want = [
        (r.doc_id, r.page_no, w.line_no, w.word_no, w.str, w.off, len(w.str))
        for r in PG.page_words(docs).orderBy("doc_id", "page_no").collect() for w in r.words
    ]
    texts = pa.array([r[2] for r in rows])
    for lo in (0, 3):
        page, w = SH.words_of(texts.slice(lo))
        got = [(*rows[p + lo][:2], *x) for p, *x in zip(page.tolist(), *[w[c].tolist() for c in ("line_no", "word_no")], w["str"].to_pylist(), w["off"].tolist(), w["chars"].tolist())]
        assert got == [x for x in want if x[:2] >= rows[lo][:2]]

    from corpuskit.checks import load

    # runs made of words do not go through the JVM between two kernels
    df = load().QUERIES["merge_runs"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_page_of_lines_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, 0, "Title\na b\n\n\nc"), (1, 1, " \n"), (2, 0, "d")], "doc_id long, page_no long, text string")
    runs = PG.page_words(docs).select("doc_id", "page_no", F.transform("words", lambda w: F.struct(
        w["word_no"].alias("run_no"), w["str"].alias("str"), F.lit(6.0).alias("width"),
        F.array(F.lit(12.0), F.lit(0.0), F.lit(0.0), F.lit(12.0), w["off"] * 6.0, w["line_no"] * -20.0).alias("transform"),
    )).alias("runs"))
    whole = L.page_text(L.layout_lines(runs, keep_runs=False, by_page=True), "markdown")
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    assert sorted(whole.collect()) == sorted(L.page_text(L.layout_lines(runs), "markdown").collect())
    assert whole.count() == 2
