"""Pages, patterns, redaction and search."""

import uuid

from pyspark.sql import functions as F

from corpuskit.checks import sqlparts as S
from corpuskit.checks.registry import register
from corpuskit.functions import text as X
from corpuskit.functions.patterns import with_pattern_hits
from corpuskit.operators import pages as PG
from corpuskit.operators import redact as R
from corpuskit.operators import search as SE
from corpuskit.session import checkpoint_folder


def pages_of(t):
    return PG.paginate(t.texts.select("doc_id", "lang", "text"), 10)


@register("paginate", f"WITH {S.PAGES} SELECT doc_id, page_no, md5(text) AS text_md5, length(text)::BIGINT AS n FROM pg")
def _(t):
    return pages_of(t).select(
        "doc_id", F.col("page_no").cast("bigint"), F.md5("text").alias("text_md5"),
        F.length("text").cast("bigint").alias("n"),
    )


@register(
    "pages_without_text",
    f"WITH {S.PAGES}, q AS (SELECT doc_id, page_no, CASE WHEN page_no % 5 = 3 THEN '-- ' ELSE text END AS text FROM pg) SELECT doc_id, page_no FROM q WHERE len({S.TOKENS}) = 0",
)
def _(t):
    """Every fifth page is a picture: its text is nothing but dashes."""
    pages = pages_of(t).withColumn("text", F.when(F.col("page_no") % 5 == 3, "-- ").otherwise(F.col("text")))
    return PG.pages_without_text(pages).select("doc_id", F.col("page_no").cast("bigint"))


@register(
    "scan_patterns",
    f"WITH {S.PAGES}, {S.hits_sql('pg', 'doc_id, page_no')} SELECT doc_id, page_no, category, s AS start_at, e AS end_at, m AS hit FROM hits",
)
def _(t):
    return R.scan_patterns(pages_of(t)).select(
        "doc_id", F.col("page_no").cast("bigint"), "category",
        F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), "hit",
    )


@register(
    "pattern_counts",
    f"WITH {S.hits_sql('documents', 'doc_id, lang')} SELECT lang, category, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY ALL",
)
def _(t):
    hits = R.scan_patterns(t.texts.select("doc_id", "lang", "text"))
    return hits.groupBy("lang", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs")
    )


_CUT = """cuts AS (SELECT doc_id, page_no, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id, page_no ORDER BY s) AS p,
    row_number() OVER (PARTITION BY doc_id, page_no ORDER BY s DESC) AS last FROM hits),
  red AS (SELECT doc_id, page_no, string_agg(substring(text, p + 1, s - p), '' ORDER BY s) || substring(any_value(text), max(e) + 1) AS text, count(*) AS n
    FROM cuts JOIN pg USING (doc_id, page_no) GROUP BY ALL),
  outp AS (SELECT doc_id, page_no, coalesce(red.text, pg.text) AS text, coalesce(n, 0) AS n FROM pg LEFT JOIN red USING (doc_id, page_no))"""


@register(
    "redact_patterns",
    f"WITH {S.PAGES}, {S.hits_sql('pg', 'doc_id, page_no')}, {_CUT} SELECT doc_id, page_no, md5(text) AS text_md5, n AS n_cut FROM outp",
)
def _(t):
    return R.redact_patterns(pages_of(t)).select(
        "doc_id", F.col("page_no").cast("bigint"), F.md5("text").alias("text_md5"), "n_cut"
    )


@register(
    "redact_marks",
    f"WITH {S.PAGES}, hits AS (SELECT doc_id, page_no, 0 AS s, 3 AS e FROM pg), {_CUT} SELECT doc_id, page_no, md5(text) AS text_md5 FROM outp",
)
def _(t):
    pages = pages_of(t)
    marks = pages.select("doc_id", "page_no", F.lit(0).alias("start"), F.lit(3).alias("end"))
    return R.redact(pages, marks).select(
        "doc_id", F.col("page_no").cast("bigint"), F.md5("text").alias("text_md5")
    )


@register(
    "verify_redaction",
    f"""WITH {S.PAGES}, {S.hits_sql('pg', 'doc_id, page_no')}, {_CUT},
    seen AS (SELECT doc_id, page_no, CASE WHEN doc_id % 7 = 3 AND page_no = 1 THEN NULL ELSE lower(text) END AS low FROM outp),
    v AS (SELECT h.doc_id, EXISTS (SELECT 1 FROM seen o WHERE o.doc_id = h.doc_id AND contains(o.low, lower(h.m))) AS lft, EXISTS (SELECT 1 FROM seen o WHERE o.doc_id = h.doc_id AND o.low IS NULL) AS dark FROM hits h)
    SELECT doc_id, count(*) AS marks, count(*) FILTER (NOT lft AND NOT dark) AS passed, count(*) FILTER (NOT lft AND dark) AS undecided, bool_and(NOT lft AND NOT dark) AS verified FROM v GROUP BY doc_id""",
)
def _(t):
    """The output is written and read back, so the check sees what was really stored.

    The second page of every seventh document cannot be read.
    """
    pages = pages_of(t).select("doc_id", "page_no", "text")
    path = f"{checkpoint_folder(t.spark)}/redacted-{t.spark.sparkContext.applicationId}"
    # the hits go beside the text they were cut from, so that it is scanned once
    R.redact_patterns(pages, keep_hits=True).write.mode("overwrite").parquet(path)
    written = t.spark.read.parquet(path)
    dark = (F.col("doc_id") % 7 == 3) & (F.col("page_no") == 1)
    seen = written.select("doc_id", "page_no", F.when(~dark, F.col("text")).alias("text"))
    verdicts = R.verify_redaction(seen, R.hit_rows(written.drop("n_cut")))
    return R.verification_summary(verdicts)


@register(
    "residual_check",
    "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))",
)
def _(t):
    needles = t.benchmark.select("item_id", F.col("text").alias("needle"))
    return R.residual_check(t.documents.select("doc_id", "text"), needles, ["doc_id"], "item_id")


@register(
    "build_index",
    f"""WITH {S.PAGES}, p AS (SELECT doc_id, page_no, text, unnest(list_distinct({S.TOKENS})) AS token FROM pg),
    s AS (SELECT *, {S.snippet('text', 'token')} AS snippet FROM p)
    SELECT token, count(*) AS n_pages, count(DISTINCT doc_id) AS n_docs, min(snippet) AS lo, max(snippet) AS hi FROM s GROUP BY token""",
)
def _(t):
    return SE.token_figures(t.texts.select("doc_id", "text"))


_SEARCH = f"""{S.PAGES}, p AS (SELECT doc_id, page_no, text, list_distinct({S.TOKENS}) AS toks FROM pg),
    q AS (SELECT * FROM (VALUES ('the', 1), ('of', 2), ('and', 3)) v(token, pos)),
    h AS (SELECT doc_id, page_no, pos, {S.snippet('text', 'token')} AS snippet FROM p JOIN q ON list_contains(toks, token)),
    g AS (SELECT doc_id, page_no, arg_min(snippet, pos) AS snippet, count(*) AS n FROM h GROUP BY ALL),
    res AS (SELECT doc_id, page_no, snippet, 10 + CASE WHEN contains(lower(snippet), 'the of and') THEN 25 ELSE 0 END + 15 * (n - 1) AS score FROM g)"""


@register("search", f"WITH {_SEARCH} SELECT doc_id, page_no, snippet, score FROM res")
def _(t):
    return SE.search(SE.build_index(pages_of(t)), "the of and").select(
        "doc_id", F.col("page_no").cast("bigint"), "snippet", "score"
    )


@register(
    "search_top",
    f"WITH {_SEARCH} SELECT doc_id, page_no, score FROM res ORDER BY score DESC, doc_id, page_no LIMIT 20",
)
def _(t):
    return SE.search(SE.build_index(pages_of(t)), "the of and", limit=20).select(
        "doc_id", F.col("page_no").cast("bigint"), "score"
    )


@register(
    "search_with_meta",
    f"WITH {_SEARCH} SELECT res.doc_id, page_no, score, source, n_chars FROM res LEFT JOIN documents d ON res.doc_id = d.doc_id",
)
def _(t):
    hits = SE.search(SE.build_index(pages_of(t)), "the of and").drop("snippet")
    return SE.attach_doc_meta(hits, t.documents.select("doc_id", "source", "n_chars")).select(
        "doc_id", F.col("page_no").cast("bigint"), "score", "source", "n_chars"
    )


@register(
    "update_index",
    f"""WITH {S.PAGES}, p AS (SELECT doc_id, page_no, unnest(list_distinct({S.TOKENS})) AS token FROM pg WHERE doc_id % 17 <> 3)
    SELECT token, count(*) AS n_pages, count(DISTINCT doc_id) AS n_docs FROM p GROUP BY token""",
)
def _(t):
    """The earlier state knows every file; every tenth grew since, every 17th cannot be read now."""
    docs, pages = t.documents, pages_of(t)
    old = SE.build_index(pages).select("token", "doc_id", "page_no", "snippet")
    meta = docs.select(
        "doc_id", F.lit(1).alias("last_modified"),
        F.when(F.col("doc_id") % 10 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars")).alias("size"),
    )
    files = docs.select(
        "doc_id", F.lit(1).alias("last_modified"), F.col("n_chars").alias("size"),
        (F.col("doc_id") % 17 != 3).alias("readable"),
    )
    states = SE.classify_files(meta, files)
    return (
        SE.update_index(old, states, pages)
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct("doc_id").alias("n_docs"))
    )


@register(
    "classify_files",
    """SELECT doc_id, CASE WHEN doc_id % 17 = 3 THEN 'unreadable' WHEN doc_id % 13 = 5 THEN 'new' WHEN doc_id % 10 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM documents
    UNION ALL SELECT item_id + 1000000000, 'gone' FROM benchmark""",
)
def _(t):
    docs = t.documents
    size = F.when(F.col("doc_id") % 10 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars"))
    gone = t.benchmark.select(
        (F.col("item_id") + 1000000000).alias("doc_id"), F.lit(1).alias("last_modified"), F.lit(9).cast("bigint").alias("size")
    )
    meta = docs.filter("doc_id % 13 <> 5").select("doc_id", F.lit(1).alias("last_modified"), size.alias("size")).unionByName(gone)
    files = docs.select(
        "doc_id", F.lit(1).alias("last_modified"), F.col("n_chars").alias("size"),
        (F.col("doc_id") % 17 != 3).alias("readable"),
    )
    return SE.classify_files(meta, files).select("doc_id", "state")


@register("search_stored", f"WITH {_SEARCH} SELECT doc_id, page_no, snippet, score FROM res")
def _(t):
    """The index is written by token bucket and only the buckets of the query are read."""
    path = f"{checkpoint_folder(t.spark)}/index-{uuid.uuid4().hex}"
    SE.write_page_index(pages_of(t).drop("lang"), path)
    return SE.search(SE.page_index_postings(t.spark, path, "the of and"), "the of and").select(
        "doc_id", F.col("page_no").cast("bigint"), "snippet", "score"
    )


@register(
    "index_stats",
    f"""WITH {S.PAGES}, q AS (SELECT doc_id, CASE WHEN page_no % 5 = 3 AND doc_id % 3 <> 2 THEN '' ELSE text END AS text, CASE WHEN page_no % 5 = 3 THEN [NULL, 'failed', 'recognised'][doc_id % 3 + 1] END AS ocr FROM pg WHERE doc_id % 17 <> 3),
    p AS (SELECT doc_id, ocr, len(list_distinct({S.TOKENS})) AS n FROM q)
    SELECT count(DISTINCT doc_id) AS files_indexed, count(*) AS pages_indexed, sum(n)::BIGINT AS total_tokens, count(*) FILTER (n = 0) AS pages_without_text, (SELECT count(*) FROM documents WHERE doc_id % 17 = 3) AS files_skipped,
      count(*) FILTER (n = 0 AND ocr IS NULL) AS pages_awaiting, count(*) FILTER (ocr = 'recognised') AS pages_recognised, count(*) FILTER (ocr = 'failed') AS pages_failed FROM p""",
)
def _(t):
    """Every fifth page is a scan: not tried yet, failed or recognised by its document."""
    scan, third = F.col("page_no") % 5 == 3, F.col("doc_id") % 3
    state = F.when(scan & (third == 1), "failed").when(scan & (third == 2), "recognised")
    pages = pages_of(t).filter("doc_id % 17 <> 3").select(
        "doc_id", F.when(scan & (third != 2), "").otherwise(F.col("text")).alias("text"), state.alias("ocr")
    )
    files = t.documents.select("doc_id", (F.col("doc_id") % 17 != 3).alias("readable"))
    return SE.index_stats(pages, files)


@register(
    "find_text",
    f"""WITH {S.PAGES}, a AS (SELECT doc_id, page_no, text, string_split(lower(text), 'tion') AS ps FROM pg WHERE contains(lower(text), 'tion')),
    b AS (SELECT doc_id, page_no, text, unnest(list_transform(range(1, len(ps)), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * 4 AS BIGINT))) AS s FROM a)
    SELECT doc_id, page_no, s AS start_at, substring(text, s + 1, 4) AS hit FROM b""",
)
def _(t):
    return SE.find_text(pages_of(t).drop("lang"), "tion").select(
        "doc_id", F.col("page_no").cast("bigint"), F.col("start").cast("bigint").alias("start_at"), "hit"
    )


@register(
    "find_text_slices",
    f"""WITH {S.PAGES}, a AS (SELECT doc_id, page_no, text, string_split(text, 'the ') AS ps FROM pg WHERE contains(text, 'the ')),
    b AS (SELECT doc_id, page_no, unnest(list_transform(range(1, len(ps)), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * 4 AS BIGINT))) AS s FROM a)
    SELECT doc_id, page_no, count(*) AS hits, sum(4)::BIGINT AS covered FROM b GROUP BY ALL""",
)
def _(t):
    pages = pages_of(t).drop("lang").withColumn("runs", SE.line_runs(F.col("text")))
    slices = SE.hit_slices(SE.find_text(pages, "the ", match_case=True, by_page=True))
    return slices.groupBy("doc_id", F.col("page_no").cast("bigint").alias("page_no")).agg(
        F.count_distinct("start").alias("hits"),
        F.sum(F.col("run_to") - F.col("run_from")).cast("bigint").alias("covered"),
    )


@register(
    "pattern_regions",
    f"WITH {S.PAGES}, {S.hits_sql('pg', 'doc_id, page_no')} SELECT doc_id, page_no, category, s AS start_at, length(m)::BIGINT AS covered FROM hits",
)
def _(t):
    pages = pages_of(t).drop("lang").withColumn("runs", SE.line_runs(F.col("text")))
    slices = SE.hit_slices(with_pattern_hits(pages).drop("text"))
    return slices.groupBy(
        "doc_id", F.col("page_no").cast("bigint").alias("page_no"), "category",
        F.col("start").cast("bigint").alias("start_at"),
    ).agg(F.sum(F.col("run_to") - F.col("run_from")).cast("bigint").alias("covered"))


@register(
    "ocr_merge",
    f"""WITH {S.PAGES}, a AS (SELECT doc_id, page_no, len({S.TOKENS}) = 0 AS bare, page_no % 3 AS k FROM pg)
    SELECT doc_id, count(*) AS pages, count(*) FILTER (bare AND k = 0) AS ocr_pages, count(*) FILTER (bare AND k = 1) AS ocr_failed, count(*) FILTER (bare AND k = 2) AS awaiting_ocr FROM a GROUP BY doc_id""",
)
def _(t):
    pages = pages_of(t)
    k = F.col("page_no") % 3
    ocr = pages.select(
        "doc_id", "page_no", F.when(k == 0, "found words").otherwise(" ").alias("ocr_text"), (k == 1).alias("failed")
    )
    return SE.ocr_coverage(SE.ocr_merge(pages, ocr))


@register(
    "base_sentences",
    r"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '[^.!?。！？]+(?:[.!?。！？]+|$)') AS s FROM documents)
    SELECT doc_id, len(s)::BIGINT AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest FROM a""",
)
def _(t):
    s = X.base_sentences(F.col("text"))
    return t.documents.select("doc_id", s.alias("s")).select(
        "doc_id", F.size("s").cast("bigint").alias("n"),
        F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("bigint").alias("longest"),
    )
