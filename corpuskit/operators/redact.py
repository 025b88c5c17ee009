"""Sensitive spans: scan, cut, and prove on the written output that they are gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.patterns import with_pattern_hits
from corpuskit.functions.text import all_tokens, chars, needle_spellings


def scan_patterns(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per hit with its category and offsets in the text of its page."""
    return hit_rows(with_pattern_hits(pages, text), text)


def hit_rows(scanned: DataFrame, text: str = "text") -> DataFrame:
    """One row per hit of pages that hold their ``hits`` already."""
    keep = [c for c in scanned.columns if c not in (text, "hits")]
    hits = scanned.select(*keep, F.explode("hits").alias("h"))
    return hits.select(*keep, "h.category", "h.start", "h.end", F.col("h.text").alias("hit"))


def cut_spans(text: Column, spans: Column, fill: str = "") -> Column:
    """Text without the given half-open spans (any order, overlaps allowed)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.greatest(F.lit(0), s["a"] - acc["at"])
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, gap))
        new = s["b"] > acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["b"]).alias("at"),
            F.when(new, F.concat(piece, F.lit(fill))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )


def redact_patterns(
    pages: DataFrame, categories: list[str] | None = None, text: str = "text", fill: str = "", keep_hits: bool = False
) -> DataFrame:
    """Cut every detected span; one projection per page, no join and no shuffle.

    With ``keep_hits`` all hits in the text before, cut or not, stay beside it as ``hits``.
    """
    scanned = with_pattern_hits(pages, text)
    hits = F.col("hits")
    if categories:
        hits = F.filter(hits, lambda h: h["category"].isin(categories))
    cut = F.when(F.size(hits) > 0, cut_spans(F.col(text), hits, fill)).otherwise(F.col(text))
    out = scanned.withColumn(text, cut).withColumn("n_cut", F.size(hits).cast("bigint"))
    return out if keep_hits else out.drop("hits")


def redact(pages: DataFrame, marks: DataFrame, text: str = "text", fill: str = "") -> DataFrame:
    """Cut given marks (doc_id, page_no, start, end)."""
    spans = marks.groupBy("doc_id", "page_no").agg(
        F.collect_set(F.struct("start", "end")).alias("_spans")
    )
    j = pages.join(spans, ["doc_id", "page_no"], "left")
    cut = F.when(F.col("_spans").isNotNull(), cut_spans(F.col(text), F.col("_spans"), fill))
    return j.withColumn(text, F.coalesce(cut, F.col(text))).drop("_spans").select(*pages.columns)


def _grams(letters: Column, n: int) -> Column:
    """All pieces of ``n`` neighbouring characters."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(letters) - n + 1),
        lambda i: F.array_join(F.slice(letters, i, F.lit(n)), ""),
    )
    return F.when(F.size(letters) >= n, pieces).otherwise(F.array().cast("array<string>"))


def residual_check(
    outputs: DataFrame, needles: DataFrame, id_cols: list[str], needle_id: str,
    text: str = "text", needle: str = "needle", raw_stream: bool = False,
) -> DataFrame:
    """Which needles still occur in which outputs, ignoring case: (needle_id, *id_cols).

    A needle can only occur where each of its inner words occurs, so candidates come from an
    equi-join on its rarest inner word, by how many outputs hold the word; the text itself then
    decides. Needles without an inner word meet the texts by their first three characters, which
    any occurrence contains. ``raw_stream`` also looks for the wide and hex spellings.
    """
    low = F.lower(F.col(needle))
    forms = needle_spellings(F.col(needle)) if raw_stream else F.array(low)
    spelled = (
        needles.filter(F.length(needle) > 0)
        .select(F.col(needle_id).alias("_nid"), F.explode(forms).alias("_form"))
        .filter("_form <> ''").distinct()
    )
    words = all_tokens(F.col("_form"))
    inner = F.array_distinct(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))
    named = spelled.withColumn("_words", inner)
    wanted = named.select("_nid", "_form", F.explode("_words").alias("_anchor"))

    body = outputs.select(*id_cols, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    tokens = body.select(*id_cols, F.explode(F.array_distinct(all_tokens(F.col("_low")))).alias("_anchor"))
    held = tokens.join(wanted.select("_anchor").distinct(), "_anchor", "left_semi")
    spread = held.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"))
    # a word that no output holds comes first and finds nothing, as it should
    rarest = wanted.join(spread, "_anchor", "left").groupBy("_nid", "_form").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_anchor").alias("word"))).alias("_r")
    ).select("_nid", "_form", F.col("_r.word").alias("_anchor"))
    pairs = held.join(rarest, "_anchor").select("_nid", "_form", *id_cols)

    short = named.filter(F.size("_words") == 0).select("_nid", "_form", F.substring("_form", 1, 3).alias("_anchor"))
    cut = F.concat(*[_grams(F.col("_letters"), n) for n in (1, 2, 3)])
    pieces = body.withColumn("_letters", chars(F.col("_low"))).select(
        *id_cols, F.explode(F.array_distinct(cut)).alias("_anchor")
    )
    pairs = pairs.unionByName(pieces.join(short, "_anchor").select("_nid", "_form", *id_cols))
    return (
        pairs.join(body, id_cols)
        .filter(F.contains(F.col("_low"), F.col("_form")))
        .select(F.col("_nid").alias(needle_id), *id_cols)
        .distinct()
    )


def verify_redaction(outputs: DataFrame, marks: DataFrame, text: str = "text") -> DataFrame:
    """One verdict per mark, checked on the output: gone from its document, and provably so.

    ``marks``: doc_id, page_no, start, category, hit. A mark passes if its text is in no spelling
    anywhere in its document any more and every page of it could be read; ``state`` tells a text
    that is ``left`` from one that is ``undecided`` for pages nobody could read. ``verified`` holds
    for a document only if all of its marks pass.
    """
    pages = outputs.select("doc_id", "page_no", F.lower(text).alias("_low"))
    wanted = marks.select("doc_id", "hit").distinct().select(
        "doc_id", F.lower("hit").alias("_hit"), F.explode(needle_spellings(F.col("hit"))).alias("_form")
    ).filter("_form <> ''").distinct()
    # one row per page and needle of the same document only: both sides share doc_id
    left = (
        pages.join(wanted, "doc_id")
        .filter(F.contains(F.col("_low"), F.col("_form")))
        .groupBy("doc_id", "_hit")
        .agg(F.count_distinct("page_no").alias("pages_left"))
    )
    dark = pages.filter(F.col("_low").isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages_dark"))
    own = pages.select("doc_id", "page_no", F.col("_low").isNotNull().alias("_readable"))
    judged = (
        marks.withColumn("_hit", F.lower("hit"))
        .join(left, ["doc_id", "_hit"], "left")
        .join(own, ["doc_id", "page_no"], "left")
        .join(dark, "doc_id", "left")
    )
    readable = F.coalesce(F.col("_readable"), F.lit(False))
    state = (
        F.when(F.col("pages_left").isNotNull(), "left")
        .when(~readable | F.col("pages_dark").isNotNull(), "undecided")
        .otherwise("removed")
    )
    detail = (
        F.when(F.col("pages_left").isNotNull(), F.concat(F.lit("text still on "), F.col("pages_left").cast("string"), F.lit(" page(s)")))
        .when(~readable, "page could not be read")
        .when(F.col("pages_dark").isNotNull(), F.concat(F.col("pages_dark").cast("string"), F.lit(" page(s) of the document could not be read")))
        .otherwise("removed")
    )
    return judged.select(*marks.columns, (state == "removed").alias("pass"), state.alias("state"), detail.alias("detail"))


def verification_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("marks"),
        F.count_if("pass").alias("passed"),
        F.count_if(F.col("state") == "undecided").alias("undecided"),
        F.bool_and("pass").alias("verified"),
    )
