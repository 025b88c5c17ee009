"""Page selection and decision rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import SPACE, rx_replace, trim_space
from corpuskit.operators.ordered import number_rows

# Fixed value: characters accepted as the dash of a page range.
DASHES = "-‐‑‒–—−"


def parse_page_range(text: str | None) -> list[tuple[int, int]] | None:
    """1-based inclusive spans of a range text; None means all pages. Junk selects nothing."""
    if text is None or text.strip().lower() in ("", "all"):
        return None
    spans = []
    for piece in re.split("[,;]", text):
        m = re.fullmatch(rf"([0-9]+)(?:\s*[{DASHES}]\s*([0-9]+))?", piece.strip())
        if m:
            a, b = int(m[1]), int(m[2] or m[1])
            spans.append((min(a, b), max(a, b)))
    return spans


def select_pages(pages: DataFrame, text: str | None, pos: str = "pos") -> DataFrame:
    """Pages in a range given by the user: a plain predicate, so it reaches the scan."""
    spans = parse_page_range(text)
    if spans is None:
        return pages
    cond = F.lit(False)
    for a, b in spans:
        cond = cond | F.col(pos).between(max(1, a) - 1, b - 1)
    return pages.filter(cond)


def in_range_column(range_text: Column, pos: Column) -> Column:
    """The same rule where every row carries its own range text."""
    text = F.lower(trim_space(F.coalesce(range_text, F.lit(""))))
    pattern = rf"^([0-9]+)(?:{SPACE}*[{DASHES}]{SPACE}*([0-9]+))?$"

    def holds(piece: Column) -> Column:
        p = trim_space(piece)
        a = F.regexp_extract(p, pattern, 1).try_cast("bigint")
        b = F.coalesce(F.regexp_extract(p, pattern, 2).try_cast("bigint"), a)
        n = pos + 1
        return F.coalesce((n >= F.least(a, b)) & (n <= F.greatest(a, b)), F.lit(False))

    return F.when(text.isin("", "all"), F.lit(True)).otherwise(F.exists(F.split(text, "[,;]"), holds))


def range_warnings(pages: DataFrame, range_col: str) -> DataFrame:
    """Documents whose non-empty range selects none of their pages."""
    hit = in_range_column(F.col(range_col), F.col("pos"))
    return pages.groupBy("doc_id").agg(F.bool_or(hit).alias("_any")).filter(~F.col("_any")).select("doc_id")


def text_presence(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Visible characters and runs per page; a page without runs counts as 0, 0."""
    per = runs.groupBy("doc_id", "page_no").agg(
        F.sum(F.length(trim_space(F.col("str")))).alias("_c"), F.count(F.lit(1)).alias("_r")
    )
    zero = F.lit(0).cast("bigint")
    return pages.join(per, ["doc_id", "page_no"], "left").select(
        *pages.columns, F.coalesce("_c", zero).alias("char_count"), F.coalesce("_r", zero).alias("run_count")
    )


def speck_limit(threshold: float) -> float:
    t = min(100.0, max(0.0, threshold))
    return t * 2 if t <= 50 else 100 + (t - 50) / 50 * 3900


def text_allowance(threshold: float) -> int:
    t = min(100.0, max(0.0, threshold))
    return 0 if t <= 50 else int((t - 50) / 50 * 40 + 0.5)


def is_blank(coverage: Column, blob_pt2: Column, chars: Column, threshold: float) -> Column:
    """Little ink, no large blot, (nearly) no text. The cheap measures come first."""
    limit = min(100.0, max(0.0, threshold)) / 100 * 0.01
    return (
        (coverage <= limit) & (blob_pt2 <= speck_limit(threshold)) & (chars <= text_allowance(threshold))
    )


def on_page_chars(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Non-space characters per page of runs whose turned box meets the page box.

    ``runs``: doc_id, page_no, str, transform, width, height; ``boxes``: doc_id, page_no, x0..y1.
    """
    a, b = F.col("transform")[0], F.col("transform")[1]
    c, d = F.col("transform")[2], F.col("transform")[3]
    x, y = F.col("transform")[4], F.col("transform")[5]
    long = F.sqrt(a * a + b * b)
    w, h = F.coalesce("width", F.lit(0.0)), F.coalesce("height", F.sqrt(c * c + d * d))
    ux = F.when(long > 0, a / long).otherwise(1.0)
    uy = F.when(long > 0, b / long).otherwise(0.0)
    xs = [x, x + ux * w, x - uy * h, x + ux * w - uy * h]
    ys = [y, y + uy * w, y + ux * h, y + uy * w + ux * h]
    meets = (
        (F.greatest(*xs) >= F.least("x0", "x1")) & (F.least(*xs) <= F.greatest("x0", "x1"))
        & (F.greatest(*ys) >= F.least("y0", "y1")) & (F.least(*ys) <= F.greatest("y0", "y1"))
    )
    n = F.length(rx_replace(F.col("str"), f"{SPACE}+", ""))
    per = runs.join(boxes, ["doc_id", "page_no"]).filter((n > 0) & meets & (F.size("transform") >= 6)).groupBy(
        "doc_id", "page_no"
    ).agg(F.sum(n).alias("_n"))
    return boxes.select("doc_id", "page_no").join(per, ["doc_id", "page_no"], "left").select(
        "doc_id", "page_no", F.coalesce("_n", F.lit(0).cast("bigint")).alias("chars")
    )


def never_larger(original: Column, result: Column, satisfied: Column) -> Column:
    return (
        F.when(result < original, "result")
        .when(satisfied, "original")
        .when(result > original, "larger")
        .otherwise("same")
    )


def cap_per_group(
    df: DataFrame, keys: list[str], pos: str, n: int, always: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """First ``n`` rows per key, and how many were left out.

    A row marked ``always`` beyond the cap takes the place of the last kept one.
    """
    flag = F.coalesce(always, F.lit(False)) if always is not None else F.lit(False)
    rows = number_rows(df.withColumn("_always", flag), keys, pos, out="_rn", total="_n")
    must = rows.filter(F.col("_always") & (F.col("_rn") > n)).groupBy(*keys).agg(F.min("_rn").alias("_must"))
    j = rows.join(must, keys, "left")
    keep = F.when(F.col("_must").isNull(), F.col("_rn") <= n).otherwise(
        (F.col("_rn") < n) | (F.col("_rn") == F.col("_must"))
    )
    dropped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") > n).select(
        *keys, (F.col("_all") - n).alias("dropped")
    )
    return j.filter(keep).select(*df.columns), dropped
