"""Inverted index over pages: build, update, query, and literal text search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuskit.functions.patterns import match_spans
from corpuskit.functions.text import SPACE, SPACE_SET, fuzzy_score, once, snippet, sums_before, tokenize, trim_space
from corpuskit.operators import sheets as SH
from corpuskit.operators.pages import paginate

#: tokens whose figures a task holds before it hands them on
TOKENS_AT_ONCE = 1 << 18
#: postings that a task makes lists of before it hands these on
POSTINGS_AT_ONCE = 1 << 19
LISTS = "token string, page_ids array<bigint>, places array<int>"
#: what is not a letter, digit, case or punctuation mark that every version of Unicode and every library agrees on
RARE = r"[^\x{0}-\x{12F}\x{2010}-\x{2027}]"
_TOKENS = re.compile(r"[^\W_]+")
_SPACES = re.compile(f"[{re.escape(SPACE_SET.replace(' ', ''))}]")


def build_index(pages: DataFrame, text: str = "text") -> DataFrame:
    """One posting per (token, doc, page) with its snippet. The text is never shuffled.

    ``pages`` needs doc_id, page_no and the text; file_name and from_ocr are kept if present.
    """
    kept = [c for c in ("doc_id", "file_name", "page_no", "from_ocr") if c in pages.columns]
    body, low, token = F.col("_text"), F.col("_low"), F.col("token")
    lowered = pages.select(*kept, F.col(text).alias("_text"), F.lower(text).alias("_low"))
    exploded = lowered.select(*kept, "_text", "_low", F.explode(tokenize(low)).alias("token"))
    placed = exploded.select(*kept, "token", "_text", (F.instr(low, token) - 1).alias("_at"))
    return placed.select("token", *kept, snippet(body, token, at=F.col("_at")).alias("snippet"))


def some_pages(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes, so that few pages are Python objects at a time."""
    step = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def token_source(text: str) -> list[Column]:
    """What ``tokens_in`` needs beside a text: its lower case and tokens, if they are not plain; NULLs else."""
    rare, low = F.col(text).rlike(RARE), F.lower(text)
    return [F.when(rare, low).alias("low"), F.when(rare, tokenize(low)).alias("tokens")]


def tokens_in(text: str, low: str | None, tokens: list[str] | None) -> tuple[str, list[str]]:
    """The lower case of a page and its tokens, as ``tokenize`` has them."""
    if low is not None:
        return low, tokens
    low = text.lower()
    return low, list(dict.fromkeys(_TOKENS.findall(low)))


def snippets(text: str, low: str, tokens: list[str], max_len: int = 80) -> Iterator[str]:
    """``snippet`` of each of a page's tokens, which ``low``, its lower case, holds."""
    blank = _SPACES.sub(" ", text)
    doubled, n = "  " in blank, len(blank)
    for token in tokens:
        at = low.find(token)
        if at < 0:
            whole = re.sub(" {2,}", " ", blank).strip(" ")
            yield whole[:max_len] + "..." if len(whole) > max_len else whole
            continue
        start = max(0, at - (max_len - len(token)) // 2)
        end = start + max_len
        window = blank[start:end]
        if doubled:
            window = re.sub(" {2,}", " ", window)
        window = window.strip(" ")
        if start:
            window = "..." + window
        yield window + "..." if end < n else window


def token_figures(docs: DataFrame, lines_per_page: int = 10, text: str = "text") -> DataFrame:
    """What an index of the pages of ``docs`` (doc_id, text) has for each token: token, n_pages, n_docs, lo, hi.

    Every posting of ``build_index`` is made, with its snippet; lo and hi are the least and the greatest. A task
    adds up the postings of its documents, so that figures of tokens are shuffled in place of postings. Documents
    are counted row by row; ids of more than one row are counted again, by themselves.
    """
    pages = paginate(docs.select("doc_id", text), lines_per_page, text)
    known = F.col("doc_id").isNotNull().cast("int")
    rows = pages.select((F.col("page_no") == 0).alias("first"), known.alias("known"), text, *token_source(text))
    kind = StructType.fromDDL("token string, n_pages bigint, n_docs bigint, lo string, hi string")
    names = kind.names

    def handed_on(held: dict[str, list]) -> pa.RecordBatch:
        each = list(zip(*held.values())) or [[]] * 5
        # a token seen once has its snippet as both
        hi = [None if a is b else b for a, b in zip(each[2], each[3])]
        return pa.RecordBatch.from_arrays([
            pa.array(held, pa.string()), pa.array(each[0], pa.int64()), pa.array(each[1], pa.int64()),
            pa.array(each[2], pa.string()), pa.array(hi, pa.string()),
        ], names=names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        doc = 0
        for batch in (part for whole in batches for part in some_pages(whole)):
            for first, known, page, *source in zip(*[c.to_pylist() for c in batch.columns]):
                if first:
                    doc += 1
                    if len(held) >= TOKENS_AT_ONCE:
                        yield handed_on(held)
                        held = {}
                low, tokens = tokens_in(page, *source)
                for token, cut in zip(tokens, snippets(page, low, tokens)):
                    have = held.get(token)
                    if have is None:
                        held[token] = [1, known, cut, cut, doc]
                        continue
                    have[0] += 1
                    if have[4] != doc:
                        have[4] = doc
                        have[1] += known
                    if cut < have[2]:
                        have[2] = cut
                    elif cut > have[3]:
                        have[3] = cut
        yield handed_on(held)

    figures = rows.mapInArrow(kernel, kind)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL")
    if not again.isEmpty():
        of_row = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), text).join(again, "doc_id", "left_semi")
        pairs = paginate(of_row, lines_per_page, text).select("doc_id", "_row", F.explode(tokenize(F.lower(text))).alias("token"))
        per_doc = pairs.groupBy("token", "doc_id").agg((1 - F.count_distinct("_row")).alias("n_docs"))
        none = F.lit(None).cast("string")
        figures = figures.unionByName(
            per_doc.select("token", F.lit(0).cast("bigint").alias("n_pages"), "n_docs", none.alias("lo"), none.alias("hi"))
        )
    return figures.groupBy("token").agg(
        F.sum("n_pages").alias("n_pages"), F.sum("n_docs").alias("n_docs"),
        F.min("lo").alias("lo"), F.max(F.coalesce("hi", "lo")).alias("hi"),
    )


def write_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Write postings by token bucket, so a query reads only the buckets of its tokens.

    Every task writes a file a bucket from the pages it has: the postings, many times the size of
    the texts, are not shuffled, and a token on every page does not end in one task or one file.
    """
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    (
        postings.withColumn("bucket", bucket)
        .sortWithinPartitions("bucket", "token")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def stored_postings(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame:
    """The postings of a query's tokens from a written index; only the buckets of these are read.

    The bucket numbers are constants of the plan, so they prune folders before anything is listed.
    """
    tokens = query_tokens(query)
    places = [F.pmod(F.xxhash64(F.lit(x)), F.lit(buckets)).cast("int") for x in tokens]
    return spark.read.parquet(path).filter(F.col("bucket").isin(places) & F.col("token").isin(tokens))


def write_page_index(pages: DataFrame, path: str, buckets: int = 64, text: str = "text") -> None:
    """Write the pages once, and for each token, by bucket, lists of the pages it is on and its place in each.

    That is all a posting's snippet is cut from, in a fraction of the space of the snippets. A task makes lists
    from the pages it has, so nothing is shuffled and a token on every page does not end in one task.
    """
    spark = pages.sparkSession
    kept = [c for c in ("doc_id", "file_name", "page_no", "from_ocr") if c in pages.columns]
    # numbered as they are written, so that both tables have the same numbers
    pages.select(F.monotonically_increasing_id().alias("page_id"), *kept, F.col(text).alias("text")).write.mode("overwrite").parquet(f"{path}/pages")
    stored = spark.read.parquet(f"{path}/pages")
    kind = StructType.fromDDL(LISTS)

    def handed_on(held: dict[str, list[int]]) -> pa.RecordBatch:
        ends = np.cumsum([0, *[len(x) // 2 for x in held.values()]], dtype=np.int32)
        both = np.fromiter(chain.from_iterable(held.values()), np.int64, 2 * int(ends[-1]))
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (both[::2], both[1::2].astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), *lists], names=kind.names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        n = 0
        for batch in (part for whole in batches for part in some_pages(whole)):
            for page_id, page, *source in zip(*[c.to_pylist() for c in batch.columns]):
                low, tokens = tokens_in(page or "", *source)
                n += len(tokens)
                for token in tokens:
                    have = held.get(token)
                    if have is None:
                        held[token] = [page_id, low.find(token)]
                    else:
                        have += page_id, low.find(token)
            if n >= POSTINGS_AT_ONCE:
                yield handed_on(held)
                held, n = {}, 0
        yield handed_on(held)

    lists = stored.select("page_id", "text", *token_source("text")).mapInArrow(kernel, kind)
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    (
        lists.withColumn("bucket", bucket)
        .sortWithinPartitions("bucket", "token")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{path}/lists")
    )


def page_index_postings(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame:
    """The postings of a query's tokens, as ``build_index`` has them, from an index of ``write_page_index``.

    Only the buckets of these tokens are read; their snippets are cut from the stored pages.
    """
    tokens = query_tokens(query)
    places = [F.pmod(F.xxhash64(F.lit(x)), F.lit(buckets)).cast("int") for x in tokens]
    # a table without tokens has no files to tell its columns from
    lists = spark.read.schema(f"{LISTS}, bucket int").parquet(f"{path}/lists")
    lists = lists.filter(F.col("bucket").isin(places) & F.col("token").isin(tokens))
    hits = lists.select("token", F.inline(F.arrays_zip(F.col("page_ids").alias("page_id"), F.col("places").alias("_at"))))
    pages = spark.read.parquet(f"{path}/pages")
    kept = [c for c in pages.columns if c not in ("page_id", "text")]
    return hits.join(pages, "page_id").select("token", *kept, snippet(F.col("text"), F.col("token"), at=F.col("_at")).alias("snippet"))


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query, in order. A query is one short string, not data."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.strip().lower())))


def search(postings: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Pages holding any query token, best first.

    10 for the first matching token, 25 more if its snippet holds the whole query, 15 for each
    further token. Counts are combined map-side before the shuffle on (doc, page).
    """
    tokens = query_tokens(query)
    keys = [c for c in ("doc_id", "file_name", "page_no") if c in postings.columns]
    rank = F.array_position(F.array(*[F.lit(x) for x in tokens or [""]]), F.col("token"))
    hits = postings.filter(F.col("token").isin(tokens))
    best = hits.groupBy(*keys).agg(
        F.min_by("snippet", rank).alias("snippet"),
        F.count(F.lit(1)).alias("_n"),
    )
    whole = F.contains(F.lower("snippet"), F.lit(query.strip().lower()))
    score = 10 + F.when(whole, 25).otherwise(0) + (F.col("_n") - 1) * 15
    out = best.select(*keys, "snippet", score.cast("bigint").alias("score")).orderBy(
        F.desc("score"), *keys
    )
    return out if limit is None else out.limit(limit)


def fuzzy_rank(items: DataFrame, names: list[str], query: str, tie: str, limit: int) -> DataFrame:
    """The items any of whose names matches the query loosely, best first; ``score`` is the best name's."""
    scores = [fuzzy_score(F.col(c), F.lit(query)) for c in names]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return items.withColumn("score", best).filter("score > 0").orderBy(F.desc("score"), tie).limit(limit)


def most_recent(files: DataFrame, when: str, tie: str, limit: int) -> DataFrame:
    """The ``limit`` rows opened last."""
    return files.orderBy(F.desc(when), tie).limit(limit)


def attach_doc_meta(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Document facts beside each hit; a hit of an unknown document keeps NULLs."""
    return hits.join(meta, "doc_id", "left")


def classify_files(
    meta: DataFrame, files: DataFrame, force: bool = False, ocr_lang: str | None = None
) -> DataFrame:
    """Say for every file whether it must be read again.

    unchanged: same last_modified and size; changed or new: read; unreadable: dropped from the
    index and reported; gone: no longer in the folder.
    """
    m = meta.select(
        "doc_id",
        F.col("last_modified").alias("_lm"),
        F.col("size").alias("_size"),
        *[F.col(c).alias(f"_{c}") for c in ("pages_awaiting_ocr", "ocr_lang") if c in meta.columns],
        F.lit(True).alias("_known"),
    )
    f = files.withColumn("_seen", F.lit(True))
    same = F.col("_lm").eqNullSafe(F.col("last_modified")) & F.col("_size").eqNullSafe(F.col("size"))
    again = F.lit(force)
    if ocr_lang is not None and "pages_awaiting_ocr" in meta.columns:
        waiting = F.coalesce(F.col("_pages_awaiting_ocr"), F.lit(0)) > 0
        other = F.col("_ocr_lang").isNotNull() & (F.col("_ocr_lang") != ocr_lang)
        again = again | waiting | other
    state = (
        F.when(F.col("_seen").isNull(), "gone")
        .when(~F.coalesce(F.col("readable"), F.lit(True)), "unreadable")
        .when(F.col("_known").isNull(), "new")
        .when(same & ~again, "unchanged")
        .otherwise("changed")
    )
    return f.join(m, "doc_id", "full").select(
        "doc_id", state.alias("state"), "last_modified", "size"
    )


def update_index(
    postings: DataFrame, states: DataFrame, pages: DataFrame, text: str = "text"
) -> DataFrame:
    """Postings after an incremental run: unchanged ones kept, new and changed files read again."""
    kept = postings.join(states.filter("state = 'unchanged'").select("doc_id"), "doc_id", "left_semi")
    todo = states.filter("state IN ('new', 'changed')").select("doc_id")
    fresh = build_index(pages.join(todo, "doc_id", "left_semi"), text)
    return kept.unionByName(fresh.select(*postings.columns))


def index_stats(pages: DataFrame, files: DataFrame, text: str = "text") -> DataFrame:
    """One row about a folder and its index.

    ``pages``: doc_id, text and ``ocr`` (recognised, failed or NULL); ``files``: doc_id, readable. Counts
    the files and pages indexed and their tokens, files skipped as unreadable, and of the pages:
    without text, still awaiting recognition (no text, not tried), recognised, failed.
    """
    kind = dict(pages.dtypes)["doc_id"]
    n = F.size(tokenize(F.col(text)))
    facts = pages.select(
        "doc_id", n.alias("n"), F.lit(1).alias("page"), F.lit(0).alias("skipped"),
        ((n == 0) & F.col("ocr").isNull()).cast("int").alias("awaiting"), "ocr",
    ).unionByName(files.filter(~F.coalesce(F.col("readable"), F.lit(False))).select(
        F.lit(None).cast(kind).alias("doc_id"), F.lit(0).alias("n"), F.lit(0).alias("page"), F.lit(1).alias("skipped"),
        F.lit(0).alias("awaiting"), F.lit(None).cast("string").alias("ocr"),
    ))

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return facts.agg(
        F.count_distinct("doc_id").alias("files_indexed"), total("page").alias("pages_indexed"),
        total("n").alias("total_tokens"), F.count_if((F.col("page") == 1) & (F.col("n") == 0)).alias("pages_without_text"),
        total("skipped").alias("files_skipped"), total("awaiting").alias("pages_awaiting"),
        F.count_if(F.col("ocr") == "recognised").alias("pages_recognised"),
        F.count_if(F.col("ocr") == "failed").alias("pages_failed"),
    )


def quoted(needle: str, match_case: bool) -> str:
    escaped = "".join("\\" + ch if not (ch.isalnum() or ch.isspace()) else ch for ch in needle)
    return escaped if match_case else "(?iu)" + escaped


def find_text(pages: DataFrame, needle: str, match_case: bool = False, text: str = "text", by_page: bool = False) -> DataFrame:
    """All non-overlapping hits of a literal, one row each; a hit never crosses a line end.

    With ``by_page`` a page with hits stays one row, with its hits in order as ``hits``.
    """
    keep = [c for c in pages.columns if c != text]
    kind = "array<struct<start:int,end:int,hit:string>>"
    if not needle or "\n" in needle:
        spans = pages.limit(0).select(*keep, F.array().cast(kind).alias("hits"))
    else:
        pattern = quoted(needle, match_case)
        hay = F.col(text) if match_case else F.lower(text)
        some = pages.filter(F.contains(hay, F.lit(needle if match_case else needle.lower())))
        found = some.withColumn("_m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
        spans = found.select(*keep, match_spans(F.col(text), pattern, F.col("_m")).cast(kind).alias("hits")).filter(F.size("hits") > 0)
    return spans if by_page else spans.select(*keep, F.inline("hits"))


def line_runs(text: Column, words: int = 3) -> Column:
    """Runs of a page: pieces of up to ``words`` words whose joined text is the page again.

    Each has run_no, the half-open offsets in the page text, and the text.
    """
    pattern = f"(?:[^{SPACE[1:-1]}]++{SPACE}*+){{1,{words}}}|{SPACE}++"

    def placed(pieces: Column) -> Column:
        before = sums_before(F.transform(pieces, F.length))
        return F.transform(
            F.arrays_zip(before.alias("at"), pieces.alias("str")),
            lambda p, i: F.struct(
                i.alias("run_no"), p["at"].alias("start"), (p["at"] + F.length(p["str"])).alias("end"), p["str"].alias("str")
            ),
        )

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def hit_slices(hits: DataFrame, runs: str = "runs") -> DataFrame:
    """Each hit cut into the parts of the runs it covers (offsets inside the run).

    ``hits``: one row per hit with start, end and the runs of its page; or one row per page with its ``hits``
    as ARRAY<STRUCT>, so that the runs of a page are there once, and not once for each hit. The runs of a hit
    are looked up by their places in order.
    """
    paged = "hits" in hits.columns
    facts = [c for c in hits.columns if c not in (runs, "hits")]
    if paged:
        span, kinds = F.col("hits"), hits.schema["hits"].dataType.elementType.fields
    else:
        span, kinds = F.array(F.struct("start", "end")), []
    rows = hits.select(
        *facts, span.alias("_h"),
        F.transform(runs, lambda r: F.struct(r["run_no"].cast("bigint").alias("run_no"), r["start"].cast("bigint").alias("start"), r["end"].cast("bigint").alias("end"))).alias("_r"),
    )
    made = StructType.fromDDL("run_no bigint, run_from bigint, run_to bigint")
    out = StructType([*[hits.schema[c] for c in facts], *kinds, *made])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, pieces = batch.column(len(facts)), batch.column(len(facts) + 1)
            page, of = (np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(c), 0).to_numpy()) for c in (found, pieces))
            spans, (no, begin, end) = found.flatten(), (SH.numbers(c) for c in pieces.flatten().flatten())
            start, stop = (SH.numbers(spans.field(c)).astype("int64") for c in ("start", "end"))
            order = np.lexsort((end, begin, of))
            no, begin, end, of = no[order], begin[order], end[order], of[order]
            # of ordered runs the first is the one after all that end before the hit
            most = int(max([0, *(int(c.max()) for c in (begin, end, start, stop) if len(c))])) + 2
            first = np.searchsorted(np.maximum.accumulate(of * most + end), page * most + start, "right")
            much = np.maximum(np.searchsorted(of * most + begin, page * most + stop) - first, 0)
            hit = np.repeat(np.arange(len(page)), much)
            run = np.repeat(first - np.cumsum(much) + much, much) + np.arange(len(hit))
            true = end[run] > start[hit]
            hit, run = hit[true], run[true]
            at = pa.array(page[hit])
            cut = [no[run], np.maximum(0, start[hit] - begin[run]), np.minimum(stop[hit], end[run]) - begin[run]]
            own = [spans.field(k.name).take(pa.array(hit)) for k in kinds]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(facts))], *own, *map(pa.array, cut)], names=out.names)

    return rows.mapInArrow(kernel, out)


def ocr_merge(pages: DataFrame, ocr: DataFrame, text: str = "text") -> DataFrame:
    """Recognised text fills only pages without text of their own; blank results do not count.

    ``ocr``: doc_id, page_no, ocr_text, failed. Adds from_ocr and ocr_failed.
    """
    o = ocr.select("doc_id", "page_no", F.col("ocr_text").alias("_o"), F.col("failed").alias("_f"))
    j = pages.join(o, ["doc_id", "page_no"], "left")
    bare = F.size(tokenize(F.col(text))) == 0
    good = bare & ~F.coalesce(F.col("_f"), F.lit(False)) & (trim_space(F.coalesce(F.col("_o"), F.lit(""))) != "")
    return j.select(
        *[F.col(c) for c in pages.columns if c != text],
        F.when(good, F.col("_o")).otherwise(F.col(text)).alias(text),
        good.alias("from_ocr"),
        (bare & F.coalesce(F.col("_f"), F.lit(False))).alias("ocr_failed"),
        bare.alias("was_bare"),
    )


def ocr_coverage(merged: DataFrame) -> DataFrame:
    """Per document: pages, pages filled by recognition, failed and still waiting ones."""
    waiting = F.col("was_bare") & ~F.col("from_ocr") & ~F.col("ocr_failed")
    return merged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("from_ocr").alias("ocr_pages"),
        F.count_if("ocr_failed").alias("ocr_failed"),
        F.count_if(waiting).alias("awaiting_ocr"),
    )
