"""Batch recipes over a table of documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from corpuskit.functions.geometry import projected_bytes
from corpuskit.functions.names import filename_pattern, running_label, strip_extension
from corpuskit.operators.metadata import FIELDS, FLAGS, scrub_metadata
from corpuskit.operators.predicates import never_larger, parse_page_range
from corpuskit.operators.redact import redact_patterns
from corpuskit.operators.sequence import global_numbers
from corpuskit.operators.unique_names import unique_names


def batch_names(files: DataFrame, pattern: str, day: str) -> DataFrame:
    """Output names of a whole run, planned before it starts. ``files``: pos, name."""
    base = strip_extension(F.col("name"))
    if "{index}" in pattern:
        total = F.lit(files.count())
        numbered = global_numbers(files, ["pos"], "_i").withColumn("_i", F.col("_i") + 1)
    else:
        total, numbered = F.lit(1), files.withColumn("_i", F.lit(1))
    named = numbered.withColumn("_n", filename_pattern(pattern, base, F.col("_i"), total, day))
    return unique_names(named, "_n", "pos", "out_name").drop("_n", "_i")


# --- settings -------------------------------------------------------------------------------
def _number(low: float = float("-inf"), high: float = float("inf")):
    def ok(v):
        return isinstance(v, (int, float)) and not isinstance(v, bool) and low <= v <= high and v == v

    return ok


def _one_of(*allowed: str):
    return lambda v: isinstance(v, str) and v in allowed


def _text(v) -> bool:
    return isinstance(v, str)


def _colour(v) -> bool:
    return isinstance(v, str) and re.fullmatch("#?[0-9a-fA-F]{6}", v) is not None


def _image(v) -> bool:
    return v is None or (isinstance(v, dict) and isinstance(v.get("bytes"), bytes))


_ALIGN = _one_of("left", "center", "right")
# The fields of each step's settings with their types and ranges.
SETTINGS = {
    "compress": {"dpi": _number(1, 2400), "quality": _number(0, 1)},
    "watermark": {
        "kind": _one_of("text", "image"), "text": _text, "image": _image, "imageScale": _number(0, 1),
        "position": _one_of(*[
            "top-left", "top-center", "top-right", "center-left", "center", "center-right",
            "bottom-left", "bottom-center", "bottom-right",
        ]),
        "opacity": _number(0, 1), "rotation": _number(-360, 360), "fontSize": _number(1, 1000),
        "color": _colour, "startAt": _number(), "pageRange": _text,
    },
    "headerFooter": {
        "headerText": _text, "headerAlign": _ALIGN, "footerText": _text, "footerAlign": _ALIGN,
        "fontSize": _number(1, 1000), "pageRange": _text,
    },
    "nup": {
        "layout": _one_of("2-up", "4-up", "booklet"), "margin": _number(0), "gutter": _number(0),
        "drawBorders": lambda v: isinstance(v, bool),
    },
    "normalize": {"targetSize": _one_of("A4", "Letter", "Legal"), "scaleMode": _one_of("fit", "fill", "center")},
}


class RecipeError(ValueError):
    """A recipe that must not run; ``problems`` holds the dotted paths."""

    def __init__(self, problems: list[str]):
        super().__init__(", ".join(problems))
        self.problems = problems


def parse_recipe(raw: dict) -> tuple[list[str], dict[str, dict]]:
    """Tools and settings of a stored recipe, every field checked; raises with all problems."""
    problems: list[str] = []
    tools = raw.get("tools")
    if not isinstance(tools, list) or not all(isinstance(t, str) for t in tools):
        problems.append("tools")
        tools = []
    settings, given = {}, raw.get("settings")
    if given is not None and not isinstance(given, dict):
        problems.append("settings")
        given = None
    for step, fields in SETTINGS.items():
        value = (given or {}).get(step)
        if value is None:
            continue
        if not isinstance(value, dict):
            problems.append(step)
            continue
        bad = [f"{step}.{name}" for name, ok in fields.items() if not ok(value.get(name))]
        problems += bad
        if not bad:
            settings[step] = {name: value.get(name) for name in fields}
    if problems:
        raise RecipeError(problems)
    return list(tools), settings


# --- running --------------------------------------------------------------------------------
NOTE = "struct<kind:string,detail:string>"


def _note(kind: str, detail: Column, when: Column) -> Column:
    one = F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail")).cast(NOTE)
    return F.when(when, F.array(one)).otherwise(F.array().cast(f"array<{NOTE}>"))


def redact_tool(df: DataFrame, settings: dict | None) -> DataFrame:
    out = redact_patterns(df)
    n = F.col("n_cut")
    note = _note("changed", F.concat(n.cast("string"), F.lit(" spans cut")), n > 0)
    return out.withColumn("notes", F.concat("notes", note)).withColumn("n_bytes", F.octet_length("text").cast("bigint")).drop("n_cut")


def metadata_tool(df: DataFrame, settings: dict | None) -> DataFrame:
    """Clears every metadata field and flag the documents have; the note names those that held something."""
    names = [F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.lit(c)) for c in FIELDS if c in df.columns]
    names += [F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in FLAGS if c in df.columns]
    held = F.concat_ws(", ", *names)
    return scrub_metadata(df.withColumn("notes", F.concat("notes", _note("metadata-scrubbed", held, held != ""))))


def compress_tool(df: DataFrame, settings: dict) -> DataFrame:
    """Fills ``n_bytes_estimate`` by the size model; nothing is compressed here, so ``n_bytes`` stays."""
    new = projected_bytes(F.col("n_bytes"), F.lit(float(settings["quality"]))).cast("bigint")
    choice = never_larger(F.col("n_bytes"), new, F.lit(True))
    note = _note("kept-original", F.lit("compress: estimate not smaller"), choice == "original")
    return df.withColumns({
        "n_bytes_estimate": F.when(choice == "result", new).otherwise(F.col("n_bytes")), "notes": F.concat("notes", note),
    })


PAGE_BREAK = "\f"


def _with_pages(df: DataFrame, pages: Column) -> DataFrame:
    return df.withColumn("text", F.array_join(pages, PAGE_BREAK)).withColumn("n_bytes", F.octet_length("text").cast("bigint"))


def header_footer_tool(df: DataFrame, settings: dict) -> DataFrame:
    """Labels on the pages in range; a text's pages are parted by form feeds."""
    pages = F.split("text", PAGE_BREAK, -1)
    spans = parse_page_range(settings.get("pageRange"))

    def labelled(page: Column, i: Column) -> Column:
        def label(template: str) -> list[Column]:
            return [running_label(template, i + 1, F.size(pages))] if template.strip() else []

        text = F.concat_ws("\n", *label(settings["headerText"]), page, *label(settings["footerText"]))
        if spans is None:
            return text
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | (i + 1).between(a, b)
        return F.when(inside, text).otherwise(page)

    return _with_pages(df, F.transform(pages, labelled))


def nup_tool(df: DataFrame, settings: dict) -> DataFrame:
    """Pages put together on sheets in the layout's order; a sheet is a page of what comes out."""
    booklet, per = settings["layout"] == "booklet", 4 if settings["layout"] == "4-up" else 2
    paged = df.withColumn("_pages", F.split("text", PAGE_BREAK, -1))
    n = F.size("_pages")
    total = (F.ceil(n / 4) * 4 if booklet else F.ceil(n / per) * per).cast("int")

    def page_at(slot: Column) -> Column:
        if booklet:
            side = F.floor(slot / 2).cast("int")
            near = (slot % 2 == 1) == (side % 2 == 0)
            slot = F.when(near, side).otherwise(total - 1 - side)
        return F.coalesce(F.get("_pages", slot), F.lit(""))

    slots = F.transform(F.sequence(F.lit(0), total - 1), page_at)
    filled = paged.withColumn("_slots", slots)
    sheets = F.transform(
        F.sequence(F.lit(0), (F.size("_slots") / per).cast("int") - 1),
        lambda k: F.array_join(F.slice("_slots", k * per + 1, per), "\n"),
    )
    return _with_pages(filled, sheets).drop("_pages", "_slots")


BYTES_AT_ONCE = 1 << 22


def some_at_once(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``BYTES_AT_ONCE``, so few documents at a time become Python objects."""
    step = max(1, BYTES_AT_ONCE * batch.num_rows // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def document_tool(fn: Callable[[dict, dict | None], dict], reads: list[str], writes: list[str]):
    """A tool from a function of one document, in which an error is that document's alone.

    ``fn`` gets a dict of the columns ``reads`` and the step's settings and returns new values of (some of) the
    columns ``writes``, which the documents have. What it raises becomes the document's ``error``; a document
    with an error keeps its values and is not passed to ``fn`` again.
    """
    def tool(df: DataFrame, settings: dict | None) -> DataFrame:
        keep = [c for c in df.columns if c not in writes and c != "error"]
        rows = df.select(*keep, *writes, "error", *[F.col(c).alias(f"_in{i}") for i, c in enumerate(reads)])
        out = StructType(rows.schema.fields[:len(keep) + len(writes) + 1])
        kinds = [f.type for f in to_arrow_schema(out)][len(keep):]

        def one(error, old: dict, given: dict) -> tuple:
            if error is not None:
                return (*old.values(), error)
            try:
                new = {**old, **fn(given, settings)}
                # what does not fit the column is the document's error too
                return (*(pa.scalar(new[c], kind).as_py() for c, kind in zip(writes, kinds)), None)
            except Exception as e:
                return (*old.values(), f"{type(e).__name__}: {e}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in some_at_once(whole)):
                lists = [c.to_pylist() for c in batch.columns[len(keep):]]
                n = len(writes)
                made = [one(row[n], dict(zip(writes, row)), dict(zip(reads, row[n + 1:]))) for row in zip(*lists)]
                columns = list(zip(*made)) if made else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(keep)], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=out.names
                )

        done = rows.mapInArrow(run, out)
        if "text" in writes and "n_bytes" not in writes:
            done = done.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
        return done.select(*df.columns)

    return tool


def _guarded(tool, df: DataFrame, settings: dict | None) -> DataFrame:
    """``df`` after a tool that may set ``error``; documents with one are as they were, with a note for a new one."""
    old = F.struct(*df.columns)
    out = tool(df.withColumn("_before", old), settings)
    failed, fresh = F.col("error").isNotNull(), F.col("_before.error").isNull()
    note = _note("failed", F.col("error"), fresh)
    kept = {c: F.when(failed, F.col("_before")[c]).otherwise(F.col(c)) for c in df.columns if c not in ("error", "notes")}
    kept["error"] = F.when(fresh, F.col("error")).otherwise(F.col("_before.error"))
    kept["notes"] = F.when(failed | ~fresh, F.concat("_before.notes", note)).otherwise(F.col("notes"))
    return out.select(*[kept[c].alias(c) for c in df.columns])


class Recipe:
    """An ordered list of tools for every document, with a note for every outcome.

    Documents: doc_id, file, text, n_bytes and what else the tools need. A tool is any function
    (DataFrame, settings) → DataFrame that keeps one row per document; ``register`` adds one. A registered
    tool may set a document's ``error`` (``document_tool`` does so for what a function raises, a tool of
    column expressions by ``try_`` functions): that document fails with a note, keeps the values it had, and
    takes no further part; all others go on.
    The whole recipe is one lazy plan; notes travel with their row and are split off at the end. Every
    step that does not run is a note on every document.
    """

    def __init__(self, tools: list[str], settings: dict[str, dict] | None = None):
        self.tools, self.settings = tools, settings or {}
        self.may_fail: set[str] = set()
        self.known = {
            "redact": redact_tool, "metadata": metadata_tool, "compress": compress_tool,
            "headerFooter": header_footer_tool, "nup": nup_tool,
        }

    def register(self, name: str, tool) -> Recipe:
        self.known[name] = tool
        self.may_fail.add(name)
        return self

    def run(self, docs: DataFrame, refused: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """(outputs, notes). Documents with a refusal reason pass through as failed."""
        why = refused if refused is not None else F.lit(None).cast("string")
        if "n_bytes_estimate" not in docs.columns:
            docs = docs.withColumn("n_bytes_estimate", F.lit(None).cast("bigint"))
        df = docs.withColumn("error", why).withColumn(
            "notes", _note("failed", F.col("error"), F.col("error").isNotNull())
        )
        bad, good = df.filter(F.col("error").isNotNull()), df.filter(F.col("error").isNull())
        guard = False
        for name in self.tools:
            tool = self.known.get(name)
            guard = guard or name in self.may_fail
            why_not = None
            if tool is None:
                why_not = "draws on pages" if name in SETTINGS else "unknown step"
            elif name in SETTINGS and name not in self.settings:
                why_not = "no settings"
            if why_not is None:
                given = self.settings.get(name)
                good = _guarded(tool, good, given) if guard else tool(good, given)
            else:
                left_out = _note("changed", F.lit(f"{name}: {why_not}, step left out"), F.lit(True))
                left_out = F.when(F.col("error").isNull(), left_out).otherwise(F.array().cast(f"array<{NOTE}>"))
                good = good.withColumn("notes", F.concat("notes", left_out))
        out = good.select(*df.columns).unionByName(bad)
        notes = out.select("doc_id", "file", F.explode("notes").alias("n")).select("doc_id", "file", "n.kind", "n.detail")
        return out.drop("notes"), notes


def keep_original_when_larger(docs: DataFrame, results: DataFrame, satisfied: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Per document the result or, where that is no smaller, the original; with notes.

    ``docs`` and ``results``: doc_id, file, n_bytes, text.
    """
    r = results.select("doc_id", F.col("n_bytes").alias("_rb"), F.col("text").alias("_rt"))
    j = docs.join(r, "doc_id", "left")
    ok = satisfied if satisfied is not None else F.lit(True)
    choice = F.when(F.col("_rb").isNull(), "original").otherwise(never_larger(F.col("n_bytes"), F.col("_rb"), ok))
    use = choice.isin("result", "larger", "same")
    out = j.select(
        "doc_id", "file", F.when(use, F.col("_rt")).otherwise(F.col("text")).alias("text"),
        F.when(use, F.col("_rb")).otherwise(F.col("n_bytes")).alias("n_bytes"), choice.alias("choice"),
    )
    notes = out.filter(F.col("choice") == "original").select(
        "doc_id", "file", F.lit("kept-original").alias("kind"), F.lit("result not smaller").alias("detail")
    )
    return out, notes
