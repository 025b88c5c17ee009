"""Document facts: metadata, form fields, fonts, annotations, notes and stored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.names import page_label, position_string, type_label
from corpuskit.functions.text import find_paths
from corpuskit.operators.ordered import counted_join, number_rows
from corpuskit.operators.unique_names import unique_names

FIELDS = ["title", "author", "subject", "creator", "producer", "creation_date", "modification_date", "keywords"]
FLAGS = [
    "has_xmp", "has_embedded_javascript", "has_open_action", "has_additional_actions",
    "has_embedded_files", "has_page_thumbnails", "has_optional_content",
]


def _found(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def scrub_metadata(meta: DataFrame, settings: dict[str, bool] | None = None) -> DataFrame:
    """Empty exactly the selected fields; without settings, whatever the row itself holds."""
    def drop(c):
        return F.lit(bool(settings.get(c))) if settings is not None else F.lit(True)

    new = {c: F.when(~drop(c), F.col(c)) for c in FIELDS if c in meta.columns}
    new |= {c: F.when(~drop(c), F.col(c)).otherwise(False) for c in FLAGS if c in meta.columns}
    if "custom_info" in meta.columns:
        empty = F.create_map().cast("map<string,string>")
        new["custom_info"] = F.when(~drop("custom_info"), F.col("custom_info")).otherwise(empty)
    return meta.withColumns(new)


def finding_count() -> Column:
    """Filled fields, set flags, and custom entries (an empty custom section counts once)."""
    n = F.lit(0)
    for c in FIELDS:
        n = n + _found(c).cast("int")
    for c in FLAGS:
        n = n + F.coalesce(F.col(c), F.lit(False)).cast("int")
    custom = F.when(F.col("custom_info").isNotNull(), F.greatest(F.lit(1), F.size("custom_info"))).otherwise(0)
    return (n + custom).cast("bigint")


def metadata_inventory(meta: DataFrame) -> DataFrame:
    """Long table of findings: (doc_id, setting, value), and the local paths inside them."""
    text = [F.struct(F.lit(c).alias("setting"), F.col(c).alias("value")) for c in FIELDS]
    flags = [
        F.struct(F.lit(c).alias("setting"), F.when(F.col(c), F.lit("present")).alias("value")) for c in FLAGS
    ]
    custom = F.transform(
        F.map_entries(F.coalesce("custom_info", F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(
            F.lit("custom_info").alias("setting"), F.concat_ws("=", e["key"], e["value"]).alias("value")
        ),
    )
    rows = meta.select("doc_id", F.explode(F.concat(F.array(*text, *flags), custom)).alias("f"))
    return rows.select("doc_id", "f.setting", "f.value").filter(F.coalesce(F.col("value") != "", F.lit(False)))


def path_findings(inventory: DataFrame) -> DataFrame:
    """Local file paths with where they stand and the setting that removes them."""
    return inventory.select("doc_id", "setting", F.explode(find_paths(F.col("value"))).alias("path"))


def rename_fields(fields: DataFrame, source: str, name: str) -> DataFrame:
    """Merged forms: one field per (source, name); a name taken by another source gets ``_2`` …

    Made-up names stay clear of every original name.
    """
    one = fields.dropDuplicates([source, name])
    return unique_names(one, name, source, "new_name", fmt="_n", avoid_all=True)


def field_matrix(fields: DataFrame, names: list[str]) -> DataFrame:
    """Form fields of many documents as one wide table. The names are given, so no extra pass."""
    return fields.groupBy("doc_id").pivot("name", names).agg(F.first("value", ignorenulls=True))


def font_findings(fonts: DataFrame, standard: dict[str, str]) -> DataFrame:
    """Per base font: the pages where it is not embedded, and its standard match or NULL."""
    base = F.regexp_replace("font", r"^[A-Z]{6}\+", "")
    table = F.create_map(*[F.lit(x) for kv in standard.items() for x in kv])
    return (
        fonts.filter(~F.col("embedded"))
        .groupBy("doc_id", base.alias("base_font"))
        .agg(F.sort_array(F.collect_set("page_no")).alias("pages"))
        .withColumn("standard", F.try_element_at(table, F.col("base_font")))
    )


def varying_sizes(pages: DataFrame) -> DataFrame:
    """Do the outputs of a document have more than one size? Two extremes decide, no distinct set."""
    s = F.struct("width", "height")
    return pages.groupBy("doc_id").agg((F.min(s) != F.max(s)).alias("varying"))


def storage_report(files: DataFrame) -> DataFrame:
    """Files and bytes by kind, and how many languages occur."""
    return files.groupBy("kind").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_distinct("lang").alias("langs")
    )


def dedupe_content(parts: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Identical parts collapse to the first name: (name, kept_name).

    ``parts``: name, content. Length and hash stand for the content; groups are combined
    map-side, and the way back is spread over sub-keys, so many copies of one part do no harm.
    """
    keyed = parts.select(
        "name", F.octet_length("content").alias("_len"), F.sha2(F.col("content").cast("binary"), 256).alias("_sha")
    )
    first = keyed.groupBy("_len", "_sha").agg(F.min("name").alias("kept_name"), F.count(F.lit(1)).alias("_n"))
    named = counted_join(keyed, first, ["_len", "_sha"], "_n").select("name", "kept_name")
    if refs is None:
        return named
    return refs.join(named, refs["part"] == named["name"], "left").select(
        *[refs[c] for c in refs.columns if c != "part"], F.coalesce("kept_name", "part").alias("part")
    )


# Fixed value: the order in which note groups are shown.
NOTE_ORDER = ["failed", "kept-original", "changed", "metadata-scrubbed", "renamed"]


def group_notes(notes: DataFrame) -> DataFrame:
    """Notes with the place of their group and their place in it (``seq`` is the given order)."""
    rank = F.array_position(F.array(*[F.lit(k) for k in NOTE_ORDER]), F.col("kind"))
    ranked = notes.withColumn("group_no", rank.cast("bigint")).filter("group_no > 0")
    return number_rows(ranked, ["kind"], "seq", out="note_no")


def outcome_counts(notes: DataFrame) -> DataFrame:
    """One row: files in the run, completed and failed."""
    files = notes.groupBy("file").agg(F.bool_or(F.coalesce(F.col("kind") == "failed", F.lit(False))).alias("_bad"))
    return files.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("_bad")).alias("completed"), F.count_if("_bad").alias("failed")
    )


def annotation_order(ann: DataFrame) -> Column:
    y = F.coalesce(
        F.col("rect")["y"], F.col("y"), F.try_element_at("points", F.lit(1))["y"], F.lit(0.0)
    )
    return F.struct(F.col("page_no").isNull().alias("d"), F.col("page_no").alias("p"), y.alias("y"), F.col("ann_no").alias("n"))


def annotation_summary(ann: DataFrame, doc_names: DataFrame) -> DataFrame:
    """Text report per document, notes by page (detached last) and height.

    A note is one struct with its order first, so sorting the collected array orders it; the
    report of one document is one text value, as in the written file.
    """
    note = F.struct(
        annotation_order(ann).alias("o"),
        type_label(F.col("type")).alias("label"),
        page_label(F.col("page_no")).alias("page"),
        F.coalesce(F.nullif("author", F.lit("")), F.lit("Anonymous")).alias("author"),
        F.coalesce(F.nullif("date", F.lit("")), F.lit("N/A")).alias("date"),
        position_string(F.col("rect"), F.col("x"), F.col("y"), F.col("points")).alias("pos"),
        F.coalesce(F.nullif("text", F.lit("")), F.nullif("data", F.lit("")), F.lit("(No text content)")).alias("text"),
    )
    per = ann.groupBy("doc_id").agg(F.sort_array(F.collect_list(note)).alias("_notes"))
    rule, dash = "=" * 40, "-" * 40
    body = F.transform(
        "_notes",
        lambda n, i: F.concat_ws(
            "\n",
            F.format_string("[Note #%d] %s", i + 1, n["label"]),
            F.concat(F.lit("Page: "), n["page"]),
            F.concat(F.lit("Author: "), n["author"]),
            F.concat(F.lit("Date: "), n["date"]),
            F.concat(F.lit("Position: "), n["pos"]),
            F.concat(F.lit("Text: "), n["text"]),
            F.lit(dash),
        ),
    )
    head = F.concat_ws(
        "\n", F.lit(rule), F.concat(F.lit("ANNOTATION SUMMARY: "), F.coalesce("name", F.lit("Document"))),
        F.concat(F.lit("Total Annotations: "), F.size("_notes").cast("string")), F.lit(rule), F.lit(""),
    )
    return per.join(doc_names, "doc_id", "left").select(
        "doc_id", F.concat_ws("\n", head, F.array_join(body, "\n")).alias("report")
    )
