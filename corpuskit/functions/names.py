"""Names, labels and numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.text import SPACE, chars, rx_replace, trim_space

MAX_STEM_CHARS = 80
MAX_STEM_BYTES = 180
MAX_SHEET_NAME = 31
MAX_BATES_DIGITS = 12
# Fixed value: device names no file may have.
RESERVED_STEM = r"(?i)^(con|prn|aux|nul|com[0-9¹²³]|lpt[0-9¹²³])$"

KB, MB, GB = 1_000, 1_000_000, 1_000_000_000


def js_round(c: Column) -> Column:
    """Round half up, also below zero."""
    return F.floor(c + 0.5)


def pad_number(value: Column, width: Column | int) -> Column:
    """Zero-pad on the left; a longer number is kept whole."""
    text = value.cast("string")
    width = F.lit(width) if isinstance(width, int) else width
    return F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))


def cut_bytes(c: Column, max_bytes: int) -> Column:
    """Longest prefix of whole characters within a number of UTF-8 bytes."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(True).alias("ok"))

    def step(acc: Column, ch: Column) -> Column:
        n = acc["n"] + F.octet_length(ch)
        ok = acc["ok"] & (n <= max_bytes)
        return F.struct(
            F.when(ok, F.concat(acc["s"], ch)).otherwise(acc["s"]).alias("s"),
            F.when(ok, n).otherwise(acc["n"]).alias("n"),
            ok.alias("ok"),
        )

    folded = F.aggregate(chars(c), start, step, lambda a: a["s"])
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(folded)


def sanitize_file_stem(title: Column, fallback: Column) -> Column:
    s = rx_replace(title, r"[\x00-\x1f\x7f]", " ")
    s = rx_replace(s, r'[/\\<>:"|?*]', "-")
    s = rx_replace(trim_space(rx_replace(s, f"{SPACE}+", " ")), r"^\.+", "")
    s = cut_bytes(F.substring(s, 1, MAX_STEM_CHARS), MAX_STEM_BYTES)
    s = rx_replace(s, r"(?:\.|" + SPACE + r")+$", "")
    first = trim_space(F.substring_index(s, ".", 1))
    s = F.when(first.rlike(RESERVED_STEM), F.concat(s, F.lit("_"))).otherwise(s)
    return F.when(s == "", fallback).otherwise(s)


def sanitize_sheet_name(name: Column) -> Column:
    s = trim_space(rx_replace(rx_replace(name, r"[\[\]:*?/\\\x00-\x1f]", " "), f"{SPACE}+", " "))
    s = trim_space(rx_replace(rx_replace(s, "^'+", ""), "'+$", ""))
    s = F.when(F.length(s) > MAX_SHEET_NAME, trim_space(F.substring(s, 1, MAX_SHEET_NAME))).otherwise(s)
    return (
        F.when(F.length(s) == 0, F.lit("Sheet"))
        .when(F.lower(s) == "history", F.lit("History sheet"))
        .otherwise(s)
    )


def filename_pattern(
    pattern: str, base: Column, index: Column, total: Column, day: str
) -> Column:
    """Fill ``{basename}``, ``{index}`` and ``{date}``; other braces stay."""
    index = pad_number(index, F.length(total.cast("string")))
    s = F.replace(F.lit(pattern), F.lit("{basename}"), base)
    s = F.replace(s, F.lit("{index}"), index)
    return F.replace(s, F.lit("{date}"), F.lit(day))


def strip_extension(name: Column) -> Column:
    return rx_replace(name, r"(?i)\.pdf$", "")


def bates_label(prefix: str, digits: int, start: int, offset: Column) -> Column:
    digits = min(MAX_BATES_DIGITS, max(1, int(digits)))
    value = F.lit(max(0, int(start))) + F.greatest(F.lit(0), offset)
    return F.concat(F.lit(prefix), pad_number(value, digits))


def column_ref(index: Column) -> Column:
    """0 → A, 25 → Z, 26 → AA, up to five letters; NULL below 0 and beyond (12 356 630 columns)."""

    def letter(n: Column) -> Column:
        return F.call_function("char", (n % 26 + 65).cast("bigint"))

    rest, letters = index, [letter(index)]
    for _ in range(4):
        rest = F.floor(rest / 26) - 1
        letters.insert(0, F.when(rest >= 0, letter(rest)).otherwise(""))
    known = (index >= 0) & (index < sum(26**k for k in range(1, 6)))
    return F.when(known, F.concat(*letters))


def cell_address(row: Column, col: Column) -> Column:
    return F.concat(column_ref(col), (row + 1).cast("string"))


def field_text(raw: Column) -> Column:
    """A field value as the text of a number: currency sign and grouping commas removed."""
    s = trim_space(F.coalesce(raw, F.lit("")))
    s = rx_replace(s, rf"^[$€£¥₹]{SPACE}*", "")
    grouped = s.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$")
    return F.when(grouped, F.replace(s, F.lit(","), F.lit(""))).otherwise(s)


def parse_field_number(raw: Column) -> Column:
    """Text → number: blank is 0, anything that is not a plain number is NULL."""
    s = field_text(raw)
    ok = s.rlike(r"^[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)$")
    return F.when(trim_space(F.coalesce(raw, F.lit(""))) == "", F.lit(0.0)).when(
        ok, s.try_cast("double")
    )


def field_error(raw: Column) -> Column:
    """The reason a field value is not a number, else NULL."""
    bad = parse_field_number(raw).isNull()
    return F.when(bad, F.concat(F.lit('is not a number ("'), trim_space(raw), F.lit('")')))


def list_field_value(values: Column) -> tuple[Column, Column]:
    """Value and error of a multiple-choice field: none → 0, one → parsed, more → error."""
    single = F.try_element_at(values, F.lit(1))
    many = F.size(values) > 1
    value = F.when(F.coalesce(F.size(values), F.lit(0)) == 0, F.lit(0.0)).when(
        ~many, parse_field_number(single)
    )
    error = F.when(
        many, F.lit("has more than one option selected, so it has no single value")
    ).when(F.size(values) == 1, field_error(single))
    return value, error


def plain_decimal(c: Column, places: int) -> Column:
    """Decimal text with at most ``places`` digits and no trailing zeros or point."""
    # decimals hold everything below 10^(38 - places); the few numbers beyond are formatted
    exact = c.cast("double").try_cast(f"decimal(38,{places})").cast("string")
    text = F.coalesce(exact, F.format_string(f"%.{places}f", c.cast("double")))
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")) if places else text


def format_formula_number(c: Column) -> Column:
    text = plain_decimal(c, 6)
    return F.when(text == "-0", F.lit("0")).otherwise(text)


def _sized(bytes_: Column, scale: int, places: int, label: str, up: bool) -> Column:
    factor = 10**places
    scaled = bytes_.cast("double") * factor / scale
    value = (F.ceil(scaled) if up else js_round(scaled)) / factor
    return F.concat(plain_decimal(value, places), F.lit(f" {label}"))


def format_bytes(n: Column) -> Column:
    size = F.abs(n)
    return (
        F.when(size < KB, F.concat(js_round(n).cast("string"), F.lit(" B")))
        .when(size < MB - KB / 2, _sized(n, KB, 0, "KB", False))
        .when(size < GB - MB / 200, _sized(n, MB, 2, "MB", False))
        .otherwise(_sized(n, GB, 2, "GB", False))
    )


def format_bytes_up(n: Column) -> Column:
    """Never below the true size; 999.995 of one unit carries to 1 of the next."""
    kb, mb = F.ceil(n / KB), F.ceil(n.cast("double") * 100 / MB) / 100
    in_kb = (n >= KB) & (n < MB - KB / 2) & (kb < 1000)
    in_mb = (n >= KB) & (n < GB - MB / 200) & (mb < 1000)
    return (
        F.when(n < KB, F.concat(F.ceil(n).cast("string"), F.lit(" B")))
        .when(in_kb, _sized(n, KB, 0, "KB", True))
        .when(in_mb, _sized(n, MB, 2, "MB", True))
        .otherwise(_sized(n, GB, 2, "GB", True))
    )


def size_warning(bytes_: Column) -> Column:
    return F.when(
        bytes_ > 100_000_000,
        F.concat(F.lit("large file: "), js_round(bytes_ / MB).cast("string"), F.lit(" MB")),
    )


def parse_size(raw: Column, min_bytes: int, max_bytes: int) -> Column:
    """``20KB``, ``1.5 MB``, ``2MiB``, ``1,5mb`` → bytes within bounds; junk → NULL."""
    s = rx_replace(F.lower(trim_space(raw)), f"{SPACE}+", "")
    pattern = r"^([0-9]{1,10}(?:[.,][0-9]{1,4})?|[.,][0-9]{1,4})(k|kb|kib|m|mb|mib)?$"
    amount = F.replace(F.regexp_extract(s, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_extract(s, pattern, 2)
    scale = (
        F.when(unit == "mib", 1_048_576)
        .when(unit == "kib", 1024)
        .when(F.startswith(unit, F.lit("m")), MB)
        .otherwise(KB)
    )
    size = F.when(
        unit.endswith("ib"), F.floor(amount * scale / 10) * 10
    ).otherwise(js_round(amount * scale))
    good = (F.length(s).between(1, 24)) & s.rlike(pattern) & (amount > 0)
    return F.when(good, F.least(F.greatest(size, F.lit(min_bytes)), F.lit(max_bytes)).cast("bigint"))


def running_label(template: str, number: Column, total: Column) -> Column:
    """Header, footer or watermark text: ``{n}`` and ``{total}`` filled in."""
    s = F.replace(F.lit(template), F.lit("{n}"), number.cast("string"))
    return F.replace(s, F.lit("{total}"), total.cast("string"))


def image_key(content: Column) -> Column:
    """Content fingerprint: length and hash."""
    return F.concat_ws(":", F.octet_length(content).cast("string"), F.sha2(content, 256))


# Numeric error codes of spreadsheet cells and their texts.
CELL_ERRORS = {
    0x00: "#NULL!",
    0x07: "#DIV/0!",
    0x0F: "#VALUE!",
    0x17: "#REF!",
    0x1D: "#NAME?",
    0x24: "#NUM!",
    0x2A: "#N/A",
    0x2B: "#GETTING_DATA",
}


def cell_text(kind: Column, shown: Column, raw: Column, code: Column, has_formula: Column) -> Column:
    """Text of a spreadsheet cell. ``kind``: z blank, e error, b boolean, d date, else value."""
    shown = F.when(F.length(shown) > 0, shown)
    codes = F.create_map(*[F.lit(x) for kv in CELL_ERRORS.items() for x in kv])
    error = F.coalesce(
        shown,
        F.try_element_at(codes, code),
        F.when(F.startswith(raw, F.lit("#")), raw),
        F.lit("#ERROR!"),
    )
    pending = has_formula & raw.isNull() & code.isNull() & shown.isNull()
    return (
        F.when(kind.isNull() | (kind == "z"), F.lit(""))
        .when(kind == "e", F.when(pending, F.lit("")).otherwise(error))
        .when(shown.isNotNull(), shown)
        .when(kind == "b", F.upper(raw))
        .when(kind == "d", F.substring(raw, 1, 10))
        .otherwise(F.coalesce(raw, F.lit("")))
    )


def column_width(px: Column, wch: Column, widest: Column) -> Column:
    """Column width in points: pixels, else characters, else the widest cell, kept to 32..200."""
    width = (
        F.when(px > 0, px.cast("double"))
        .when(wch > 0, wch * 7 + 5.0)
        .when(widest > 0, F.least(widest + 1, F.lit(40)) * 7 + 5.0)
        .otherwise(8.43 * 7 + 5)
    )
    return F.least(F.lit(200.0), F.greatest(F.lit(32.0), width * 0.75))


# The shown names of annotation types.
TYPE_LABELS = {
    "sticky": "Sticky Note",
    "text": "Text Comment",
    "highlight": "Highlight",
    "rectangle": "Rectangle",
    "freehand": "Freehand Ink",
    "whiteout": "Whiteout",
    "signature": "Signature Stamp",
    "date": "Date Stamp",
    "check": "Checkmark",
}


def type_label(kind: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    other = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 2**31 - 1))
    return F.when(F.coalesce(kind, F.lit("")) == "", F.lit("Note")).otherwise(
        F.coalesce(F.try_element_at(labels, kind), other)
    )


def position_string(rect: Column, x: Column, y: Column, points: Column) -> Column:
    """``X: n%, Y: n%`` of the box, else the point, else the first drawn point."""
    first = F.try_element_at(points, F.lit(1))
    px = F.when(rect.isNotNull(), rect["x"]).when(x.isNotNull() & y.isNotNull(), x).otherwise(first["x"])
    py = F.when(rect.isNotNull(), rect["y"]).when(x.isNotNull() & y.isNotNull(), y).otherwise(first["y"])
    text = F.concat(
        F.lit("X: "), js_round(px * 100).cast("string"),
        F.lit("%, Y: "), js_round(py * 100).cast("string"), F.lit("%"),
    )
    return F.when(px.isNull(), F.lit("N/A")).otherwise(text)


def page_label(page_no: Column) -> Column:
    return F.coalesce((page_no + 1).cast("string"), F.lit("Detached"))
