"""Text functions. Every function takes and returns a ``Column`` and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space (a wider set than Java's ``\s``).
SPACE_CHARS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{SPACE_CHARS}]"

# Entity names that are decoded; any other name stays as written.
NAMED_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": "\u00a0",
    "mdash": "—",
    "ndash": "–",
    "hellip": "…",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
}

# Fixed value: code point ranges of right-to-left scripts, as a Java character class.
RTL_CLASS = (
    r"\u0590-\u08FF\uFB1D-\uFDFF\uFE70-\uFEFF"
    r"\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}"
)

# What a cell starting with + - or @ may be without counting as a formula,
# and what makes it one.
SIGNED_AMOUNT = (
    rf"^[+-]{SPACE}?(?:[$€£¥₹]{SPACE}?|[A-Z]{{3}}{SPACE})?[0-9][0-9.,{SPACE_CHARS}]*"
    rf"(?:[eE][+-]?[0-9]+)?{SPACE}?(?:%|[$€£¥₹]|[A-Za-z]{{1,4}})?$"
)
PHONE_CELL = rf"^\+[0-9][0-9{SPACE_CHARS}().-]*[0-9]$"
CELL_REF = r"\$?[A-Za-z]{1,3}\$?[0-9]+"
FORMULA_SYNTAX = (
    rf"[A-Za-z_][A-Za-z0-9_.]*\(|\||!{CELL_REF}|=|"
    rf"(?:[0-9)]|{CELL_REF})[-+*/^&](?:[0-9(A-Za-z_$])|^{CELL_REF}(?![A-Za-z0-9])"
)

# Fixed value: shapes of local file paths.
PATH_PATTERN = (
    r"(?:(?<![A-Za-z])[A-Za-z]:[\\/][^" + SPACE_CHARS + r""""'<>)]+"""
    r"|\\\\[A-Za-z0-9._-]+\\[^" + SPACE_CHARS + r""""'<>)]+"""
    r"|/(?:Users|home)/[^" + SPACE_CHARS + r""""'<>)]+)"""
)

TOKEN = r"[\p{L}\p{N}]+"
BASE_SENTENCE = r"[^.!?。！？]+(?:[.!?。！？]+|$)"


def rx_replace(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


# The same characters, one by one, for functions that take a set instead of a pattern.
SPACE_SET = "".join(
    chr(c)
    for lo, hi in (
        (9, 13), (32, 32), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
    )
    for c in range(lo, hi + 1)
)


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_SET))


def collapse_space(c: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    blank = F.translate(c, SPACE_SET, " " * len(SPACE_SET))
    return F.trim(rx_replace(blank, " {2,}", " "))


def chars(c: Column) -> Column:
    """Array of the characters (code points) of a string; empty for the empty string."""
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def _running(arr: Column, start: Column) -> Column:
    """Sum before each member, by one fold (short arrays only: the result is copied per step)."""
    first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        arr,
        first,
        lambda acc, v: F.struct(
            (acc["at"] + v).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
        ),
        lambda acc: acc["out"],
    )


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often, and in whatever lambda, it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(arr: Column) -> Column:
    """Sum of all earlier members, for every member; in blocks, so long arrays stay cheap."""
    size = 128

    def of_blocks(blocks: Column) -> Column:
        starts = _running(
            F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v)), F.lit(0)
        )
        return F.flatten(F.zip_with(blocks, starts, _running))

    def of_all(a: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")),
            lambda b: F.slice(a, b * size + 1, F.lit(size)),
        )
        return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(once(blocks, of_blocks))

    return once(arr, of_all)


def all_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokenize(c: Column) -> Column:
    """Distinct lower-case letter/digit runs in first-seen order."""
    return F.array_distinct(all_tokens(c))


def snippet(text: Column, token: Column, max_len: int = 80, at: Column | None = None) -> Column:
    """A window of ``max_len`` characters centred on the first occurrence of ``token``.

    ``at`` is the 0-based place of the token if the caller has it as a column already.
    """
    n = F.length(text)
    at = F.instr(F.lower(text), F.lower(token)) - 1 if at is None else at
    half = F.floor((F.lit(max_len) - F.length(token)) / 2)
    start = F.greatest(F.lit(0), at - half).cast("int")
    end = F.least(n, start + max_len)
    window = collapse_space(F.substring(text, start + 1, F.lit(max_len)))
    whole = collapse_space(text)
    head = F.when(
        F.length(whole) > max_len, F.concat(F.substring(whole, 1, max_len), F.lit("..."))
    ).otherwise(whole)
    cut = F.concat(
        F.when(start > 0, "...").otherwise(""), window, F.when(end < n, "...").otherwise("")
    )
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("")).when(at < 0, head).otherwise(cut)


def find_paths(c: Column) -> Column:
    """Distinct local file paths in a string, without trailing punctuation."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PATH_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: rx_replace(p, "[.,;]+$", "")))


def needle_spellings(c: Column) -> Column:
    """Forms under which a needle may survive: lower case, two bytes a character, hex digits.

    Characters beyond two bytes have no wide form; hex digits need characters of one byte.
    """
    low = F.lower(c)
    wide = F.decode(F.encode(rx_replace(low, "[\\x{10000}-\\x{10FFFF}]", ""), "UTF-16BE"), "ISO-8859-1")
    narrow = c.rlike("^[\\x00-\\xFF]+$")
    digits = F.lower(F.hex(F.encode(F.when(narrow, c).otherwise(F.lit("")), "ISO-8859-1")))
    return F.when(narrow, F.array(low, wide, digits)).otherwise(F.array(low, wide))


def strip_invalid_xml(c: Column) -> Column:
    """Drop characters XML 1.0 does not allow; tab, line feed and return stay."""
    return rx_replace(c, r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]+", "")


def _code_point(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _decode_one(entity: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in NAMED_ENTITIES.items() for x in kv])
    body = F.substring(entity, 2, F.length(entity) - 2)
    hexa = F.regexp_extract(body, "^#[xX]([0-9a-fA-F]+)$", 1)
    deci = F.regexp_extract(body, "^#([0-9]+)", 1)
    code = F.when(hexa != "", F.conv(F.when(F.length(hexa) <= 8, hexa), 16, 10)).when(
        deci != "", F.when(F.length(deci) <= 9, deci)
    ).cast("bigint")
    usable = (code >= 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return (
        F.when(F.startswith(body, F.lit("#")), F.when(usable, _code_point(code)).otherwise(entity))
        .otherwise(F.coalesce(F.try_element_at(named, body), entity))
    )


def decode_entities(c: Column) -> Column:
    """Named, decimal and hex entities in one pass, so nothing is decoded twice."""
    pattern = "&(?:#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), _decode_one)
    glued = F.zip_with(
        F.split(c, pattern, -1), found, lambda part, d: F.concat(part, F.coalesce(d, F.lit("")))
    )
    return F.when(F.instr(c, "&") == 0, c).otherwise(F.array_join(glued, ""))


def is_rtl(c: Column, fallback: bool = False) -> Column:
    """Direction by majority of letters; a tie goes to the first letter."""
    letters = rx_replace(c, r"[^\p{L}]+", "")
    rtl = F.length(rx_replace(letters, f"[^{RTL_CLASS}]+", ""))
    ltr = F.length(letters) - rtl
    return (
        F.when(F.length(letters) == 0, F.lit(fallback))
        .when(rtl != ltr, rtl > ltr)
        .otherwise(letters.rlike(f"^[{RTL_CLASS}]"))
    )


def neutralize_formula(c: Column) -> Column:
    """Quote a cell a spreadsheet would run as a formula."""
    harmless = c.rlike(SIGNED_AMOUNT) | c.rlike(PHONE_CELL)
    risky = F.substring(c, 2, 2**31 - 1).rlike(FORMULA_SYNTAX)
    return (
        F.when(c.rlike(r"^[=\t\r]"), F.concat(F.lit("'"), c))
        .when(c.rlike(r"^[+\-@]") & ~harmless & risky, F.concat(F.lit("'"), c))
        .otherwise(c)
    )


def csv_escape(c: Column) -> Column:
    cell = neutralize_formula(c)
    return F.when(
        cell.rlike('[,"\n\r]'),
        F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"')),
    ).otherwise(cell)


def tsv_cell(c: Column) -> Column:
    return neutralize_formula(rx_replace(rx_replace(c, "\t", " "), "[\r\n]+", " "))


def elide(c: Column, limit: int = 160) -> Column:
    cut = rx_replace(F.substring(c, 1, limit - 1), f"{SPACE}+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def safe_link(c: Column) -> Column:
    """The address when its scheme is http, https, mailto or tel; else NULL."""
    link = trim_space(c)
    return F.when(link.rlike(r"(?i)^(?:https?://[^/\s]|(?:mailto|tel):)"), link)


def is_internal_link(c: Column) -> Column:
    return F.coalesce(F.startswith(trim_space(c), F.lit("#")), F.lit(False))


def fuzzy_score(haystack: Column, needle: Column) -> Column:
    """Subsequence score: runs, word starts and short texts count more; 0 when not contained."""
    text = F.lower(haystack)

    def step(acc: Column, ch: Column) -> Column:
        found = F.call_function("locate", ch, text, acc["at"] + 2) - 1
        gain = F.when(found == acc["at"] + 1, 3).otherwise(1) + F.when(
            (found == 0) | (F.substring(text, found, 1) == " "), 2
        ).otherwise(0)
        ok = acc["ok"] & (found >= 0)
        return F.struct(
            F.when(ok, found).otherwise(acc["at"]).alias("at"),
            F.when(ok, acc["score"] + gain).otherwise(0).alias("score"),
            ok.alias("ok"),
        )

    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("score"), F.lit(True).alias("ok"))
    raw = F.aggregate(chars(F.lower(needle)), start, step, lambda acc: acc["score"])
    return (
        F.when(F.length(needle) == 0, F.lit(1.0))
        .when(raw == 0, F.lit(0.0))
        .otherwise(raw / F.sqrt(F.length(text)))
    )


def base_sentences(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(BASE_SENTENCE), F.lit(0))
