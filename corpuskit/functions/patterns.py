"""Sensitive patterns: cheap regex first, check digits second, overlaps by fixed precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import chars, once, sums_before

_L = r"(?<![A-Za-z0-9_])"
_R = r"(?![A-Za-z0-9_])"
_H = "[0-9A-Fa-f]{1,4}"
_MAIL = r"A-Za-z0-9!#$%&'*+/=?^_`{|}~-"
_LABEL = r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WORD = r"[A-Z0-9]++(?![a-z_])"

# The shape of each category, in order of precedence. Word edges are ASCII
# edges and repeats are possessive, so one long line cannot make the matcher backtrack.
PATTERNS = [
    ("email", rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++(?:\.[{_MAIL}]++)*+@{_LABEL}(?:\.{_LABEL})++"),
    ("uk-nino", rf"{_L}(?!BG|GB|NK|KN|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{{6}}[A-D]{_R}"),
    ("passport", rf"{_L}[A-Z0-9]{{9}}[0-9]{_R}"),
    ("iban", rf"{_L}[A-Z]{{2}}[0-9]{{2}}(?:{_WORD}(?: {_WORD})*+|(?: {_WORD})++)"),
    ("ssn", rf"{_L}(?!000|666|9[0-9][0-9])[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}{_R}"),
    ("credit-card", rf"{_L}[0-9](?:[ -]?[0-9]){{12,18}}{_R}"),
    ("ip", rf"{_L}(?:{_OCTET}\.){{3}}{_OCTET}{_R}"),
    (
        "ip6",
        rf"(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:(?![0-9A-Fa-f:])|(?:{_H}:){{1,6}}:{_H}"
        rf"|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}"
        rf"|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}"
        rf"|{_H}:(?::{_H}){{1,6}}|::(?:{_H}:){{0,6}}{_H}",
    ),
    ("phone", rf"(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_R}"),
]
# What a text must contain before the regex of a category is worth running.
_NEEDS = {"email": "@", "ip6": ":", "ssn": "-", "ip": "."}

HIT_TYPE = "array<struct<category:string,start:int,end:int,text:string>>"


def _face(ch: Column) -> Column:
    """Digit at face value, A..Z as 10..35, anything else 0."""
    code = F.ascii(ch)
    return (
        F.when(code.between(48, 57), code - 48).when(code.between(65, 90), code - 55).otherwise(0)
    )


def luhn(digits: Column) -> Column:
    doubled = F.transform(
        chars(F.reverse(digits)),
        lambda ch, i: (F.ascii(ch) - 48) * (1 + i % 2) - F.when(
            (i % 2 == 1) & (F.ascii(ch) > 52), 9
        ).otherwise(0),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.when(
        digits.rlike("^[0-9]{13,19}$") & ~digits.rlike("^0+$"), total % 10 == 0
    ).otherwise(False)


def iban_valid(raw: Column) -> Column:
    s = F.upper(raw)
    turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
    rest = F.aggregate(
        chars(turned),
        F.lit(0),
        lambda a, ch: (a * F.when(ch.between("0", "9"), 10).otherwise(100) + _face(ch)) % 97,
    )
    shape = F.length(s).between(15, 34) & s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
    return F.when(shape, rest == 1).otherwise(False)


def icao_check_digit(nine: Column) -> Column:
    weighted = F.transform(
        chars(nine),
        lambda ch, i: _face(ch) * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1),
    )
    return F.aggregate(weighted, F.lit(0), lambda a, v: a + v) % 10


def _accepted(category: str, text: Column) -> Column | None:
    if category == "passport":
        return icao_check_digit(F.substring(text, 1, 9)) == F.ascii(F.substring(text, 10, 1)) - 48
    if category == "iban":
        return iban_valid(F.replace(text, F.lit(" "), F.lit("")))
    if category == "credit-card":
        return luhn(F.regexp_replace(text, "[ -]", ""))
    if category == "ip6":
        colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
        return (colons >= 2) & ~text.rlike("^[0-9]{1,2}(?::[0-9]{2}){1,2}$")
    return None


def _labelled(category: str, spans: Column) -> Column:
    """The spans that pass the check of their category, with its name."""
    if _accepted(category, F.lit("")) is not None:
        spans = F.filter(spans, lambda s: _accepted(category, s["text"]))
    label = F.lit("ip" if category == "ip6" else category).alias("category")
    return F.transform(spans, lambda s: F.struct(label, s["start"], s["end"], s["text"]))


def match_spans(text: Column, pattern: str, matches: Column) -> Column:
    """Half-open offsets of all regex matches: lengths of the parts between them, summed up."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), F.length)

    def located(gaps: Column) -> Column:
        before = sums_before(F.zip_with(gaps, matches, lambda g, m: g + F.length(m)))
        starts = F.zip_with(before, gaps, lambda b, g: b + g)
        return F.zip_with(
            starts,
            matches,
            lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("text")),
        )

    spans = once(gaps, located).cast("array<struct<start:int,end:int,text:string>>")
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(F.size(matches) > 0, spans).otherwise(empty)


def with_pattern_hits(df: DataFrame, text_col: str = "text", out: str = "hits") -> DataFrame:
    """Add the array of hits in document order.

    Matches are found per category in one projection, located and resolved in the next, so
    each regex runs once per text for finding and once for locating, and only where needed.
    """
    text = F.col(text_col)
    none = F.array().cast("array<string>")
    digits = text.rlike("[0-9]")
    found = {}
    for category, pattern in PATTERNS:
        worth = F.instr(text, _NEEDS[category]) > 0 if category in _NEEDS else digits
        found[f"_m_{category}"] = F.when(
            worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        ).otherwise(none)
    candidates = []
    for category, pattern in PATTERNS:
        spans = match_spans(text, pattern, F.col(f"_m_{category}"))
        candidates.append(_labelled(category, spans))
    empty = F.array().cast(HIT_TYPE)

    def claim(acc: Column, h: Column) -> Column:
        taken = F.exists(acc, lambda a: (h["start"] < a["end"]) & (a["start"] < h["end"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(h)))

    resolved = F.aggregate(F.concat(*candidates).cast(HIT_TYPE), empty, claim)
    by_start = F.transform(
        F.array_sort(
            F.transform(
                resolved,
                lambda h: F.struct(h["start"], h["end"], h["category"], h["text"]),
            )
        ),
        lambda h: F.struct(h["category"], h["start"], h["end"], h["text"]),
    )
    any_match = F.lit(False)
    for name in found:
        any_match = any_match | (F.size(F.col(name)) > 0)
    return (
        df.withColumns(found)
        .withColumn(out, F.when(any_match, by_start).otherwise(empty))
        .drop(*found)
    )
