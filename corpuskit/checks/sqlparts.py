"""SQL fragments shared by the twins of registered queries (DuckDB dialect)."""

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

LINES = """lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no FROM documents)"""
PAGES = LINES + """, pg AS (SELECT doc_id, lang, line_no // 10 AS page_no,
  string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL)"""


def snippet(text: str, token: str) -> str:
    pos = f"(instr(lower({text}), {token}) - 1)"
    start = f"greatest(0, {pos} - CAST(floor((80 - length({token})) / 2) AS BIGINT))"
    end = f"least(length({text}), {start} + 80)"
    win = f"trim(regexp_replace(substring({text}, {start} + 1, {end} - {start}), '{WS}+', ' ', 'g'))"
    return (
        f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END || {win} || "
        f"CASE WHEN {end} < length({text}) THEN '...' ELSE '' END)"
    )


_H = "[0-9A-Fa-f]{1,4}"
_O = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_E = "A-Za-z0-9!#$%&''*+/=?^_`{|}~-"
_A = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
DIGITS = "regexp_replace(m, '[ -]', '', 'g')"
LUHN = (
    f"length({DIGITS}) BETWEEN 13 AND 19 AND NOT regexp_matches({DIGITS}, '^0+$') AND "
    f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN "
    f"(CAST({DIGITS}[length({DIGITS}) + 1 - i] AS INT) * 2) // 10 + (CAST({DIGITS}[length({DIGITS}) + 1 - i] AS INT) * 2) % 10 "
    f"ELSE CAST({DIGITS}[length({DIGITS}) + 1 - i] AS INT) END)) % 10 = 0"
)
_FACE = "(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
_NOSP = "replace(m, ' ', '')"
IBAN = (
    f"length({_NOSP}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform("
    f"string_split(substr({_NOSP}, 5) || substr({_NOSP}, 1, 4), ''), lambda c: "
    f"CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE 1000 + ascii(c) - 55 END)), "
    f"lambda a, v: CASE WHEN v >= 1000 THEN (a * 100 + v - 1000) % 97 ELSE (a * 10 + v) % 97 END) = 1"
)
ICAO = (
    "list_sum(list_transform(range(1, 10), lambda i: (CASE WHEN m[i] BETWEEN '0' AND '9' THEN ascii(m[i]) - 48 "
    "ELSE ascii(m[i]) - 55 END) * (CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END))) % 10 = CAST(m[10] AS INT)"
)
# (label, regex, accept). RE2 has no look-around, so exclusions are conditions on the match.
CATEGORIES = [
    ("email", rf"[{_E}]+(?:\.[{_E}]+)*@{_A}(?:\.{_A})+", "true"),
    ("uk-nino", r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]\b", "substr(m, 1, 2) NOT IN ('BG','GB','NK','KN','TN','ZZ')"),
    ("passport", r"\b[A-Z0-9]{9}[0-9]\b", ICAO),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{1,4})+\b", IBAN),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "substr(m, 1, 3) NOT IN ('000', '666') AND m[1] <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'"),
    ("credit-card", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", LUHN),
    ("ip", rf"\b(?:{_O}\.){{3}}{_O}\b", "true"),
    (
        "ip",
        rf"(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,7}}:|::(?:{_H}:){{0,6}}{_H}",
        "length(m) - length(replace(m, ':', '')) >= 2",
    ),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b", "true"),
]


def hits_sql(source: str, keys: str) -> str:
    """CTEs ending in ``hits(keys, category, s, e, m)`` for the texts of ``source``."""
    out = []
    kept = None
    key_list = [k.strip() for k in keys.split(",")]
    for i, (label, rx, accept) in enumerate(CATEGORIES):
        out.append(
            f"m{i} AS (SELECT {keys}, regexp_extract_all(text, '{rx}') AS ms, string_split_regex(text, '{rx}') AS ps "
            f"FROM {source} WHERE regexp_matches(text, '{rx}'))"
        )
        out.append(
            f"s{i} AS (SELECT {keys}, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: "
            f"CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + "
            f"CASE WHEN i = 1 THEN 0 ELSE coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) END AS BIGINT))) AS s FROM m{i})"
        )
        out.append(f"a{i} AS (SELECT {keys}, '{label}' AS category, s, s + length(m) AS e, m FROM s{i} WHERE {accept})")
        if kept is None:
            out.append(f"k{i} AS (SELECT * FROM a{i})")
        else:
            same = " AND ".join(f"k.{k} = a.{k}" for k in key_list)
            out.append(
                f"k{i} AS (SELECT * FROM {kept} UNION ALL SELECT a.* FROM a{i} a WHERE NOT EXISTS "
                f"(SELECT 1 FROM {kept} k WHERE {same} AND a.s < k.e AND k.s < a.e))"
            )
        kept = f"k{i}"
    out.append(f"hits AS (SELECT * FROM {kept})")
    return ", ".join(out)

# pages of two lines each: (doc_id, source_id, pos, page_key, rotation, n_bytes, text, n)
DP = """dl AS (SELECT doc_id, source AS source_id, unnest(string_split(text, chr(10))) AS line,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no FROM documents),
dp0 AS (SELECT doc_id, source_id, line_no // 2 AS pos, string_agg(line, chr(10) ORDER BY line_no) AS text FROM dl GROUP BY ALL),
dp AS (SELECT doc_id, source_id, pos, doc_id || '-' || pos AS page_key, ((doc_id + pos) % 4) * 90 AS rotation,
  CAST(strlen(text) AS BIGINT) AS n_bytes, text, count(*) OVER (PARTITION BY doc_id) AS n FROM dp0)"""
