"""Scalar functions over whole driver tables."""

from pyspark.sql import functions as F

from corpuskit.checks.registry import register
from corpuskit.functions import geometry as G
from corpuskit.functions import names as N
from corpuskit.functions import patterns as P
from corpuskit.functions import text as X

TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@register(
    "tokenize",
    f"""SELECT doc_id, len(list_distinct({TOKENS_SQL}))::BIGINT AS n_tokens,
    array_to_string(list_sort(list_distinct({TOKENS_SQL})), ' ') AS tokens FROM documents""",
)
def _(t):
    k = X.tokenize(F.col("text"))
    return t.documents.select("doc_id", k.alias("k")).select(
        "doc_id",
        F.size("k").cast("bigint").alias("n_tokens"),
        F.array_join(F.array_sort("k"), " ").alias("tokens"),
    )


@register(
    "snippet",
    rf"""WITH a AS (SELECT doc_id, text, instr(lower(text), 'tion') - 1 AS pos, length(text) AS n FROM documents),
    b AS (SELECT *, greatest(0, pos - 38) AS s FROM a), c AS (SELECT *, least(n, s + 80) AS e FROM b),
    d AS (SELECT *, trim(regexp_replace(substring(text, s + 1, e - s), '{WS}+', ' ', 'g')) AS win,
      trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS whole FROM c)
    SELECT doc_id, CASE WHEN n = 0 THEN '' WHEN pos < 0 THEN
      CASE WHEN length(whole) > 80 THEN substring(whole, 1, 80) || '...' ELSE whole END
      ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || win || (CASE WHEN e < n THEN '...' ELSE '' END) END AS snippet
    FROM d""",
)
def _(t):
    return t.documents.select("doc_id", X.snippet(F.col("text"), F.lit("tion")).alias("snippet"))


CARD = "lpad(CAST(o_orderkey * 7919 + o_custkey * 104729 AS VARCHAR), 16, '4')"


@register(
    "luhn",
    f"""WITH a AS (SELECT o_orderkey, {CARD} AS digits FROM orders),
    b AS (SELECT o_orderkey, digits, list_sum(list_transform(range(1, 17), lambda i:
      CASE WHEN i % 2 = 0 THEN (CAST(substr(digits, 17 - i, 1) AS INT) * 2) // 10 + (CAST(substr(digits, 17 - i, 1) AS INT) * 2) % 10
      ELSE CAST(substr(digits, 17 - i, 1) AS INT) END)) AS total FROM a)
    SELECT o_orderkey, digits, total % 10 = 0 AS valid FROM b""",
)
def _(t):
    n = F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729
    digits = F.lpad(n.cast("string"), 16, "4")
    return t.orders.select("o_orderkey", digits.alias("digits"), P.luhn(digits).alias("valid"))


@register(
    "iban_valid",
    """WITH a AS (SELECT o_orderkey, 'DE' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0')
        || lpad(CAST(o_orderkey AS VARCHAR), 18, '3') AS s FROM orders),
    b AS (SELECT o_orderkey, s, substr(s, 5) || '1314' || substr(s, 3, 2) AS num FROM a)
    SELECT o_orderkey, s AS iban, CAST(num AS HUGEINT) % 97 = 1 AS valid FROM b""",
)
def _(t):
    s = F.concat(
        F.lit("DE"),
        F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"),
        F.lpad(F.col("o_orderkey").cast("string"), 18, "3"),
    )
    return t.orders.select("o_orderkey", s.alias("iban"), P.iban_valid(s).alias("valid"))


@register(
    "icao_check_digit",
    """WITH a AS (SELECT p_partkey, lpad(upper(replace(p_brand, '#', '')), 9, 'X') AS s FROM part)
    SELECT p_partkey, s AS nine, CAST(list_sum(list_transform(range(1, 10), lambda i:
      (CASE WHEN substr(s, i, 1) BETWEEN '0' AND '9' THEN ascii(substr(s, i, 1)) - 48
            WHEN substr(s, i, 1) BETWEEN 'A' AND 'Z' THEN ascii(substr(s, i, 1)) - 55 ELSE 0 END)
      * (CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END))) % 10 AS BIGINT) AS digit FROM a""",
)
def _(t):
    s = F.lpad(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))), 9, "X")
    return t.part.select(
        "p_partkey", s.alias("nine"), P.icao_check_digit(s).cast("bigint").alias("digit")
    )


@register(
    "find_paths",
    r"""WITH a AS (SELECT page_id, replace(url, 'http://', '/home/') || ', C:\data\' || page_id || '.txt;' AS s FROM pages),
    b AS (SELECT page_id, list_transform(regexp_extract_all(s, '(?:[A-Za-z]:[\\/][^\s"''<>)]+|/(?:Users|home)/[^\s"''<>)]+)'),
      lambda p: regexp_replace(p, '[.,;]+$', '')) AS p FROM a)
    SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(p, lambda x: NOT starts_with(x, 's:')))), ' ') AS paths FROM b""",
)
def _(t):
    s = F.concat(
        F.replace("url", F.lit("http://"), F.lit("/home/")),
        F.lit(", C:\\data\\"), F.col("page_id").cast("string"), F.lit(".txt;"),
    )
    return t.pages.select(
        "page_id", F.array_join(F.array_sort(X.find_paths(s)), " ").alias("paths")
    )


@register(
    "needle_spellings",
    r"""SELECT item_id, lower(text) AS low, length(text)::BIGINT AS n_chars, CASE WHEN NOT regexp_matches(text, '[^\x{00}-\x{FF}]') THEN
      array_to_string(list_transform(string_split(text, ''), lambda c: printf('%02x', unicode(c))), '') END AS hexed FROM benchmark""",
)
def _(t):
    s = X.needle_spellings(F.col("text"))
    return t.benchmark.select(
        "item_id",
        s[0].alias("low"),
        (F.length(s[1]) / 2).cast("bigint").alias("n_chars"),
        F.get(s, F.lit(2)).alias("hexed"),
    )


@register(
    "strip_invalid_xml",
    r"""SELECT doc_id, md5(regexp_replace(text || chr(1) || 'x' || chr(11), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS clean FROM documents""",
)
def _(t):
    s = F.concat("text", F.lit("\x01x\x0b"))
    return t.documents.select("doc_id", F.md5(X.strip_invalid_xml(s)).alias("clean"))


_ENT = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": "\u00a0", "&amp;": "&"}


def _ent_sql(c):
    for k, v in _ENT.items():
        c = f"replace({c}, '{k}', '{v}')"
    return c


@register(
    "decode_entities",
    f"SELECT page_id, md5({_ent_sql('html')}) AS decoded, (length(html) - length({_ent_sql('html')}))::BIGINT AS shorter FROM pages",
)
def _(t):
    d = X.decode_entities(F.col("html"))
    return t.pages.select("page_id", "html", d.alias("d")).select(
        "page_id",
        F.md5("d").alias("decoded"),
        (F.length("html") - F.length("d")).cast("bigint").alias("shorter"),
    )


@register(
    "is_rtl",
    r"""WITH a AS (SELECT doc_id, text || repeat('אב', CAST(length(text) * (doc_id % 4) // 6 AS INT)) AS s FROM documents),
    b AS (SELECT doc_id, regexp_replace(s, '\P{L}', '', 'g') AS l FROM a),
    c AS (SELECT doc_id, l, length(regexp_replace(l, '[^\x{0590}-\x{08FF}]', '', 'g')) AS r FROM b)
    SELECT doc_id, CASE WHEN l = '' THEN false WHEN 2 * r <> length(l) THEN 2 * r > length(l)
      ELSE regexp_matches(l, '^[\x{0590}-\x{08FF}]') END AS rtl FROM c""",
)
def _(t):
    s = F.concat("text", F.expr("repeat('אב', cast(length(text) * (doc_id % 4) div 6 as int))"))
    return t.documents.select("doc_id", X.is_rtl(s).alias("rtl"))


_CELL = """CASE o_orderkey % 9 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN '-' || o_totalprice WHEN 2 THEN '+1 555 0100'
  WHEN 3 THEN '@' || o_orderpriority WHEN 4 THEN '+cmd|calc' WHEN 5 THEN 'a,"b"' WHEN 6 THEN '-2+3+A1'
  WHEN 7 THEN o_orderpriority ELSE '-' || o_custkey || ' EUR' END"""
_NEUTRAL = """CASE WHEN o_orderkey % 9 IN (0, 3, 4, 6) THEN '''' || c ELSE c END"""


@register(
    "neutralize_formula",
    f"WITH a AS (SELECT o_orderkey, {_CELL} AS c FROM orders) SELECT o_orderkey, {_NEUTRAL} AS cell FROM a",
)
def _(t):
    c = F.expr(_CELL.replace("'-' || o_totalprice", "concat('-', cast(o_totalprice as string))"))
    return t.orders.select("o_orderkey", c.alias("c")).select(
        "o_orderkey", X.neutralize_formula(F.col("c")).alias("cell")
    )


@register(
    "csv_escape",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '"' || o_orderpriority || ', ""' || o_orderstatus || '""' || '"'
      ELSE o_orderpriority END AS cell FROM orders""",
)
def _(t):
    c = F.when(
        F.col("o_orderkey") % 2 == 0,
        F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')),
    ).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", X.csv_escape(c).alias("cell"))


@register(
    "sanitize_file_stem",
    rf"""WITH a AS (SELECT doc_id, regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g') AS s FROM documents),
    b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(s, '[/\\<>:"|?*]', '-', 'g'), '{WS}+', ' ', 'g')) AS s FROM a),
    c AS (SELECT doc_id, substr(regexp_replace(s, '^\.+', ''), 1, 80) AS s FROM b),
    d AS (SELECT doc_id, coalesce(list_max(list_filter(list_transform(range(0, 81), lambda i: substr(s, 1, i)), lambda p: strlen(p) <= 180)), '') AS s FROM c),
    e AS (SELECT doc_id, regexp_replace(s, '(\.|{WS})+$', '') AS s FROM d)
    SELECT doc_id, CASE WHEN s = '' THEN 'document' WHEN regexp_matches(lower(split_part(s, '.', 1)), '^(con|prn|aux|nul)$') THEN s || '_' ELSE s END AS stem FROM e""",
)
def _(t):
    return t.documents.select(
        "doc_id", N.sanitize_file_stem(F.col("text"), F.lit("document")).alias("stem")
    )


@register(
    "sanitize_sheet_name",
    r"""WITH a AS (SELECT page_id, trim(regexp_replace(regexp_replace(url, '[\[\]:*?/\\]', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM pages),
    b AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'History' ELSE trim(substr(s, 1, 31)) END AS s FROM a)
    SELECT page_id, CASE WHEN s = 'History' THEN 'History sheet' ELSE s END AS sheet FROM b""",
)
def _(t):
    n = F.when(F.col("page_id") % 5 == 0, F.lit("History")).otherwise(F.col("url"))
    return t.pages.select("page_id", N.sanitize_sheet_name(n).alias("sheet"))


@register(
    "filename_pattern",
    """SELECT c_custkey, regexp_replace(c_name || '.PDF', '(?i)\\.pdf$', '') || '_' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '_2024-05-06_{x}' AS name FROM customer""".replace("\\\\", "\\"),
)
def _(t):
    base = N.strip_extension(F.concat("c_name", F.lit(".PDF")))
    name = N.filename_pattern(
        "{basename}_{index}_{date}_{x}", base, F.col("c_custkey"), F.lit(1234567), "2024-05-06"
    )
    return t.customer.select("c_custkey", name.alias("name"))


@register(
    "strip_extension",
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '.pdf.x' END AS stem FROM pages",
)
def _(t):
    n = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".Pdf").otherwise(".pdf.x"))
    return t.pages.select("page_id", N.strip_extension(n).alias("stem"))


@register(
    "bates_label",
    "SELECT o_orderkey, 'DOC-' || CASE WHEN o_orderkey + 95 >= 1000 THEN CAST(o_orderkey + 95 AS VARCHAR) ELSE lpad(CAST(o_orderkey + 95 AS VARCHAR), 4, '0') END AS label FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey", N.bates_label("DOC-", 4, 95, F.col("o_orderkey")).alias("label")
    )


@register(
    "column_ref",
    """SELECT p_partkey, CASE WHEN p_partkey < 26 THEN chr(CAST(65 + p_partkey AS INT))
      WHEN p_partkey < 702 THEN chr(CAST(64 + p_partkey // 26 AS INT)) || chr(CAST(65 + p_partkey % 26 AS INT))
      ELSE chr(CAST(65 + (p_partkey - 702) // 676 AS INT)) || chr(CAST(65 + ((p_partkey - 702) // 26) % 26 AS INT)) || chr(CAST(65 + (p_partkey - 702) % 26 AS INT)) END AS ref,
      CASE WHEN p_size < 26 THEN chr(65 + p_size) ELSE chr(64 + p_size // 26) || chr(65 + p_size % 26) END || (p_partkey + 1) AS address
      FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        N.column_ref(F.col("p_partkey")).alias("ref"),
        N.cell_address(F.col("p_partkey"), F.col("p_size")).alias("address"),
    )


_FIELD = """CASE l_linenumber % 6 WHEN 0 THEN '$ 1,234.50' WHEN 1 THEN '' WHEN 2 THEN 'n/a'
  WHEN 3 THEN '-.5' WHEN 4 THEN '1,23' ELSE '€' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END"""


@register(
    "parse_field_number",
    f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN 1234.5 WHEN 1 THEN 0 WHEN 3 THEN -0.5 WHEN 5 THEN l_quantity END::DOUBLE AS v,
      CASE l_linenumber % 6 WHEN 2 THEN 'is not a number ("n/a")' WHEN 4 THEN 'is not a number ("1,23")' END AS err FROM lineitem""",
)
def _(t):
    f = F.expr(_FIELD)
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint"), f.alias("f")).select(
        "l_orderkey",
        "l_linenumber",
        N.parse_field_number(F.col("f")).alias("v"),
        N.field_error(F.col("f")).alias("err"),
    )


@register(
    "format_formula_number",
    r"""SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.6f', (o_orderkey - 50) / 8), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS s FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey", N.format_formula_number((F.col("o_orderkey") - 50) / 8).alias("s")
    )


_TRIM = r"regexp_replace(regexp_replace({}, '(\.[0-9]*?)0+$', '\1'), '\.$', '')"


@register(
    "format_bytes",
    rf"""WITH a AS (SELECT o_orderkey, CAST(o_orderkey * o_custkey * 37 AS BIGINT) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 999500 THEN CAST(floor(n / 1000 + 0.5) AS BIGINT) || ' KB'
      WHEN n < 999995000 THEN {_TRIM.format("printf('%.2f', floor(n * 100 / 1000000 + 0.5) / 100)")} || ' MB'
      ELSE {_TRIM.format("printf('%.2f', floor(n * 100 / 1000000000 + 0.5) / 100)")} || ' GB' END AS near,
    CASE WHEN n < 1000 THEN n || ' B' WHEN n < 999500 AND ceil(n / 1000) < 1000 THEN CAST(ceil(n / 1000) AS BIGINT) || ' KB'
      WHEN n < 999995000 AND ceil(n * 100 / 1000000) < 100000 THEN {_TRIM.format("printf('%.2f', ceil(n * 100 / 1000000) / 100)")} || ' MB'
      ELSE {_TRIM.format("printf('%.2f', ceil(n * 100 / 1000000000) / 100)")} || ' GB' END AS up FROM a""",
)
def _(t):
    n = F.col("o_orderkey") * F.col("o_custkey") * 37
    return t.orders.select("o_orderkey", n.alias("n")).select(
        "o_orderkey",
        N.format_bytes(F.col("n")).alias("near"),
        N.format_bytes_up(F.col("n")).alias("up"),
    )


@register(
    "fuzzy_score",
    """WITH a AS (SELECT p_partkey, lower(p_name) AS s FROM part),
    b AS (SELECT *, instr(s, 'r') - 1 AS f1 FROM a),
    c AS (SELECT *, CASE WHEN f1 >= 0 AND instr(substr(s, f1 + 2), 'i') > 0 THEN f1 + instr(substr(s, f1 + 2), 'i') ELSE -1 END AS f2 FROM b)
    SELECT p_partkey, round(CASE WHEN f1 < 0 OR f2 < 0 THEN 0 ELSE
      ((CASE WHEN f1 = 0 THEN 3 ELSE 1 END) + (CASE WHEN f1 = 0 OR substr(s, f1, 1) = ' ' THEN 2 ELSE 0 END)
      + (CASE WHEN f2 = f1 + 1 THEN 3 ELSE 1 END) + (CASE WHEN substr(s, f2, 1) = ' ' THEN 2 ELSE 0 END)) / sqrt(length(s)) END, 6) AS score FROM c""",
)
def _(t):
    return t.part.select(
        "p_partkey", F.round(X.fuzzy_score(F.col("p_name"), F.lit("ri")), 6).alias("score")
    )


@register(
    "safe_link",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN NULL ELSE 'mailto:a@b.co' END AS link,
      page_id % 3 = 1 AND page_id % 2 = 1 AS internal FROM pages""",
)
def _(t):
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), "url")).when(
        F.col("page_id") % 3 == 1,
        F.when(F.col("page_id") % 2 == 1, F.lit("#part")).otherwise(F.lit("javascript:alert(1)")),
    ).otherwise(F.lit("mailto:a@b.co"))
    return t.pages.select(
        "page_id", X.safe_link(link).alias("link"), X.is_internal_link(link).alias("internal")
    )


@register(
    "annotation_labels",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Sticky Note' WHEN 'view' THEN 'Highlight' WHEN 'error' THEN 'Note' ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS label,
      CASE WHEN event_type = 'view' THEN 'N/A' ELSE 'X: ' || CAST(floor(value % 1 * 100 + 0.5) AS BIGINT) || '%, Y: ' || CAST(floor(value / 1000 * 100 + 0.5) AS BIGINT) || '%' END AS pos,
      CASE WHEN user_id % 7 = 0 THEN 'Detached' ELSE CAST(user_id + 1 AS VARCHAR) END AS page FROM events""",
)
def _(t):
    kind = F.when(F.col("event_type") == "click", "sticky").when(
        F.col("event_type") == "view", "highlight"
    ).when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    x, y = F.col("value") % 1, F.col("value") / 1000
    rect = F.when(F.col("event_type") == "click", F.struct(x.alias("x"), y.alias("y")))
    px = F.when(F.col("event_type") == "error", x)
    pts = F.when(
        F.col("event_type").isin("signup", "purchase"),
        F.array(F.struct(x.alias("x"), y.alias("y"))),
    )
    page = F.when(F.col("user_id") % 7 != 0, F.col("user_id"))
    return t.events.select(
        "event_id",
        N.type_label(kind).alias("label"),
        N.position_string(rect, px, y, pts).alias("pos"),
        N.page_label(page).alias("page"),
    )


@register(
    "elide",
    """SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE regexp_replace(substr(text, 1, 159), '\\s+$', '') || '…' END AS short FROM documents""".replace("\\\\", "\\"),
)
def _(t):
    return t.documents.select("doc_id", X.elide(F.col("text")).alias("short"))


@register(
    "normalize_rotation",
    """SELECT o_orderkey, ((CAST(floor((o_orderkey * 31 - 4000) / 90 + 0.5) AS BIGINT) * 90) % 360 + 360) % 360 AS turn FROM orders""",
)
def _(t):
    d = F.col("o_orderkey") * 31 - 4000
    return t.orders.select("o_orderkey", G.normalize_rotation(d).cast("bigint").alias("turn"))


_BOX = "l_discount AS x, l_tax AS y, l_quantity / 100 AS w, l_linenumber / 100 AS h"


def _boxed(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.struct(
            F.col("l_discount").alias("x"), F.col("l_tax").alias("y"),
            (F.col("l_quantity") / 100).alias("width"), (F.col("l_linenumber") / 100).alias("height"),
        ).alias("box"),
    )


@register(
    "rotate_box",
    f"""WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, {_BOX}, (l_linenumber % 4) * 90 AS d FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, round(CASE d WHEN 90 THEN 1 - (y + h) WHEN 180 THEN 1 - (x + w) WHEN 270 THEN y ELSE x END, 6) AS x,
      round(CASE d WHEN 90 THEN x WHEN 180 THEN 1 - (y + h) WHEN 270 THEN 1 - (x + w) ELSE y END, 6) AS y,
      round(CASE WHEN d IN (90, 270) THEN h ELSE w END, 6) AS w, round(CASE d WHEN 90 THEN 1 - y WHEN 180 THEN 1 - x WHEN 270 THEN y ELSE x END, 6) AS px FROM a""",
)
def _(t):
    d = (F.col("l_linenumber") % 4) * 90
    pts = F.array(F.struct(F.col("box.x").alias("x"), F.col("box.y").alias("y")))
    return _boxed(t).select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint"),
        G.rotate_box(F.col("box"), d).alias("b"), G.rotate_points(pts, d)[0].alias("p"),
    ).select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.round("b.x", 6).alias("x"), F.round("b.y", 6).alias("y"),
        F.round("b.width", 6).alias("w"), F.round("p.x", 6).alias("px"),
    )


@register(
    "bitmap_to_user",
    """WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity / 2 AS vx, l_linenumber / 2.0 AS vy, (l_linenumber % 4) * 90 AS d FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber,
      round(CASE d WHEN 90 THEN 10 + vy WHEN 180 THEN 610 - vx WHEN 270 THEN 610 - vy ELSE 10 + vx END, 6)::DOUBLE AS x,
      round(CASE d WHEN 90 THEN 20 + vx WHEN 180 THEN 20 + vy WHEN 270 THEN 820 - vx ELSE 820 - vy END, 6)::DOUBLE AS y FROM a""",
)
def _(t):
    box = F.struct(
        F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"),
        F.lit(600.0).alias("width"), F.lit(800.0).alias("height"),
    )
    p = G.bitmap_to_user(
        F.col("l_quantity"), F.col("l_linenumber"), F.lit(2.0), (F.col("l_linenumber") % 4) * 90, box
    )
    return t.lineitem.select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint"), p.alias("p")
    ).select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"),
    )


@register(
    "iou",
    f"""WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, {_BOX} FROM lineitem),
    b AS (SELECT *, greatest(least(x + w, 0.35) - greatest(x, 0.05), 0) * greatest(least(y + h, 0.07) - greatest(y, 0.02), 0) AS i FROM a)
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, round(i / (w * h + 0.3 * 0.05 - i), 6) AS iou,
      i / least(w * h, 0.3 * 0.05) > 0.5 AS most FROM b""",
)
def _(t):
    other = F.struct(
        F.lit(0.05).alias("x"), F.lit(0.02).alias("y"),
        F.lit(0.3).alias("width"), F.lit(0.05).alias("height"),
    )
    return _boxed(t).select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint"),
        F.round(G.iou(F.col("box"), other), 6).alias("iou"),
        G.overlaps_region(F.col("box"), other).alias("most"),
    )


@register(
    "polygon_tests",
    """SELECT vec_id, round(list_max(xs) - list_min(xs), 6) AS w,
      (px > 0 AND py > 0 AND px / 2 + py / 1.0 < 1) AS inside FROM
      (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS xs,
        abs(CAST(embedding[1] AS DOUBLE)) * 5 AS px, abs(CAST(embedding[2] AS DOUBLE)) * 5 AS py FROM embeddings)""",
)
def _(t):
    pts = F.transform(
        "embedding",
        lambda v: F.struct(v.cast("double").alias("x"), v.cast("double").alias("y")),
    )
    tri = F.array(
        *[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (0.0, 1.0))]
    )
    px = F.abs(F.col("embedding")[0].cast("double")) * 5
    py = F.abs(F.col("embedding")[1].cast("double")) * 5
    return t.embeddings.select(
        "vec_id",
        F.round(G.polygon_bounds(pts)["width"], 6).alias("w"),
        G.point_in_polygon(tri, px, py).alias("inside"),
    )


@register(
    "effective_dpi",
    """WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity * 40 AS w, l_linenumber * 300.0 AS h,
      CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity * 10 END AS pw, l_linenumber * 90.0 AS ph FROM lineitem),
    b AS (SELECT *, greatest(1, floor(pw / 72 * 150 + 0.5)) AS tw, greatest(1, floor(ph / 72 * 150 + 0.5)) AS th FROM a)
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber,
      round(CASE WHEN pw IS NULL THEN greatest(w / 612 * 72, h / 792 * 72) ELSE least(w / pw * 72, h / ph * 72) END, 6) AS dpi,
      CAST(CASE WHEN pw IS NULL THEN least(w, 1275) * least(h, 1650) WHEN least(w / tw, h / th) >= 1.15 THEN least(w, tw) * least(h, th) ELSE w * h END AS BIGINT) AS pixels FROM b""",
)
def _(t):
    w, h = F.col("l_quantity") * 40, F.col("l_linenumber") * 300.0
    pw = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") * 10)
    ph = F.col("l_linenumber") * 90.0
    pg = (F.lit(612.0), F.lit(792.0))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint"),
        F.round(G.effective_dpi(w, h, pw, ph, *pg), 6).alias("dpi"),
        G.target_pixels(w, h, pw, ph, *pg, F.lit(150)).alias("pixels"),
    )


@register(
    "projected_bytes",
    """WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice AS px, least(0.95, greatest(0.1, l_discount * 12)) AS q FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, round(greatest(1, 16.167 - 42.6025 * q + 43.6 * q * q) * pow(px, 0.6), 4) AS bytes FROM a""",
)
def _(t):
    b = G.projected_bytes(F.col("l_extendedprice"), F.col("l_discount") * 12)
    return t.lineitem.select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint"), F.round(b, 4).alias("bytes")
    )


@register(
    "fit_within",
    """WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_quantity * 70 AS BIGINT) AS w, l_linenumber * 500 AS h FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber,
      CAST(CASE WHEN greatest(w, h) <= 1000 THEN w ELSE greatest(1, floor(w * (1000 / greatest(w, h)) + 0.5)) END AS BIGINT) AS fw,
      CAST(CASE WHEN greatest(w, h) <= 1000 THEN h ELSE greatest(1, floor(h * (1000 / greatest(w, h)) + 0.5)) END AS BIGINT) AS fh,
      CAST(greatest(1, floor(h * 640 / w + 0.5)) AS BIGINT) AS eh FROM a""",
)
def _(t):
    w, h = (F.col("l_quantity") * 70).cast("bigint"), F.col("l_linenumber") * 500
    fit = G.fit_within(w, h, F.lit(1000))
    exact = G.exact_output_size(w, h, F.lit(640), F.lit(None).cast("int"))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint"),
        fit["width"].alias("fw"), fit["height"].alias("fh"), exact["height"].alias("eh"),
    )


@register(
    "image_key",
    "SELECT doc_id, strlen(text) || ':' || sha256(text) AS key FROM documents",
)
def _(t):
    return t.documents.select("doc_id", N.image_key(F.col("text").cast("binary")).alias("key"))


@register(
    "cell_text",
    """SELECT event_id, CASE event_type WHEN 'error' THEN CASE user_id % 3 WHEN 0 THEN '#DIV/0!' WHEN 1 THEN '#ERROR!' ELSE '#CUSTOM' END
      WHEN 'click' THEN 'TRUE' WHEN 'view' THEN strftime(ts, '%Y-%m-%d') WHEN 'signup' THEN '' ELSE 'shown ' || user_id END AS cell FROM events""",
)
def _(t):
    ty, u = F.col("event_type"), F.col("user_id")
    kind = F.when(ty == "error", "e").when(ty == "click", "b").when(ty == "view", "d").when(
        ty == "signup", "z"
    ).otherwise("s")
    shown = F.when(ty == "purchase", F.concat(F.lit("shown "), u.cast("string")))
    raw = F.when((ty == "error") & (u % 3 == 2), F.lit("#CUSTOM")).when(ty == "click", F.lit("true")).when(
        ty == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    )
    code = F.when((ty == "error") & (u % 3 == 0), F.lit(7)).when((ty == "error") & (u % 3 == 1), F.lit(99))
    return t.events.select("event_id", N.cell_text(kind, shown, raw, code, F.lit(False)).alias("cell"))


@register(
    "column_width",
    """SELECT p_partkey, least(200, greatest(32, 0.75 * CASE WHEN p_size % 3 = 0 THEN p_size * 4.0 WHEN p_size % 3 = 1 THEN p_size * 7 + 5 ELSE least(p_size + 1, 40) * 7 + 5 END))::DOUBLE AS pt FROM part""",
)
def _(t):
    s = F.col("p_size")
    px, wch = F.when(s % 3 == 0, s * 4.0), F.when(s % 3 == 1, s)
    # a zero width counts as not given
    return t.part.select("p_partkey", N.column_width(px, wch, s).alias("pt"))


@register(
    "parse_size",
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN CASE WHEN p_size = 0 THEN NULL ELSE greatest(10000, p_size * 1000) END
      WHEN 1 THEN least(50000000, p_size * 1500000) WHEN 2 THEN least(50000000, p_size * 1048576 // 10 * 10) WHEN 3 THEN NULL ELSE greatest(10000, p_size * 1000 + 500) END::BIGINT AS bytes FROM part""",
)
def _(t):
    s, n = F.col("p_size"), F.col("p_size").cast("string")
    raw = (
        F.when(s % 5 == 0, n)
        .when(s % 5 == 1, F.concat((s * 1.5).cast("string"), F.lit(" MB")))
        .when(s % 5 == 2, F.concat(n, F.lit("MiB")))
        .when(s % 5 == 3, F.concat(n, F.lit(" pages")))
        .otherwise(F.concat(n, F.lit(",5kb")))
    )
    return t.part.select("p_partkey", N.parse_size(raw, 10_000, 50_000_000).alias("bytes"))


@register(
    "size_warning",
    """SELECT o_orderkey, CASE WHEN b > 100000000 THEN 'large file: ' || CAST(floor(b / 1000000 + 0.5) AS BIGINT) || ' MB' END AS warning
      FROM (SELECT o_orderkey, CAST(o_totalprice * 1000 AS BIGINT) AS b FROM orders)""",
)
def _(t):
    b = (F.col("o_totalprice") * 1000).cast("bigint")
    return t.orders.select("o_orderkey", b.alias("b")).select(
        "o_orderkey", N.size_warning(F.col("b")).alias("warning")
    )
