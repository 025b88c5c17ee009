"""Golden rows for functions, patterns, names and predicates."""

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import geometry as G
from corpuskit.functions import names as N
from corpuskit.functions import patterns as P
from corpuskit.functions import text as X
from corpuskit.operators import predicates as PR
from corpuskit.operators.redact import redact_patterns, residual_check, scan_patterns, verify_redaction

SENSITIVE = [
    ("write to jane.doe@example.co.uk today", "email", "jane.doe@example.co.uk"),
    ("NINO AB123456C on file", "uk-nino", "AB123456C"),
    ("passport L898902C36 seen", "passport", "L898902C36"),
    ("IBAN GB29 NWBK 6016 1331 9268 19 ok", "iban", "GB29 NWBK 6016 1331 9268 19"),
    ("ssn 123-45-6789.", "ssn", "123-45-6789"),
    ("card 4111 1111 1111 1111", "credit-card", "4111 1111 1111 1111"),
    ("host 192.168.0.12 up", "ip", "192.168.0.12"),
    ("host fe80::1 up", "ip", "fe80::1"),
    ("call (555) 123-4567 now", "phone", "(555) 123-4567"),
    ("é4111111111111111", "credit-card", "4111111111111111"),
]
HARMLESS = [
    "at 12:00:00 sharp", "order 000-12-3456", "version 1.2.3", "4111 1111 1111 1112", "GB29 NWBK 6016 1331 9268 18",
    "BG123456C", "call 5551234567", "a@b", "256.1.1.1", "1234567890", "",
]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_patterns(spark):
    rows = [(i, 0, t) for i, (t, _, _) in enumerate(SENSITIVE)] + [(100 + i, 0, t) for i, t in enumerate(HARMLESS)]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, text string")
    got = {r.doc_id: (r.category, r.hit, r.start) for r in scan_patterns(df).collect()}
    for i, (text, category, hit) in enumerate(SENSITIVE):
        assert got.pop(i) == (category, hit, text.index(hit))
    assert got == {}


def test_redaction_is_verified_on_output(spark):
    text = "mail a.b@c.org or 192.168.0.12, then a.b@c.org again 😀 end"
    df = spark.createDataFrame([(1, 0, text), (1, 1, "nothing here")], "doc_id int, page_no int, text string")
    out = redact_patterns(df)
    assert [r.text for r in out.orderBy("page_no").collect()] == ["mail  or , then  again 😀 end", "nothing here"]
    marks = scan_patterns(df)
    assert {r["pass"] for r in verify_redaction(out, marks).collect()} == {True}
    leaky = out.withColumn("text", F.concat("text", F.lit(" A.B@C.ORG")))
    assert {(r.hit, r["pass"]) for r in verify_redaction(leaky, marks).collect()} == {("a.b@c.org", False), ("192.168.0.12", True)}


def test_residual_check_against_brute_force(spark):
    texts = [(1, "Alpha beta gamma delta"), (2, "xalphax"), (3, "be"), (4, "gamma-delta epsilon"), (5, "é")]
    needles = [(1, "beta gamma delta"), (2, "alpha"), (3, "b"), (4, "ma-del"), (5, "zz"), (6, "É"), (7, "a b")]
    t = spark.createDataFrame(texts, "doc_id int, text string")
    n = spark.createDataFrame(needles, "nid int, needle string")
    got = {(r.nid, r.doc_id) for r in residual_check(t, n, ["doc_id"], "nid").collect()}
    assert got == {(i, d) for i, s in needles for d, x in texts if s.lower() in x.lower()}


@pytest.mark.parametrize("cell,want", [
    ("=1+1", "'=1+1"), ("+1 555 0100", "+1 555 0100"), ("-12.5%", "-12.5%"), ("-2+3+cmd|x", "'-2+3+cmd|x"),
    ("@SUM(A1)", "'@SUM(A1)"), ("@home", "@home"), ("\tx", "'\tx"), ("plain", "plain"), ("-$ 5", "-$ 5"),
])
def test_neutralize(spark, cell, want):
    assert one(spark, X.neutralize_formula(F.lit(cell))) == want


def test_entities_are_decoded_once(spark):
    text = "&amp;lt; &#65;&#x42; &#38;amp; &nope; &copy; &#xD800; &hellip;"
    assert one(spark, X.decode_entities(F.lit(text))) == "&lt; AB &amp; &nope; &copy; &#xD800; …"


def test_names_and_numbers(spark):
    assert one(spark, N.bates_label("A", 3, 999, F.lit(1))) == "A1000"
    assert one(spark, N.column_ref(F.lit(702))) == "AAA"
    assert one(spark, N.format_bytes(F.lit(999_500))) == "1 MB"
    assert one(spark, N.format_bytes_up(F.lit(1_000_001))) == "1.01 MB"
    assert one(spark, N.sanitize_file_stem(F.lit("..con. x/y\n"), F.lit("f"))) == "con. x-y_"
    assert one(spark, F.octet_length(N.sanitize_file_stem(F.lit("é" * 200), F.lit("f")))) == 160
    assert one(spark, N.parse_field_number(F.lit("$ 1,234.5"))) == 1234.5
    assert one(spark, N.parse_size(F.lit("1,5 mb"), 1, 10**9)) == 1_500_000
    assert one(spark, N.parse_size(F.lit("2MiB"), 1, 10**9)) == 2_097_150
    assert one(spark, P.luhn(F.lit("0000000000000"))) is False
    assert one(spark, P.icao_check_digit(F.lit("L898902C3"))) == 6


def test_geometry(spark):
    p = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])

    def box(x, y, w, h):
        return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"))

    assert one(spark, G.point_in_polygon(p, F.lit(2.0), F.lit(2.0))) is True
    assert one(spark, G.polygon_overlaps_box(p, box(3.0, -1.0, 0.5, 9.0))) is True
    assert one(spark, G.polygon_overlaps_box(p, box(5.0, 5.0, 1.0, 1.0))) is False
    assert one(spark, G.normalize_rotation(F.lit(-45))) == 0


def test_page_ranges(spark):
    pages = spark.range(10).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"))
    for text, want in [("2-3;9–8", {1, 2, 7, 8}), ("", set(range(10))), ("x", set()), ("0-2, 99", {0, 1})]:
        assert {r.pos for r in PR.select_pages(pages, text).collect()} == want
        assert {r.pos for r in pages.filter(PR.in_range_column(F.lit(text), F.col("pos"))).collect()} == want
    assert PR.range_warnings(pages.withColumn("r", F.lit("40")), "r").count() == 1


def test_tokens_and_snippets(spark):
    assert one(spark, X.tokenize(F.lit("The the é1 x_y"))) == ["the", "é1", "x", "y"]
    text = "a" * 100 + " needle " + "b" * 100
    got = one(spark, X.snippet(F.lit(text), F.lit("needle")))
    assert got.startswith("...") and got.endswith("...") and "needle" in got and len(got) == 86


def test_hits_kept_beside_the_cut_text_are_those_of_a_scan(spark):
    from corpuskit.operators.redact import hit_rows

    df = spark.createDataFrame([(1, 0, "mail a@b.example now"), (2, 0, "nothing"), (3, 1, None)], "doc_id long, page_no int, text string")
    both = redact_patterns(df, keep_hits=True)
    assert sorted(hit_rows(both.drop("n_cut")).collect()) == sorted(scan_patterns(df).collect()) != []
    assert sorted(both.drop("hits").collect()) == sorted(redact_patterns(df).collect())
