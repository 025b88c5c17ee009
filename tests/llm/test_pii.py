import hashlib
import random
import re

from corpuskit.llm import pii as P
from tests.llm.conftest import docs_of, odd_docs

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    return sorted(
        (m.start(), i, m.end(), k)
        for i, (k, p) in enumerate(SHAPES.items()) for m in re.finditer(p, text or "") if valid(k, m[0])
    )


PARTS = [
    "a@b.c", "x.y", "@", ".", "-", "+", "%", "1", "22", "255", "256", "0", "4111 1111 1111 1111", "1.2.3.4", "+1 (555) 123-4567",
    " ", "é", "\U0001f600", "\n", "(", ")", "0000", "word", "5-", "00000000000000", "\t",
]


def test_base_spans_are_the_plain_ones(spark, edge_rows):
    rng = random.Random(10)
    rows = [*edge_rows, (10, "9" * 30000), (11, "a.b@" * 300 + "c.d"), (12, "1." * 5000), (13, "x@y.z," * 700)]
    rows += [(100 + i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    got = P.personal_data(odd_docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        spans = plain(t)
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        want.append((i, *[sum(s[3] == k for s in spans) for k in SHAPES], sha))
    assert sorted((tuple(r[:6]) for r in got), key=str) == sorted(want, key=str)
    assert P.personal_data(docs_of(spark, [])).count() == 0


def telling(spark):
    rows = [(i, f"note {i} kept by Zorbatrix under 10.1.2.3 since day {i}") for i in range(5)]
    rows += [(100 + i, f"note {i} on the weather of day {i}, kept by hand") for i in range(200)]
    # one text in many copies is one context, so its words tell nothing
    rows += [(500 + i, "copy by Quintilda of me@here.org for all") for i in range(20)]
    return docs_of(spark, rows)


def test_terms_that_reveal_a_value_are_found(spark):
    got = {r.doc_id: r for r in P.personal_data(telling(spark)).collect()}
    for i in range(5):
        text = f"note {i} kept by Zorbatrix under 10.1.2.3 since day {i}"
        found = [s.split(":") for s in got[i].spans.split(",")]
        words = {text[int(a):int(b)] for k, a, b in found if k.endswith("term")}
        assert "Zorbatrix" in words and "note" not in words and "by" not in words
        assert f"ip:{text.index('10.')}:{text.index('10.') + 8}" in got[i].spans
    assert all(got[100 + i].spans == "" for i in range(200))
    assert all(got[500 + i].spans == "email:21:32" or "term" not in got[500 + i].spans for i in range(20))


def test_disclosure_is_the_plain_ratio(spark):
    import math

    docs = telling(spark)
    slim = docs.select("doc_id", P.text_key("text").alias("key"), "text")
    found = P.with_base_spans(slim).drop("text")
    got = P.disclosing_terms(slim, found, P.context_terms(found), 0.0, 2.0, 3).collect()
    texts = [r.text for r in docs.collect()]
    words = [w.lower() for t in texts for w in re.findall(r"[^\W\d_]+", t)]
    for r in got:
        both = 5 if r.term in ("zorbatrix", "kept", "by", "under", "since", "day", "note") else None
        if both:
            total, value = len(words), 5
            want = math.log(both * total / (value * words.count(r.term))) / math.log(total / value)
            assert abs(r.disclosure - want) < 1e-9
    assert {"zorbatrix", "under"} <= {r.term for r in got}


def test_sanitised_texts(spark):
    df = telling(spark).withColumn("kind", P.F.lit(1))
    got = P.sanitised(df)
    assert got.columns == df.columns
    by = {r.doc_id: r.text for r in got.collect()}
    assert "10.1.2.3" not in by[0] and "[IP]" in by[0] and "Zorbatrix" not in by[0] and by[0].startswith("note 0 kept by")
    assert by[500] == "copy by Quintilda of [EMAIL] for all"
    rows = [(1, None), (2, ""), (3, "a@b.c and +1 555 123 4567 8"), (3, "a@b.c and +1 555 123 4567 8")]
    by = [(r.doc_id, r.text) for r in P.sanitised(docs_of(spark, rows)).collect()]
    assert sorted(by, key=str) == sorted([(1, None), (2, ""), (3, "[EMAIL] and [PHONE]"), (3, "[EMAIL] and [PHONE]")], key=str)
