import random

import duckdb
import numpy as np
import pytest

from corpuskit.llm import language as L
from tests.llm.conftest import docs_of, odd_docs


def plain_profile(text, dim):
    s = [0]
    for ch in text or "":
        k = ord(ch.lower()[0]) if ch.isalpha() else 0
        if k or s[-1]:
            s.append(k)
    if s[-1]:
        s.append(0)
    out = np.zeros(dim)
    for abc in zip(s, s[1:], s[2:], strict=False):
        a, b, c = (L.letter_vectors(np.array([x]), dim)[0].astype(int) for x in abc)
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


@pytest.mark.parametrize("chars,grams", [(1 << 20, 1 << 13), (16, 8), (64, 50)])
def test_profiles_are_plain_sums(monkeypatch, chars, grams):
    monkeypatch.setattr(L, "CHARS", chars)
    monkeypatch.setattr(L, "GRAMS", grams)
    rng = random.Random(6)
    texts = ["", None, " ", "a", "é!b", "Hello world 12"]
    texts += ["".join(rng.choice("abcdé ..1日") for _ in range(rng.randint(0, 200))) for _ in range(25)]
    got = list(L.profiles(texts, 128))
    assert np.array_equal(np.concatenate([p for _, p in got]), np.array([plain_profile(t, 128) for t in texts]))


def test_letters_have_nearly_orthogonal_vectors():
    v = L.letter_vectors(np.arange(97, 123), 1024).astype(float)
    cosine = v @ v.T / 1024
    assert np.abs(cosine - np.eye(26)).max() < 0.2


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    rows = duckdb.sql(f"select doc_id, lang from '{folder}/documents.parquet'").fetchall()
    out = [(got[i].lang_pred, lang) for i, lang in rows if got[i].held_out]
    assert len(out) > 100 and sum(a == b for a, b in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark, edge_rows):
    got = L.identify(odd_docs(spark, edge_rows)).collect()
    assert len(got) == len(edge_rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1] == by[2] == "und" and by[4] == by[6] == "en"
    assert L.identify(docs_of(spark, [])).count() == 0
    unlabelled = docs_of(spark, [(1, "some text")]).withColumn("lang", L.F.lit(None).cast("string"))
    assert [tuple(r[2:]) for r in L.identify(unlabelled).collect()] == [("und", 0.0)]


def test_too_many_languages_are_refused(spark):
    df = spark.createDataFrame([("t", str(i)) for i in range(5)], "text string, lang string")
    with pytest.raises(ValueError):
        L.train(df, max_langs=4)


def test_the_draw_is_over_different_texts(spark):
    """A language of copies is learned from its few texts, and copies of one text do not crowd others out."""
    rows = [(f"der kleine hund {i % 2}", "de") for i in range(3000)] + [(f"the small dog number {i}", "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "text string, lang string")
    names, prototypes = L.train(df, max_per_lang=50)
    assert names == ["de", "en"] and prototypes.shape == (2, L.DIM)
    once, _ = L.train(df.dropDuplicates(), max_per_lang=50), None
    assert (once[1] == prototypes).all()
