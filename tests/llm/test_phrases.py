"""Collocations against plain counting."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpuskit.llm import phrases as P
from tests.llm.conftest import DOCS, docs_of, odd_docs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top, share=100):
    """Rows (text, lang) to the contract's rows."""
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            ws = re.findall(r"[^ \t]+", piece)
            total[lang] += len(ws)
            for n in range(1, 6):
                count.update((lang, tuple(ws[i:i + n])) for i in range(len(ws) - n + 1))
    cand = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    more = Counter()
    for (lang, ws), a in cand.items():
        for n in range(2, len(ws)):
            for i in range(len(ws) - n + 1):
                more[lang, ws[i:i + n]] = max(more[lang, ws[i:i + n]], a)
    out = []
    for (lang, ws), a in cand.items():
        if 100 * more[lang, ws] >= share * a:
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = count[lang, ws[:k]], count[lang, ws[k:]]
            cuts.append((Fraction(1000 * a * total[lang], left * right).__floor__(), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(ws), a, left, right, total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        some = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(some[:top])]
    return sorted(ranked)


def some_rows(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["Été", "naïve", "x" * 300, "A\x00b"]
    fixed = [[rng.choice(vocab) for _ in range(rng.randint(2, 7))] for _ in range(12)]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 12)):
            words += rng.choice(fixed) if rng.random() < 0.7 else [rng.choice(vocab)]
            if rng.random() < 0.3:
                words.append(rng.choice([".", ",", " ; ", "\n", "\t", "?!"]))
        rows.append((rng.choice([" ", " ", "  \t"]).join(words), rng.choice(["en", "en", None, "und", "de"])))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0) for i, (t, g) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("bits", [64, 9])
def test_whole_result_with_and_without_collisions(spark, bits):
    rows = some_rows(1)
    got = P.collocations(table(spark, rows).repartition(5), least=6, top=40, bits=bits)
    want = plain(rows, 6, 40)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 60


def test_chunks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 50)
    long = " ".join(f"w{i * i % 53}" for i in range(30000))
    rows = [(long, "en"), ("a b c d e f " * 5000, "de"), ("q" * 30000 + " r " * 9000, "de"), ("t. " * 9000, None)]
    got = P.collocations(table(spark, rows), least=100, share=60)
    assert sorted(map(tuple, got.collect())) == plain(rows, 100, 2000, 60)


def test_words_on_chunk_borders_count_once(monkeypatch):
    rng = random.Random(4)
    for size in (1, 7, 30):
        monkeypatch.setattr(P, "CHUNK", size)
        text = "".join(rng.choice("ab é.,  \t\n") for _ in range(400)).encode()
        parts = list(P.cut_text(text))
        words = P.Words([p for p, _ in parts], [n for _, n in parts])
        whole = P.Words([text], [len(text)])
        for n in range(1, 6):
            def grams(w):
                at = w.grams(n)
                at = at[w.own[at]]
                return Counter(tuple(w.data[w.starts[j]:w.ends[j]] for j in range(i, i + n)) for i in at)
            assert grams(words) == grams(whole)


def test_edges_repeats_and_clashing_columns(spark, edge_rows):
    df = odd_docs(spark, edge_rows * 3).withColumns({c: F.lit("x") for c in "chunk own fp a l r n phrase words place".split()})
    got = P.collocations(df, least=2)
    assert sorted(map(tuple, got.collect())) == plain([(t, "en") for _, t in edge_rows * 3], 2, 2000)
    assert P.collocations(docs_of(spark, [])).collect() == []
    assert P.collocations(docs_of(spark, [(1, "a b"), (2, None)])).collect() == []
