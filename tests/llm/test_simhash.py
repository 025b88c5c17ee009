import random

import numpy as np
import xxhash

from corpuskit.llm import simhash as S
from tests.llm.conftest import docs_of, odd_docs


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance=2):
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                parent[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(ids))]


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "One tWo", "A b C", "a b c d " * 50]
    texts += [" ".join(rng.choice("aBcdé fg") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for t in texts:
        assert S.fingerprint(t) % (1 << 64) == plain_fingerprint(t), t


def test_blocks_of_a_long_text_join(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    want = S.fingerprint(text)
    blocks = S.word_blocks
    monkeypatch.setattr(S, "word_blocks", lambda raw: blocks(raw, 5))
    assert S.fingerprint(text) == want


def test_links_reach_what_brute_force_reaches(spark):
    rng = random.Random(2)
    prints = []
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.append(p)
            for _ in range(rng.randint(0, 3)):
                p ^= 1 << rng.randrange(64)
    prints += [0, 1, 3, 7, 15, (1 << 63), (1 << 63) | 1]
    ids = list(range(len(prints)))
    rng.shuffle(ids)
    rows = [(i, S._signed(p)) for i, p in zip(ids, prints, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in S.with_components(df).collect()}
    assert got == dict(zip(ids, plain_components(ids, prints), strict=True))


def test_links_of_a_dense_group_stay_linear(spark):
    prints = [sum(1 << b for b in range(10) if i >> b & 1) for i in range(1024)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    n = S.near_links(df).count()
    assert n <= 65 * len(prints)
    ends = S.components(S.near_links(df), "fp", "hub")
    assert {r.v for r in ends.collect()} == {0} and ends.count() == 1023


def test_edges_nulls_repeats_and_clashing_columns(spark, edge_rows):
    rows = edge_rows + [(9, "one two three four five"), (7, "one two three four five")]
    got = S.near_duplicates(odd_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted(
        zip([r[0] for r in rows], [f"{p:016x}" for p in prints], plain_components([r[0] for r in rows], prints),
            strict=True), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert S.near_duplicates(docs_of(spark, [])).collect() == []


def test_keep_one_of_each_group(spark, edge_rows):
    rows = edge_rows + [(9, "one two three four five"), (7, "one two three four five"), (7, "one two three four five")]
    df = odd_docs(spark, rows)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = {}
    for (i, t), c in zip(rows, plain_components(list(range(len(rows))), prints), strict=True):
        groups.setdefault(c, []).append((i is None, i if i is not None else 0, t))
    got = kept.select("doc_id", "text").collect()
    assert len(got) == len(groups)
    # a group's row has the smallest id, or none where no row has one
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(min(g)[:2] for g in (
        [(a, b) for a, b, _ in v] for v in groups.values()))
    assert S.keep_one(docs_of(spark, [])).count() == 0


def test_signed_round_trip():
    for v in (0, 1, 1 << 63, (1 << 64) - 1):
        assert S._signed(v) % (1 << 64) == v and np.int64(S._signed(v)) == S._signed(v)
