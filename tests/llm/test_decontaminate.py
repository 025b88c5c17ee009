import hashlib
import random
import re

from corpuskit.llm import decontaminate as D
from tests.llm.conftest import docs_of, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain(text, items, size=10):
    words = WORD.findall(lower(text))
    hit, ids = set(), set()
    for item, body in items:
        own = WORD.findall(lower(body))
        k = min(size, len(own))
        wins = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1 if wins else 0):
            if tuple(words[i:i + k]) in wins:
                hit.update(range(i, i + k))
                ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def items_of(rng, n=12):
    out = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 25)))) for i in range(n)]
    return [*out, (n, None), (n + 1, "!!"), (n + 2, "a a a a a a a a a a a a a"), (n + 3, "Solo"), (n + 3, "solo"),
            (n + 4, "été b-C d")]


def texts_of(rng, items):
    out = [None, "", "...", "solo", "a " * 40, "b Été b c d", "b été-B/c d"]
    for _ in range(60):
        parts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 3)):
            body = (rng.choice(items)[1] or "").split()
            lo = rng.randint(0, len(body))
            parts += [" ".join(body[lo:lo + rng.randint(0, 20)]).upper(), rng.choice(["x", "a b", "\n"])]
        out.append(rng.choice([" ", ", "]).join(parts))
    return out


def test_windows_hit_as_in_brute_force(spark):
    rng = random.Random(4)
    items = items_of(rng)
    texts = texts_of(rng, items)
    df = odd_docs(spark, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: plain(t, items) for i, t in enumerate(texts)}
    for block_chars in (50_000_000, 60):
        got = D.with_matches(df, bench, block_chars=block_chars).collect()
        assert {
            r.doc_id: (r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0)
            for r in got
        } == want
    got = D.contamination(df, bench).collect()
    assert {r[0]: tuple(r[1:6]) for r in got} == want
    kept = D.clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}


def test_matches_are_as_long_as_they_can_be():
    tests = D.TestSet([("i", "a b c d e f g h i j k l m n")], 10)
    got = sorted(D.search_shard([D.words_of("z b c d e f g h i j k l m q"), D.words_of("a b c d e f g h i j")], tests))
    assert got == [(0, 1, 0, 1, 12), (1, 0, 0, 0, 10)]


def test_shards_split_between_documents(spark):
    docs = [["w"] * n for n in (3, 0, 5, 1, 9)]
    got = list(D.shards(docs, 6))
    assert [d for _, some in got for d in some] == docs
    assert [first for first, _ in got] == [0, 2, 4]


def test_edges(spark, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination(odd_docs(spark, edge_rows), none).collect()
    assert len(got) == len(edge_rows) and not any(r.contaminated for r in got)
    odd = spark.createDataFrame([(None, "one two three four five"), (1, None)], "item_id long, text string")
    got = D.contamination(docs_of(spark, edge_rows), odd).collect()
    assert [r.n_items for r in got if r.contaminated] == [1]
    assert D.contamination(docs_of(spark, []), odd).count() == 0
