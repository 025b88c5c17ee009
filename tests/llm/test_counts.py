import random

from corpuskit.llm import counts as C
from tests.llm.conftest import docs_of, odd_docs

PARTS = ["a", "b", "th", "'", "'s", "re", "r", " ", "  ", "\n", "\t", "1", "23", "é", "日", "!", "..", "　", "'l", "v"]


def test_counts_follow_edits_exactly():
    rng = random.Random(8)
    count = C.counter()
    for _ in range(800):
        tree = C.CountTree("".join(rng.choice(PARTS) for _ in range(rng.randint(0, rng.choice([5, 40, 1500])))), count)
        for _ in range(rng.randint(1, 6)):
            n = len(tree.text)
            a = rng.randint(0, n)
            b = rng.randint(a, min(n, a + rng.choice([0, 1, 3, 200])))
            new = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, rng.choice([0, 2, 30, 600]))))
            want = tree.text[:a] + new + tree.text[b:]
            assert tree.edit(a, b, new) == len(count.encode(want))
            assert tree.text == want
            assert [x for s in tree.sizes for x in s] == [len(p) for p in count.words.findall(want)]


def test_only_the_touched_region_is_encoded():
    count = C.counter()
    tree = C.CountTree("some words of a long text " * 4000, count)
    seen = count.encoded
    tree.edit(50000, 50003, "new")
    assert count.encoded - seen < 60


def test_frame_and_edges(spark, edge_rows):
    got = C.edited_counts(odd_docs(spark, [*edge_rows, (7, "call 123456 or 99 or 4444\nx 55555")])).collect()
    assert len(got) == len(edge_rows) + 1
    encode = C.counter().encode
    last = next(r for r in got if r.doc_id == 7)
    assert last.n_edits == 4 and last.n_tokens_after == len(encode("call 0 or 99 or 0 [checked]\nx 0"))
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == 0 and by[1].n_tokens_after == len(encode(" [checked]"))
    assert C.edited_counts(docs_of(spark, [])).count() == 0


def test_edits_out_of_range_are_clipped(spark):
    rows = [(1, "abc", [(-5, 1, None), (90, 99, "z"), (2, 1, "y")]), (2, None, None), (3, "ab", [(None, None, "q")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,stop:long,new:string>>")
    got = {r.doc_id: r for r in C.recount(df).collect()}
    encode = C.counter().encode
    assert got[1].n_tokens_after == len(encode("bcyz")) or got[1].n_chars_after == 4
    assert got[2].n_tokens_after == 0 and got[3].n_chars_after == 3
