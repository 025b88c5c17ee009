import random

from corpuskit.llm import lines as N
from tests.llm.conftest import docs_of, odd_docs


def plain(rows, words):
    """Deletes, place by place, every line of a window, onward or back, whose text an earlier place has."""
    import hashlib

    def key(t):
        return hashlib.md5(t.encode()).digest()

    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, key(r[1])))
    first, gone = {}, {}
    for doc in order:
        lines = doc[1].split("\n")
        full = [k for k, x in enumerate(lines) if x.split()]
        gone[doc] = set()
        spans = set()
        for a in range(len(full)):
            for step in (1, -1):
                n, b = 0, a
                while 0 <= b < len(full) and n < words:
                    n += len(lines[full[b]].split())
                    b += step
                if n >= words:
                    spans.add((a, b) if step > 0 else (b + 1, a + 1))
        for a, b in sorted(spans):
            text = tuple(lines[full[k]].strip(" \t\r") for k in range(a, b))
            place = (doc, full[a], full[b - 1])
            origin = first.setdefault(text, place)
            if origin is not place and (origin[0] != doc or full[a] > origin[2]):
                gone[doc].update(range(full[a], full[b - 1] + 1))
    return {doc: ("\n".join(x for k, x in enumerate(doc[1].split("\n")) if k not in g), len(g)) for doc, g in gone.items()}


def corpus(rng, n=40):
    pool = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 6))) for _ in range(14)]
    passages = ["\n".join(rng.choice(pool) for _ in range(rng.randint(2, 9))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice([rng.choice(passages), f"own {i} {rng.random()} text", "", rng.choice(pool)]) for _ in range(6)]
        rows.append((rng.choice([i, i, None]), "\n".join(parts)))
    return rows


def test_runs_go_as_in_brute_force(spark):
    rng = random.Random(9)
    for words in (4, 12):
        rows = corpus(rng) + [(99, "x y\n" * 30), (98, "x y\n" * 30), (97, "")]
        rows += rows[:3]
        got = N.dedup_lines(odd_docs(spark, rows), words=words).select("doc_id", "text", "n_removed").collect()
        want = plain(rows, words)
        assert sorted(map(tuple, got), key=str) == sorted(((r[0], *want[r]) for r in rows), key=str)


def test_a_passage_of_over_fifty_words_stays_once(spark):
    long = " ".join(f"w{i}" for i in range(60))
    three = "\n".join(" ".join(f"v{k}{i}" for i in range(20)) for k in range(3))
    rows = [(i, f"own line {i}\n{long}\nmore of {i}\n{three}\nend {i}") for i in range(30)]
    got = {r.doc_id: r.text for r in N.without_repeats(docs_of(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"own line {i}\nmore of {i}\nend {i}" for i in range(1, 30))


def test_a_match_extends_both_ways(spark):
    """Lines too short for a window of their own go with the repeated run they are in."""
    def line(n, name):
        return " ".join(f"{name}{i}" for i in range(n))

    run = [line(n, f"r{k}x") for k, n in enumerate((15, 30, 60, 30, 15))]
    rows = [(i, "\n".join([f"own {i}", *run, f"end {i}"])) for i in range(5)]
    rows.append((5, "\n".join(["other", *run[2:], "end"])))
    got = {r.doc_id: r.text for r in N.without_repeats(docs_of(spark, rows)).collect()}
    assert got == {0: rows[0][1], **{i: f"own {i}\nend {i}" for i in range(1, 5)}, 5: "other\nend"}


def test_short_shared_lines_and_clean_documents_stay(spark):
    rows = [(i, f"All rights reserved.\nthe {i} text of {i * 7} here\nAll rights reserved.") for i in range(20)]
    got = {r.doc_id: r.text for r in N.without_repeats(docs_of(spark, rows)).collect()}
    assert got == dict(rows)


def test_edges(spark, edge_rows):
    df = odd_docs(spark, edge_rows)
    got = N.dedup_lines(df)
    assert got.columns == [c for c in df.columns if c != "n_removed"] + ["n_removed"]
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for i, t in edge_rows)
    assert N.without_repeats(df).columns == df.columns
    assert N.without_repeats(docs_of(spark, [])).count() == 0
    twice = docs_of(spark, [(1, "a b " * 40), (2, "a b " * 40)])
    assert {(r.doc_id, r.text, r.n_chars) for r in N.without_repeats(twice).collect()} == {(1, "a b " * 40, 160), (2, "", 0)}
