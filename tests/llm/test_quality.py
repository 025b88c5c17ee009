import random
import re
from collections import Counter

from corpuskit.llm import quality as Q
from tests.llm.conftest import docs_of, odd_docs


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_measures_are_the_plain_ones():
    rng = random.Random(3)
    texts = [None, "", " ", "a b c d e a b c d e", "x\nx\n\n \nx ", "é#é <>|&%$*\x0b\x0c\r", "    a"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d  ", "#", "é "]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    for t in texts:
        assert Q.measure(t) == plain(t), t


def test_long_texts_are_measured_whole(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(5000))
    blocks = Q.word_blocks
    monkeypatch.setattr(Q, "word_blocks", lambda raw: blocks(raw, 7))
    assert Q.measure(text) == plain(text)


def test_few_documents_cannot_condemn_a_host(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, bad, "rotten") for i in range(60)]
    rows += [(200, good, "rotten"), (300, bad, "tiny"), (301, good, "tiny"), (400, good, None), (401, bad, None)]
    rows += [(500 + i, good, f"h{i}") for i in range(30)]
    got = {r.doc_id: r for r in Q.judge(odd_docs(spark, rows)).collect()}
    assert not got[200].base_failed and not got[200].kept
    assert got[301].kept and not got[300].kept
    assert got[400].kept and not got[401].kept
    assert all(got[i].kept for i in range(40)) and all(got[500 + i].kept for i in range(30))


def test_hosts_that_do_not_differ_get_the_mean(spark):
    rows = [(i, "a b c", f"h{i % 4}") for i in range(40)]
    got = Q.judge(docs_of(spark, rows)).collect()
    assert len(got) == 40 and not any(r.kept for r in got)


def test_edges(spark, edge_rows):
    df = odd_docs(spark, edge_rows)
    got = Q.judge(df).collect()
    assert len(got) == len(edge_rows)
    assert sorted(tuple(r[m] for m in Q.MEASURES) for r in got) == sorted(plain(t) for _, t in edge_rows)
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert Q.judge(docs_of(spark, [])).count() == 0 and Q.keep_good(docs_of(spark, [])).count() == 0
