import hashlib
import random

import duckdb
import pytest
from tokenizers import Tokenizer

from corpuskit.llm import bpe as B
from tests.llm.conftest import docs_of, odd_docs

PARTS = [
    "a", "b", "th", "in", "e", "'", "'s", "'re", " ", "  ", "\n", "\t", "1", "23", "é", "É", "é", "Σ",
    "ΑΣ", "İ", "ß", "日本", "ﬁ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "!",
    "!!!", "...", "\x1c", "\x85", "\xa0", "​", "\U0001f600", "١", "lo", "ing", "aaaa", "the", "_", "\x00",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(B.default_path())


@pytest.fixture(scope="module")
def own():
    return B.WordBpe(B.default_path())


def test_ids_and_decoded_text_equal_the_library(own, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(rng.choice("abethinosr") for _ in range(200)) for _ in range(100)]
    rows = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    texts += [r[0] for r in rows]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(t) == e.ids, t
        assert own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_a_long_word_takes_linear_time(own, library):
    text = "ab" * 30000 + "!" * 20000
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_digests_and_edges(spark, edge_rows, library):
    rows = [*edge_rows, (8, "<|endoftext|> Hello  World's")]
    got = B.token_digests(odd_docs(spark, rows)).collect()

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert B.token_digests(docs_of(spark, [])).count() == 0


def test_encode_and_decode_frames(spark, own):
    df = B.decoded(B.encoded(docs_of(spark, [(1, "Hello there"), (2, None)])))
    got = {r.doc_id: (r.token_ids, r.decoded) for r in df.collect()}
    assert got == {1: (own.encode("Hello there"), "hello</w> there</w>"), 2: ([], "")}
