import random

import numpy as np

from corpuskit.llm import packing as P
from tests.llm.conftest import docs_of, odd_docs


def plain_best_fit(sizes, length):
    rooms = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [r for r in rooms if r >= sizes[i]]
        room = min(fit) if fit else length
        if fit:
            rooms.remove(room)
        rooms.append(room - sizes[i])
    return sorted(rooms)


def test_best_fit_is_the_plain_one():
    rng = random.Random(7)
    for length in (1, 2, 7, 64, 100):
        for n in (0, 1, 300):
            sizes = [rng.randint(1, length) for _ in range(n)]
            rows = P.best_fit(sizes, length)
            assert sorted(i for r in rows for i in r) == list(range(n))
            assert sorted(length - sum(sizes[i] for i in r) for r in rows) == plain_best_fit(sizes, length)


def test_round_trip_and_resets(spark, edge_rows):
    length = 64
    packed = P.pack(odd_docs(spark, edge_rows), length=length, shard_tokens=5000).collect()
    encode = P.encoding(None).encode_ordinary
    found = []
    for r in packed:
        ids = np.frombuffer(r["ids"], "<u2")
        positions = np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == length
        assert list(r.cu_seqlens) == list(np.cumsum([0] + [p["size"] for p in r.parts]))
        assert r.n_tokens == r.cu_seqlens[-1] and (ids[r.n_tokens:] == 50256).all()
        for a, b, p in zip(r.cu_seqlens, r.cu_seqlens[1:], r.parts, strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            found.append((p["doc_id"], p["n_tokens"], p["start"], ids[a:b].tolist()))
    want = []
    for i, t in edge_rows:
        ids = [*encode(t or ""), 50256]
        want += [(i, len(ids), a, ids[a:a + length]) for a in range(0, len(ids), length)]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_unpack_gives_the_pieces(spark, tmp_path):
    packed = P.pack(docs_of(spark, [(1, "Hello there " * 50), (2, "x"), (None, None)]), length=32)
    P.write_matrices(packed, str(tmp_path / "out"))
    pieces = P.unpack(spark.read.parquet(str(tmp_path / "out"))).collect()
    whole = {}
    for r in sorted(pieces, key=lambda r: r.start):
        whole.setdefault(r.doc_id, []).extend(r["ids"])
    encode = P.encoding(None).encode_ordinary
    assert whole == {1: [*encode("Hello there " * 50), 50256], 2: [*encode("x"), 50256], None: [50256]}
    assert P.pack(docs_of(spark, [])).count() == 0
