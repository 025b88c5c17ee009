"""The manifest against a plain tree in Python."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from corpuskit.llm import merkle as M
from tests.llm.conftest import docs_of, odd_docs

LOW = str.maketrans(M.UPPER, M.UPPER.lower())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """(root, siblings): siblings[i] is a list of (left, right) texts for node i."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        for i, p in enumerate(at):
            run = runs[p // 8]
            paths[i].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
            at[i] = p // 8
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the contract's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        sub, paths = trees[g]
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            path = path + top
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = plain_leaf([*r[:4], None if r[4] is None else r[4].translate(LOW)])
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], leaf, sub, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def same(df, rows):
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_groups_of_many_sizes(spark):
    rng = random.Random(3)
    sizes = {None: 9, "": 1, "a": 8, "é": 65, "b": 64, "c": 512, "Z": 513, "zz": 700, "big": 5000}
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            i = len(rows)
            rows.append((i, rng.choice([None, "s1", "ü:"]), lang, rng.choice([None, 7]), rng.choice(["Text", "text", None, ""]) ))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    same(M.documents_manifest(df), rows)


def test_three_rounds_in_small_blocks(spark, monkeypatch):
    """Blocks of one level need as many rounds as the tree has levels."""
    monkeypatch.setattr(M, "STEPS", 1)
    monkeypatch.setattr(M, "BLOCK", 8)
    rows = [(i, "s", "en" if i % 5 else "de", i, f"Word {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    same(M.documents_manifest(df), rows)


def test_edges_repeats_and_clashing_columns(spark, edge_rows):
    df = odd_docs(spark, edge_rows).withColumns({c: F.lit("x") for c in "grp pos total h block nodes row part id".split()})
    full = [(i, "s", "en", None if t is None else len(t), t) for i, t in edge_rows]
    same(M.documents_manifest(df), full)
    assert M.documents_manifest(docs_of(spark, [])).collect() == []


def test_a_tampered_text_is_found(spark):
    rows = [(i, f"Upper {i}") for i in range(60)]
    got = {r.doc_id: r.verified for r in M.documents_manifest(docs_of(spark, rows)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 != 0 for i in got} and not all(got.values())
