"""Stages on their own input against brute force, and the whole run."""

import hashlib

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
from corpuskit.llm import bpe
from tests.llm.conftest import docs_of
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_near_copies import plain_set, plain_similarity
from tests.llm.test_quality import plain as plain_measures

FOLDER = "/root/testdata/sf0.001"


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def plain_first_ones(rows):
    """Ids of the rows without an earlier near copy, by the Jaccard similarity of all pairs."""
    sets = [plain_set(t) for _, t in rows]
    return {
        r[0] for i, r in enumerate(rows)
        if not any(plain_similarity(sets[i], sets[j]) >= 0.8 for j in range(len(rows)) if rows[j][0] < r[0])
    }


def test_every_stage_and_the_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]

    one = stages["quality_rules"](spark, docs, FOLDER)
    assert one.columns == docs.columns
    good = set()
    for r in docs.collect():
        m = plain_measures(r.text)
        if m[0] >= 10 and 100 * m[4] <= 20 * m[0]:
            good.add((r.doc_id, r.text))
    kept = pairs(one)
    assert set(kept) == good  # no host of this table fails on the whole

    two = stages["line_dedup"](spark, one, FOLDER)
    want = plain_lines(kept, 50)
    assert pairs(two) == sorted((r[0], want[r][0]) for r in kept)
    assert two.columns == docs.columns and all(r.n_chars == len(r.text) for r in two.collect())

    three = stages["near_dedup"](spark, two, FOLDER)
    rows = pairs(two)
    stay = plain_first_ones(rows)
    assert pairs(three) == [r for r in rows if r[0] in stay] and len(stay) < len(rows)

    four = stages["decontamination"](spark, three, FOLDER)
    items = duckdb.sql(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    last = [r for r in pairs(three) if not plain_hits(r[1], items)[4]]
    assert pairs(four) == last and len(last) < len(rows)

    library = Tokenizer.from_file(bpe.default_path())
    ids = [library.encode(t, add_special_tokens=False).ids for _, t in last]
    want = [(d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for (d, _), i in zip(last, ids, strict=True)]
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(tuple(r)[:3] for r in got) == want


def test_stages_take_an_empty_table(spark):
    docs = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
