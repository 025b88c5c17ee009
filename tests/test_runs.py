"""Recipes, formulas, streams equal to their batch forms, and some oracle comparisons."""

import random
import tempfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from corpuskit.plans.formulas import with_formulas
from corpuskit.plans.recipe import RecipeError, parse_recipe
from corpuskit.streaming import edits as E


def test_recipe_problems():
    with pytest.raises(RecipeError) as e:
        parse_recipe({"tools": "x", "settings": {"compress": {"dpi": 0, "quality": True}, "nup": 3}})
    assert e.value.problems == ["tools", "compress.dpi", "compress.quality", "nup"]
    tools, settings = parse_recipe({"tools": ["compress"], "settings": {"compress": {"dpi": 150, "quality": 0.5, "x": 1}}})
    assert tools == ["compress"] and settings == {"compress": {"dpi": 150, "quality": 0.5}}


def test_formulas(spark):
    df = spark.createDataFrame([("100", "7.5", "12.25", "note")], "subtotal string, tax string, shipping string, Note string")
    r = with_formulas(df, {"total": "subtotal + tax + shipping", "twice": "[total] * 2", "bad": "Note + 1", "evil": "__import__('os')", "zero": "1 / (tax - 7.5)"}).first()
    assert (r.total, r.twice, r.bad, r.zero) == ("119.75", "239.5", None, None)
    assert r.bad__error.startswith('Field "Note" is not a number') and r.evil__error and "zero" in r.zero__error


def events(spark, n=300):
    rng = random.Random(7)
    rows = [(rng.randint(0, 4), i, 1_700_000_000 + rng.randint(0, 4000), rng.choice(["do", "do", "undo", "redo"]), float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id int, event_id int, s long, op string, value double")
    return rows, df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_rate_limit(spark):
    rows, df = events(spark)
    got = {r.event_id for r in E.rate_limit(df, "doc_id", 60).collect()}
    last, want = {}, set()
    for d, i, s, _, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if d not in last or s - last[d] >= 60:
            last[d] = s
            want.add(i)
    assert got == want


def test_replay_and_its_stream(spark):
    rows, df = events(spark)
    want = {}
    for d, _, _, op, v in sorted(rows, key=lambda r: (r[2], r[1])):
        done, undone = want.setdefault(d, (deque(maxlen=50), []))
        if op == "undo":
            undone += [done.pop()] if done else []
        elif op == "redo":
            done += [undone.pop()] if undone else []
        else:
            done.append(v)
            undone.clear()
    want = {(d, a[-1] if a else None, len(a), len(b)) for d, (a, b) in want.items()}
    assert {tuple(r) for r in E.replay(df, "doc_id", 50).collect()} == want

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df.coalesce(1).write.parquet(f"{base}/in")
    out = E.replay_stream(spark.readStream.schema(df.schema).parquet(f"{base}/in"), "doc_id", 50)
    q = out.writeStream.outputMode("update").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).foreachBatch(
        lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out/batch_id={n}")
    ).start()
    q.awaitTermination(60)
    assert {tuple(r)[:4] for r in spark.read.parquet(f"{base}/out").collect()} == want


def test_edit_sessions_and_their_stream(spark):
    _, df = events(spark)
    batch = {tuple(r) for r in E.coalesce_edits(df, "doc_id", 20).collect()}
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    late = df.limit(1).withColumns({"ts": F.timestamp_seconds(F.lit(1_800_000_000)), "doc_id": F.lit(99)})
    df.unionByName(late).coalesce(1).write.parquet(f"{base}/in")
    s = E.coalesce_edits_stream(spark.readStream.schema(df.schema).parquet(f"{base}/in"), "doc_id", "20 seconds")
    q = s.writeStream.outputMode("append").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).format("parquet").start(f"{base}/out")
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(f"{base}/out").filter("doc_id <> 99").collect()} == batch


ORACLE = [
    "scan_patterns", "redact_patterns", "residual_check", "search", "bates_number", "align_pages", "unique_names",
    "classify_pages", "split_by_size", "diff_summary", "layout_lines", "heading_outline", "recipe_notes", "rate_limit_stream",
]


@pytest.mark.parametrize("name", ORACLE)
def test_oracle(spark, name):
    import check_oracle as K

    state, note, _, _ = K.compare(spark, K.database("/root/testdata/sf0.001"), "/root/testdata/sf0.001", name)
    assert state == "ok", note


def test_a_document_that_fails_leaves_the_others_alone(spark):
    from corpuskit.plans import recipe as RC

    rows = [(i, f"f{i}", f"text {i}" if i % 5 else None, 6) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, file string, text string, n_bytes bigint").withColumn("_before2", F.lit(1))

    def odd(doc, settings):
        if doc["text"] is None:
            raise KeyError("no text")
        return {"text": doc["text"].upper(), "n_bytes": "many" if doc["doc_id"] == 7 else len(doc["text"])}

    calls = RC.document_tool(odd, ["doc_id", "text"], ["text", "n_bytes"])
    out, notes = RC.Recipe(["up", "missing", "up"]).register("up", calls).run(df, F.when(F.col("doc_id") == 1, F.lit("refused")))
    got = {r.doc_id: r for r in out.collect()}
    why = {}
    for n in notes.collect():
        why.setdefault(n.doc_id, []).append((n.kind, n.detail))
    for i, _, text, _ in rows:
        if i == 1:
            assert got[i].error == "refused" and why[i] == [("failed", "refused")]
        elif text is None or i == 7:
            assert got[i].text == text and got[i].n_bytes == 6 and [k for k, _ in why[i]] == ["failed"]
            assert ("no text" in why[i][0][1]) == (text is None)
        else:
            assert got[i].text == text.upper() and got[i].error is None and [k for k, _ in why[i]] == ["changed"]


def test_bounded_history_of_shuffled_arrivals(spark):
    """Seven batches of events in any order give what all events at once give."""
    import random
    import tempfile

    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5]), i, 1_700_000_000 + rng.randint(0, 400)) for i in range(700)]
    rng.shuffle(rows)
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame(rows, "user_id int, event_id bigint, s bigint").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    for i in range(7):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], "user_id int, event_id bigint, s bigint").select(
            "user_id", "event_id", F.timestamp_seconds("s").alias("ts")
        ).coalesce(1).write.mode("append").parquet(f"{base}/in")
    numbers = []

    def merge(batch, number):
        # each batch twice, as after a failure
        E.merge_history(batch, number, f"{base}/store", "user_id", 30)
        E.merge_history(batch, number, f"{base}/store", "user_id", 30)
        numbers.append(number)

    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    E.bounded_history_stream(s, "user_id", 9).writeStream.outputMode("update").option("checkpointLocation", f"{base}/cp").trigger(
        availableNow=True
    ).foreachBatch(merge).start().awaitTermination(120)
    assert numbers == list(range(7))
    got = E.history_of(spark, f"{base}/store", 6, "int", "user_id").select("user_id", "event_id").collect()
    want = E.bounded_history(df, "user_id", 9, 30).select("user_id", "event_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 30


def test_private_characters_of_a_page_stay(spark):
    from corpuskit.operators.html import html_blocks

    html = "<p title='&quot;\uf8ff'>a \uf8fflt; b &amp; \ue000 &lt;c</p>"
    rows = html_blocks(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [r.text for r in rows] == ["a \uf8fflt; b & \ue000 <c"]


def test_the_package_reaches_executors_that_lack_it(tmp_path):
    """Another interpreter, in another folder, whose workers find the package only if it is shipped."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.remove({root!r})
from corpuskit.session import ship_package
ship_package(spark)
from corpuskit.operators.sentences import sentences
print("ROWS", sentences(spark.createDataFrame([(1, "One. Two.")], "doc_id int, text string")).count())
"""
    code = code.replace(f"sys.path.remove({root!r})\nfrom corpuskit.session", "from corpuskit.session")
    # nothing of this process's Spark goes along, and the other one is small
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("PYSPARK_", "SPARK_"))}
    env["PYSPARK_SUBMIT_ARGS"] = "--driver-memory 512m pyspark-shell"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 2" in out.stdout, out.stderr[:3000] + out.stderr[-3000:]


def test_diff_long_pairs_keeps_documents_apart(spark, monkeypatch, tmp_path):
    """No pair holds more than one document, and a very long document is one pair."""
    from corpuskit.checks import load
    from corpuskit.checks import q04_sizes as Q

    docs = [(i, " ".join(f"w{i}_{k}" for k in range(7 + i))) for i in range(30)]
    docs += [(30, " ".join(f"v{k % 5000}" for k in range(60_000))), (31, ""), (32, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    real, whole = Q.LD.diff_long, []
    monkeypatch.setattr(Q.LD, "diff_long", lambda pairs: whole.append(pairs) or real(pairs))
    got = {r.pair_id: (r.n_equal, r.n_insert, r.n_delete) for r in load().QUERIES["diff_long_pairs"](spark, str(tmp_path)).collect()}
    want = {}
    for i, text in docs:
        n = len((text or "").split())
        gone = len(range(1, n, 3))
        if n:
            e, s, d = want.get(i % 7, (0, 0, 0))
            want[i % 7] = (e + n - gone, s, d + gone)
    assert got == want
    sides = sorted(len((r.old or "").split()) for r in whole[0].collect())
    assert sides == sorted(len((text or "").split()) for _, text in docs)


def test_streams_read_a_table_of_many_files(spark):
    import __spark_entry__ as entry

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in ("documents", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    for name in ("stream_patterns", "stream_index", "rate_limit_stream"):
        one, many = (entry.queries()[name](spark, f) for f in ("/root/testdata/sf0.001", folder))
        rows = sorted(map(tuple, one.collect()))
        assert rows and rows == sorted(map(tuple, many.collect())), name


def test_documents_become_objects_a_few_at_a_time():
    import pyarrow as pa

    from corpuskit.plans import recipe

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["x" * 50_000] * 1000})
    parts = list(recipe.some_at_once(batch))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.num_rows for p in parts) <= 100


def test_a_written_index_is_not_shuffled(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from corpuskit.operators import search as SE

    pages = spark.createDataFrame([(1, 0, "a b"), (2, 0, "b c")], "doc_id long, page_no long, text string").repartition(2)
    path, calls = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), []
    plain = type(pages).repartition
    monkeypatch.setattr(type(pages), "repartition", lambda self, *a: calls.append(a) or plain(self, *a))
    SE.write_index(SE.build_index(pages), path)
    assert not calls and isinstance(pages, DataFrame)
    assert sorted((r.token, r.doc_id) for r in SE.stored_postings(spark, path, "b c").collect()) == [("b", 1), ("b", 2), ("c", 2)]


ODD_PAGES = [
    (1, "Alpha  beta\tALPHA gamma\nalphabet 12,5"), (1, "beta delta\n\nalpha"), (2, None), (2, ""), (None, "alpha nobody"), (None, "alpha"),
    (3, "İstanbul ΣΑΣ ǅ straße ½ Ⅷ 漢字 \U0001f600 é é"), (4, "x" * 200 + " y" * 300), (5, "a   b﻿ c " * 60 + "\n" * 25 + "end – of “it”"),
    (6, "".join(chr(c) for c in range(0x130)) + " plain"),
]


def test_figures_of_tokens_are_those_of_all_postings(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corpuskit.operators import pages as PG
    from corpuskit.operators import search as SE

    docs = spark.createDataFrame(ODD_PAGES, "doc_id long, text string").repartition(3)
    want = SE.build_index(PG.paginate(docs, 2)).groupBy("token").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_distinct("doc_id").alias("n_docs"), F.min("snippet").alias("lo"), F.max("snippet").alias("hi")
    )
    want = sorted(map(tuple, want.collect()))
    assert len(want) > 30
    assert sorted(map(tuple, SE.token_figures(docs, 2).collect())) == want
    monkeypatch.setattr(SE, "TOKENS_AT_ONCE", 1)
    assert sorted(map(tuple, SE.token_figures(docs, 2).collect())) == want
    assert SE.token_figures(docs.limit(0)).count() == 0


def test_building_the_index_shuffles_no_postings(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["build_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert shuffles and not [line for line in shuffles if "doc_id" in line], plan


def test_a_page_index_has_all_postings_in_little_space(spark, monkeypatch):
    from pathlib import Path

    from pyspark.sql import functions as F

    from corpuskit.operators import pages as PG
    from corpuskit.operators import search as SE

    pages = PG.paginate(spark.createDataFrame(ODD_PAGES, "doc_id long, text string").repartition(3), 2)
    queries = ["alpha beta", "é 漢字 i̇stanbul", "x" * 200 + " y end", "nothing", ""]
    for at_once in (SE.POSTINGS_AT_ONCE, 1):
        monkeypatch.setattr(SE, "POSTINGS_AT_ONCE", at_once)
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        SE.write_page_index(pages, path)
        for query in queries:
            want = SE.build_index(pages).filter(F.col("token").isin(SE.query_tokens(query)))
            got = SE.page_index_postings(spark, path, query)
            assert got.columns == want.columns
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    SE.write_page_index(pages.limit(0), path)
    assert SE.page_index_postings(spark, path, "alpha").count() == 0
    text = "\n".join(" ".join(f"word{i * j % 997}" for j in range(100)) for i in range(400))
    many = PG.paginate(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    sizes = []
    for write in (lambda path: SE.write_page_index(many, path), lambda path: SE.write_index(SE.build_index(many), path)):
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        write(path)
        sizes.append(sum(f.stat().st_size for f in Path(path).rglob("*.parquet")))
    assert sizes[0] < sizes[1] / 2, sizes


def test_the_stored_search_writes_no_snippets(spark, monkeypatch):
    import __spark_entry__ as entry
    from corpuskit.checks import q02_text

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    monkeypatch.setattr(q02_text, "checkpoint_folder", lambda spark: folder)
    found = entry.queries()["search_stored"](spark, "/root/testdata/sf0.001")
    assert found.count() == entry.queries()["search"](spark, "/root/testdata/sf0.001").count() > 0
    written = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(folder)
    assert "text" in written.columns and "snippet" not in written.columns
