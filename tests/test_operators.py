"""Operators against plain loops on small inputs, with blocks small enough to matter."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuskit.operators import compare as C
from corpuskit.operators import html as H
from corpuskit.operators import layout as L
from corpuskit.operators import ordered as O
from corpuskit.operators import pagesets as PS
from corpuskit.operators import search as SE
from corpuskit.operators import sizing as Z
from corpuskit.operators import stats as ST
from corpuskit.operators.sentences import sentence_ranges
from corpuskit.operators.unique_names import unique_names


def test_blocked_windows_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), p, rng.randint(-5, 9)) for p in range(200)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    got = O.running_sums(df, ["k"], "pos", {"s": F.col("v")}, block=7, totals={"t": "s"})
    got = O.running_max(got, ["k"], "pos", {"m": F.when(F.col("v") > 0, F.col("v"))}, block=5)
    got = O.previous_values(got, ["k"], "pos", {"b": "v"}, block=3)
    want = df.withColumns({
        "s": F.sum("v").over(w), "t": F.sum("v").over(Window.partitionBy("k")),
        "m": F.max(F.when(F.col("v") > 0, F.col("v"))).over(w), "b": F.lag("v").over(Window.partitionBy("k").orderBy("pos")),
    })
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_counted_join_spreads_hot_keys(spark):
    big = spark.range(100).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = O.counted_join(big, small, ["k"], "n", ways=4, hot_rows=10)
    assert got.count() == 100 and got.filter("k = 0 AND first = 0").count() == 60


def sequential(names):
    seen, out = {}, []
    for n in names:
        k = seen[n] = seen.get(n, 0) + 1
        new = n
        if k > 1:
            while f"{n} ({k})" in seen:
                k += 1
            new = f"{n} ({k})"
            seen[new] = 1
        out.append(new)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    names = [rng.choice(["a", "a", "b", "a (2)", "a (3)", "a (2) (2)", "b (2)", "c (4)"]) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    got = [r.u for r in unique_names(df, "name", "pos", "u").orderBy("pos").collect()]
    assert got == sequential(names)


def test_moved_pages_are_minimal(spark):
    rng = random.Random(4)
    rows = []
    for d in range(12):
        perm = list(range(9))
        for _ in range(d % 4):
            i, j = rng.sample(range(9), 2)
            perm[i], perm[j] = perm[j], perm[i]
        rows += [(d, i, b) for i, b in enumerate(perm)]
    out = PS.moved_pages(spark.createDataFrame(rows, "doc_id int, pos int, before_pos int")).collect()
    for d in range(12):
        seq = [r for r in sorted(out, key=lambda r: r.pos) if r.doc_id == d]
        perm = [r.before_pos for r in seq]
        kept = [r.before_pos for r in seq if not r.moved]
        best = [1] * 9
        for i in range(9):
            best[i] = 1 + max([best[j] for j in range(i) if perm[j] < perm[i]], default=0)
        assert kept == sorted(kept) and len(kept) == max(best)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_diff_is_minimal_and_rebuilds_both_sides(spark):
    rng = random.Random(42)
    pairs = []
    for i in range(120):
        v = "abcdef"[: rng.randint(1, 6)]
        pairs.append((i, " ".join(rng.choices(v, k=rng.randint(0, 29))), " ".join(rng.choices(v, k=rng.randint(0, 29)))))
    out = {r.pair_id: r.chunks for r in C.diff_pairs(spark.createDataFrame(pairs, "pair_id int, old string, new string")).collect()}
    for i, old, new in pairs:
        ch = out[i]
        assert [c.text for c in ch if c.op != "insert"] == old.split()
        assert [c.text for c in ch if c.op != "delete"] == new.split()
        assert sum(c.op == "equal" for c in ch) == lcs(old.split(), new.split())


@pytest.mark.parametrize("bits", [1, 40, 1 << 25])
def test_diff_is_minimal_however_it_is_cut(monkeypatch, bits):
    monkeypatch.setattr(C, "TABLE_BITS", bits)
    rng = random.Random(5)
    for _ in range(150):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in "ab")
        common = C._common(a, b)
        assert all(a[i] == b[j] for i, j in common) and len(common) == lcs(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(common, common[1:]))


def test_diff_has_no_bounds():
    rng = random.Random(6)
    old = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    new = [w for w in old if rng.random() < 0.5]
    script = C.middle(old, new)
    assert [w for op, w in script if op == "equal"] == new
    other = [f"x{i}" for i in range(300_000)]
    assert len(C.middle(old, other)) == 320_000


def test_split_by_size(spark):
    sizes = [80, 20, 90, 10, 60, 60, 5]
    df = spark.createDataFrame([(1, i, b, 7) for i, b in enumerate(sizes)], "doc_id int, pos int, n_bytes int, n int")
    out = sorted((r.from_pos, r.to_pos, r.oversized) for r in Z.split_by_size(df, 100).collect())

    def plan(a, b):
        if sum(sizes[a:b]) <= 100 or b - a <= 1:
            return [(a, b, sum(sizes[a:b]) > 100)]
        m = a + (b - a) // 2
        return plan(a, m) + plan(m, b)

    assert out == plan(0, 7)


def test_suppress_overlaps(spark):
    rng = random.Random(6)
    rows = [(i % 2, 0, i, rng.random(), rng.random(), 0.3, 0.3, rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, region_no int, x double, y double, width double, height double, score double")
    got = {r.region_no for r in ST.suppress_overlaps(df).collect()}
    want = set()
    for d in (0, 1):
        kept = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[7], r[2])):
            def iou(k):
                ox = min(k[3], r[3]) + 0.3 - max(k[3], r[3])
                oy = min(k[4], r[4]) + 0.3 - max(k[4], r[4])
                return ox * oy / (0.18 - ox * oy) if ox > 0 and oy > 0 else 0
            if all(iou(k) <= 0.3 for k in kept):
                kept.append(r)
        want |= {r[2] for r in kept}
    assert got == want


def test_tables(spark):
    rows = [["Date", "Description", "Amount"], ["01/02", "Coffee shop", "4.50"], ["02/02", "", "12.00"]]
    items = []
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            for k, word in enumerate(v.split()):
                items.append((1, 0, 0, word, c * 150.0 + k * 40, r * 20.0 + (r % 2), len(word) * 6.0, 10.0))
    df = spark.createDataFrame(items, "doc_id int, page_no int, table_no int, text string, x double, y double, width double, height double")
    cells = {(c.row_no, c.col_no): c.value for c in L.extract_tables(df).collect()}
    assert [[cells[r, c] for c in range(3)] for r in range(3)] == rows


HTML = """<!DOCTYPE html><script>var t="</p>";</script><h1>Top &amp; <i>more</i></h1><p>one <b>two</b><br>three
<ul><li>a<ol start=3><li>x</li><li>y</ol></li><li>b</ul></p><table><tr><td>1<td><p>2</p></tr><tr><td>3</td></tr></table>
<img src="http://x/y.png"><div>tail</div>"""


def test_html_blocks(spark):
    df = spark.createDataFrame([(1, HTML)], "page_id int, html string")
    rows = H.html_blocks(df).orderBy("block_no").collect()
    assert [(r.kind, r.level, r.text) for r in rows[:2]] == [
        ("heading", 1, "Top & more"), ("paragraph", None, "one two\nthree\naxyb"),
    ]
    assert [r.rows for r in rows if r.kind == "table"] == [[["1", "2"], ["3", ""]]]
    assert [r.kind for r in rows][-2:] == ["paragraph", "note"]
    li = H.html_blocks(spark.createDataFrame([(1, "<ul><li>a<ol start=3><li>x</li><li>y</ol></li><li>b</ul>")], "page_id int, html string"))
    assert [(r.marker, r.depth, r.text) for r in li.orderBy("block_no").collect()] == [
        ("•", 0, "a"), ("3.", 1, "x"), ("4.", 1, "y"), ("•", 0, "b"),
    ]


def test_sentences():
    def parts(t):
        return [t[a:b] for a, b in sentence_ranges(t)]

    assert parts("Dr. Smith came at 3. then left. OK! J. Doe too.") == ["Dr. Smith came at 3. then left.", "OK!", "J. Doe too."]
    long = "word " * 120 + "end."
    assert parts(long) == [long]
    cut = [long[a:b] for a, b in sentence_ranges(long, 250)]
    assert all(len(p) <= 250 for p in cut) and " ".join(cut) == long


def test_index_update(spark):
    def pages(*rows):
        return spark.createDataFrame(rows, "doc_id int, page_no int, text string")

    old = SE.build_index(pages((1, 0, "alpha beta"), (2, 0, "beta gamma"), (3, 0, "gone")))
    meta = spark.createDataFrame([(1, 10, 5), (2, 10, 5), (3, 10, 5)], "doc_id int, last_modified int, size int")
    files = spark.createDataFrame([(1, 10, 5, True), (2, 11, 6, True), (4, 1, 1, True), (5, 1, 1, False)], "doc_id int, last_modified int, size int, readable boolean")
    states = SE.classify_files(meta, files)
    assert {r.doc_id: r.state for r in states.collect()} == {1: "unchanged", 2: "changed", 3: "gone", 4: "new", 5: "unreadable"}
    new = SE.update_index(old, states, pages((2, 0, "delta beta"), (4, 0, "beta"), (5, 0, "secret")))
    assert {(r.token, r.doc_id) for r in new.collect()} == {("alpha", 1), ("beta", 1), ("delta", 2), ("beta", 2), ("beta", 4)}
    hits = SE.search(new, "beta alpha").collect()
    assert [(r.doc_id, r.score) for r in hits] == [(1, 25), (2, 10), (4, 10)]


def test_bank_statement_and_sparse_tables(spark):
    statement = [
        ("Date", 40, 50, 30), ("Description", 140, 50, 70), ("Amount", 320, 50, 45), ("Balance", 450, 50, 45),
        ("2026-08-01", 40, 80, 60), ("Payroll", 140, 80, 40), ("Direct", 185, 80, 35), ("+$2,500.00", 320, 80, 65), ("$2,500.00", 450, 80, 60),
        ("2026-08-02", 40, 110, 60), ("Coffee", 140, 110, 35), ("Shop", 180, 110, 25), ("-$4.50", 320, 110, 35), ("$2,495.50", 450, 110, 60),
        ("Carried over to the next page of this statement", 40, 140, 400), (" ", 40, 170, 5),
    ]
    sparse = [
        ("ID", 20, 20, 15), ("Name", 100, 20, 30), ("Status", 200, 20, 40), ("1", 20, 40, 10), ("Alice", 100, 40, 30),
        ("Active", 200, 40, 35), ("2", 20, 60, 10), ("Bob", 100, 60, 25),
    ]
    rows = [(1, 0, t, x * 1.0, y * 1.0, w * 1.0, 12.0) for t, x, y, w in statement]
    rows += [(1, 1, t, x * 1.0, y * 1.0, w * 1.0, 10.0) for t, x, y, w in sparse] + [(2, 0, None, 1.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(
        [(d, 0, n, *rest) for d, n, *rest in rows],
        "doc_id int, page_no int, table_no int, text string, x double, y double, width double, height double",
    )
    got = {}
    for r in sorted(L.extract_tables(df).collect()):
        got.setdefault((r.doc_id, r.table_no), {}).setdefault(r.row_no, []).append(r.value)
    assert list(got[1, 0].values()) == [
        ["Date", "Description", "Amount", "Balance"], ["2026-08-01", "Payroll Direct", "+$2,500.00", "$2,500.00"],
        ["2026-08-02", "Coffee Shop", "-$4.50", "$2,495.50"], ["Carried over to the next page of this statement", "", "", ""],
    ]
    assert list(got[1, 1].values()) == [["ID", "Name", "Status"], ["1", "Alice", "Active"], ["2", "Bob", ""]]
    assert (2, 0) not in got


def test_html_lists_of_any_depth(spark):
    df = spark.createDataFrame([(1, "<ul><li>x" * 5000)], "page_id int, html string")
    rows = H.html_blocks(df, max_depth=8).collect()
    assert [r.text for r in rows if r.kind == "note"] == ["lists deeper than 8 levels are shown at that depth"]
    assert max(r.depth for r in H.html_blocks(df).collect()) == 4999


def test_reorder_needs_a_permutation(spark):
    from corpuskit.operators.sequence import reorder_pages

    pages = spark.createDataFrame([(d, f"k{i}", i) for d in range(4) for i in range(4)], "doc_id int, page_key string, pos long")
    targets = {0: [3, 2, 1, 0], 1: [0, 0, 3, 3], 2: [1, 2, 3, 4], 3: [0, 1, 2, None]}
    order = spark.createDataFrame(
        [(d, f"k{i}", t) for d, ts in targets.items() for i, t in enumerate(ts) if t is not None], "doc_id int, page_key string, new_pos long"
    )
    got = {(r.doc_id, r.page_key): (r.pos, r.applied) for r in reorder_pages(pages, order).collect()}
    assert len(got) == 16
    assert [got[0, f"k{i}"] for i in range(4)] == [(3 - i, True) for i in range(4)]
    assert all(got[d, f"k{i}"] == (i, False) for d in (1, 2, 3) for i in range(4))
    twice = spark.createDataFrame([(0, "k0", 0), (0, "k0", 1), (0, "k1", 2), (0, "k2", 3)], order.schema)
    assert reorder_pages(pages.filter("doc_id = 0"), twice).count() == 4


def test_made_up_names_of_many_digits(spark):
    from corpuskit.operators.unique_names import _real_numbers, unique_names

    names = ["a", "a (123456789012)", "a", "b (2)", "b", "b"]
    df = spark.createDataFrame(list(enumerate(names)), "pos bigint, name string")
    got = [r.u for r in unique_names(df, "name", "pos", "u").orderBy("pos").collect()]
    assert got == ["a", "a (123456789012)", "a (2)", "b (2)", "b", "b (3)"]
    occ = df.select(F.col("name").alias("_key"), F.col("pos").alias("_pos"), F.lit(1).alias("_k"))
    assert {r._n for r in _real_numbers(occ, " (n)", 2).collect()} == {123456789012, 2}


def test_free_names_never_meet(spark):
    from corpuskit.operators.unique_names import free_names

    wanted = spark.createDataFrame(
        [("f", n, i) for i, n in enumerate(["a.pdf", "a.pdf", "a (1).pdf", "A.PDF", ".pdf", ".pdf", "b (12345678901).pdf"])],
        "folder string, name string, pos long",
    )
    have = spark.createDataFrame([("f", "A (2).pdf"), ("g", "a.pdf")], "folder string, name string")
    got = [r.free_name for r in sorted(free_names(wanted, have).collect(), key=lambda r: r.pos)]
    assert got == ["a.pdf", "a (3).pdf", "a (1).pdf", "A (4).PDF", ".pdf", ".pdf (1)", "b (12345678901).pdf"]
    assert len({n.lower() for n in got}) == len(got)


def test_redaction_is_undecided_where_pages_cannot_be_read(spark):
    from corpuskit.operators.redact import verification_summary, verify_redaction

    out = spark.createDataFrame(
        [(1, 0, "clean"), (1, 1, None), (2, 0, "clean"), (3, 0, "\x00s\x00e\x00c"), (4, 0, "x 5365C3 y".lower()), (5, 0, None), (5, 1, "Sec")],
        "doc_id int, page_no int, text string",
    )
    marks = spark.createDataFrame(
        [(d, 0, 0, "word", "Sec") for d in (1, 2, 3, 5)] + [(4, 0, 0, "word", "Seé".replace("é", "Ã"))],
        "doc_id int, page_no int, start int, category string, hit string",
    )
    got = {r.doc_id: (r["pass"], r.state) for r in verify_redaction(out, marks).collect()}
    assert got == {1: (False, "undecided"), 2: (True, "removed"), 3: (False, "left"), 4: (False, "left"), 5: (False, "left")}
    sums = {r.doc_id: (r.verified, r.undecided) for r in verification_summary(verify_redaction(out, marks)).collect()}
    assert sums[1] == (False, 1) and sums[2] == (True, 0)


def test_search_limits_and_session_ties(spark):
    from corpuskit.streaming import edits as E

    posts = SE.build_index(spark.createDataFrame([(1, 0, "the cat"), (2, 0, "the dog")], "doc_id int, page_no int, text string"))
    assert SE.search(posts, "the", limit=0).count() == 0 and SE.search(posts, "the", limit=1).count() == 1
    rows = [(1, i, 1_700_000_000 + s) for i, s in enumerate([0, 5, 5, 5, 100, 100, 101])]
    events = spark.createDataFrame(rows, "doc_id int, event_id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.event_id, r.session_no) for r in E.sessions(events, "doc_id", 10).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1)}


def test_pages_are_classified_in_one_shuffle(spark):
    pages = spark.createDataFrame([(1, p, 612.0, 792.0) for p in range(4)], "doc_id long, page_no long, page_width double, page_height double")
    census = spark.createDataFrame([(1, 0, 40, 2), (1, 2, 0, 3)], "doc_id long, page_no long, char_count long, run_count long")
    fields = ("doc_id long, page_no long, image_no long, object_no long, width long, height long, bits int, color_space string, filters array<string>, "
              "mask_filters array<string>, mask_kind string, is_mask boolean, byte_length long, placed_w double, placed_h double, flate_bytes long")

    def image(page, no, obj, bits=8):
        return (1, page, no, obj, 2000, 1500, bits, "DeviceRGB", [], [], None, False, 1000, 100.0, 80.0, None)

    # the use of object 6 on a page that is not listed makes it unsafe; object 5 counts at its first use only
    images = spark.createDataFrame([image(0, 1, 5), image(1, 2, 5), image(0, 3, 6), image(9, 4, 6, 1), image(1, 5, -1)], fields)
    plan = Z.classify_pages(pages, images, census, 150)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.page_no: (r.route, r.reason, r.actionable_bytes) for r in plan.collect()}
    assert got == {
        0: ("surgical", "1 over-sampled, 0 uncompressed", 1000), 1: ("raster", "scanned page", 1000),
        2: ("already-optimized", "text only", 0), 3: ("already-optimized", "neither text nor images", 0),
    }


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_a_text_are_found_once_and_hits_cut_by_page(spark):
    text = "\n".join(" ".join(f"the w{i}" for i in range(n)) for n in (0, 1, 40, 700))
    df = spark.createDataFrame([(1, 0, text), (1, 1, "nothing"), (2, 0, " the the  the"), (2, 1, None)], "doc_id int, page_no int, text string")
    pages = df.withColumn("runs", SE.line_runs(F.col("text")))
    assert planned(pages).count("regexp_extract_all") == 1
    per = SE.find_text(pages, "the ", match_case=True, by_page=True)
    keys = ["doc_id", "page_no", "start", "end", "run_no", "run_from", "run_to"]
    got = sorted(map(tuple, SE.hit_slices(per).select(*keys).collect()))
    assert got == sorted(map(tuple, SE.hit_slices(SE.find_text(pages, "the ", match_case=True)).select(*keys).collect()))
    runs = {(r.doc_id, r.page_no): [(x.run_no, x.start, x.end) for x in r.runs or []] for r in pages.collect()}
    want = []
    for doc, page, t in df.collect():
        for s in [i for i in range(len(t or "")) if t.startswith("the ", i)]:
            want += [(doc, page, s, s + 4, n, max(0, s - a), min(s + 4, b) - a) for n, a, b in runs[doc, page] if b > s and a < s + 4]
    assert got == sorted(want) and len(got) > 700


def test_hits_cut_by_runs_in_any_order(spark):
    rows = [(1, 3, 9, [(0, 5, 6), (1, 0, 20), (2, 9, 12), (3, 2, 4), (4, 8, 9)]), (2, 0, 4, []), (3, 0, 4, [(7, 0, 1)])]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, runs array<struct<run_no:int,start:int,end:int>>")
    got = sorted(map(tuple, SE.hit_slices(df).collect()))
    assert got == sorted(
        (d, s, e, n, max(0, s - a), min(e, b) - a) for d, s, e, runs in rows for n, a, b in runs if b > s and a < e
    )


def test_diff_summary_counts_without_a_shuffle(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        old = [rng.choice("aabcdé") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 12))]
        new = [w for w in old if rng.random() < 0.8] + [rng.choice("xyab")] * rng.choice([0, 0, 2])
        rows.append((k, rng.choice(["", "　"]) + rng.choice([" ", "\n", " \t "]).join(old), " ".join(new) if k % 50 else None))
    df = spark.createDataFrame(rows, "pair_id int, old string, new string").coalesce(1)
    made = C.diff_summary(df)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = []
    for k, a, b in rows:
        a, b = a.split(), (b or "").split()
        least = min(len(a), len(b))
        head = next((i for i in range(least) if a[i] != b[i]), least)
        tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
        only = [sum((Counter(x) - Counter(y)).values()) for x, y in ((a, b), (b, a))]
        want.append((k, len(a), len(b), head, tail, *only))
    assert sorted(map(tuple, made.collect())) == want


def test_grid_notes_count_without_ranks_of_all_cells(spark):
    cells = [(d, s, r, c, "v" * (r + c)) for d in "ab" for s in range(5) for r in range(6) for c in range(4) if (r + s) % 5]
    hidden = [("a", "sheet", 0, None), ("a", "row", 1, 2), ("a", "row", 1, 2), ("b", "column", 3, 0), ("b", "column", 3, 9)]
    df = spark.createDataFrame(cells, "doc_id string, sheet_no int, row_no int, col_no int, value string")
    hid = spark.createDataFrame(hidden, "doc_id string, kind string, sheet_no int, at int")
    out, notes = L.grid_cleanup(df, hid, sheets=3, rows=4, columns=2, chars=5)
    # three joins take hidden places out; they run once for all counts, and not twice for each cap
    assert planned(notes).count("LeftAnti") <= 21
    off = {(d, k, s, at) for d, k, s, at in hidden}
    shown = [c for c in cells if not {(c[0], "sheet", c[1], None), (c[0], "row", c[1], c[2]), (c[0], "column", c[1], c[3])} & off]
    want, kept = {}, []
    for d in "ab":
        want[d, "hidden sheets"] = len({x for x in off if x[:2] == (d, "sheet")})
        want[d, "hidden rows"] = len({x for x in off if x[:2] == (d, "row")})
        want[d, "hidden columns"] = len({x for x in off if x[:2] == (d, "column")})
        order = sorted({c[1] for c in shown if c[0] == d})
        want[d, "sheets over the cap"] = max(0, len(order) - 3)
        per = {s: [sorted({c[k] for c in shown if c[:2] == (d, s)}) for k in (2, 3)] for s in order}
        for k, (most, kind) in enumerate(((4, "rows"), (2, "columns"))):
            want[d, f"{kind} over the cap"] = sum(max(0, len(p[k]) - most) for p in per.values())
        kept += [c for c in shown if c[0] == d and c[1] in order[:3] and c[2] in per[c[1]][0][:4] and c[3] in per[c[1]][1][:2]]
        want[d, "shortened cells"] = sum(c[0] == d and len(c[4]) > 5 for c in kept)
    assert {(r.doc_id, r.kind): r.n for r in notes.collect()} == {k: n for k, n in want.items() if n}
    assert sorted(map(tuple, out.collect())) == sorted((*c[:4], c[4] if len(c[4]) <= 5 else c[4][:4] + "…") for c in kept)
