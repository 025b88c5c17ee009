import html
import re

import duckdb
import pytest

from corpuskit.llm import html_text as H


def test_article_of_the_given_pages(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    rows = duckdb.sql(f"select page_id, html from '{path}'").fetchall()
    got = {r.page_id: r for r in H.extract(spark.read.parquet(path)).collect()}
    for i, page in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        inner = re.sub(r"<[^>]*>?", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner))
        want = " ".join(html.unescape(inner).split())
        assert got[i].text == want and got[i].n_chars == len(want)


PROSE = "Some long prose text here that goes on and on, with many words &amp; more of them in every line of it."


@pytest.mark.parametrize("junk", [
    "<nav><ul><li><a href=x>Menu</a></ul></nav>", "<header><h1>Site</h1></header>", "<footer>&copy; foot</footer>",
    "<aside><p>Side text that is long enough to look like prose, if one only looks at words</aside>",
    '<div class="sidebar"><p>Side text that is long</div>', '<div id="cookie-notice">We use cookies on this site</div>',
    '<section class="comments"><div class=c><p>I agree very much with all of this long text</div></section>',
    '<div class="advert"><div>Buy now</div>and more</div>', "<form><label>Name</label><input><button>Go</button></form>",
    "<script>if (a < b) { x('</p>') }</script>", "<style>p > a { b: c }</style>", "<!-- a comment > with -->",
    '<div role="navigation">Skip</div>', "<div hidden>secret</div>", '<div style="display: none">secret</div>',
    "<noscript>Turn it on</noscript>", '<div class="page-header">Top</div>', "<select><option>a<option>b</select>",
])
def test_what_is_no_article_goes(junk):
    def page(within, behind):
        return (f"<html><head><title>T</title></head><body>{junk}<article><h1>Head</h1><p>{PROSE}{within}<p>{PROSE}"
                f"</article>{behind}")

    want = "Head " + " ".join([PROSE.replace("&amp;", "&")] * 2)
    assert H.main_text(page("", junk)) == want
    inside = H.main_text(page("</p>" + junk, ""))
    if "<header" not in junk and "page-header" not in junk:
        assert inside == want
    plain = f"<body>{junk}<div><h2>Head of it</h2><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>{junk}"
    assert H.main_text(plain).count("Some long prose") == 3 and "Menu" not in H.main_text(plain)


def test_link_lists_have_low_ratios():
    links = "".join(f"<div><a href=x>Link number {i}</a></div>" for i in range(20))
    text = H.main_text(f"<body><div>{links}</div><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>")
    assert "Link number" not in text and text.count("Some long prose") == 3


def test_white_space_references_and_inline_markup():
    assert H.main_text("<article><p>a<b>b</b>c \n\t d<div>x&nbsp;&#x41;&lt;</div>e<br>f</p></article>") == "abc d x A< e f"


def test_broken_pages_do_not_crash(spark):
    pages = [None, "", "<", "<p", "<article", "&am", "<article><p>cut &am", "<div>" * 20000 + "deep", "</div></p>x",
             "<![CDATA[x]]>", "<!DOCTYPE", "<a href='", "\x00<p>\x00a", "just text", "<p>" * 3000 + "y"]
    df = spark.createDataFrame([(i, "u", h, "e") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert len(got) == len(pages)
    assert got[0].text == got[1].text == "" and got[13].text == "just text" and got[7].text == "deep"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert H.extract(df.limit(0)).count() == 0


def test_smoothing_and_threshold():
    import numpy as np

    assert np.allclose(H.smooth(np.ones(4), 1.0), 1)
    assert np.allclose(H.smooth(np.array([5.0]), 2.0), 5)
    assert 3 < H.two_means(np.array([1.0, 2, 1, 9, 10])) < 9


def plain_choice(lines, sigma=1.0):
    """Regions and lines by formulas written out, with thresholds tried at every gap."""
    import math

    n = len(lines)
    ratio = [max(0, len(t) - k) / max(1, tags) for t, tags, k, _, _ in lines]
    reach = math.ceil(3 * sigma)
    smoothed = []
    for i in range(n):
        near = [(math.exp(-0.5 * ((i - j) / sigma) ** 2), ratio[j]) for j in range(max(0, i - reach), min(n, i + reach + 1))]
        smoothed.append(sum(w * r for w, r in near) / sum(w for w, _ in near))

    def threshold(values):
        low, high = min(values), max(values)
        while True:
            cut = (low + high) / 2
            a, b = [v for v in values if v <= cut], [v for v in values if v > cut]
            if not a or not b or (sum(a) / len(a), sum(b) / len(b)) == (low, high):
                return cut
            low, high = sum(a) / len(a), sum(b) / len(b)

    regions = {}
    for i, line in enumerate(lines):
        regions.setdefault(line[4], []).append(i)
    weight = {
        r: math.log1p(sum(max(0, len(lines[i][0]) - lines[i][2]) for i in own)) + math.log1p(sum(smoothed[i] for i in own) / len(own))
        + math.log([1, 2, 4][lines[own[0]][3]]) for r, own in regions.items()
    }
    values = list(weight.values())
    good = {r for r, w in weight.items() if max(values) - min(values) < 1.5 or w > threshold(values)}
    level = {i: math.log1p(smoothed[i]) for i in range(n) if lines[i][4] in good}
    flat = max(level.values()) - min(level.values()) < 0.7
    cut = threshold(list(level.values()))
    return [
        lines[i][0] for i in level
        if lines[i][3] or ((flat or level[i] > cut) and lines[i][2] <= 0.5 * len(lines[i][0]))
    ]


def test_ratios_smoothing_and_clusters_against_plain_formulas():
    import random

    content = H.content

    rng = random.Random(4)
    some = 0
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(1, 25)):
            region = rng.choice([0, 0, 0, 1, 2, 3])
            text = "x" * rng.choice([3, 20, 200, 900])
            lines.append((text, rng.randint(0, 9), rng.choice([0, 0, len(text)]), [0, 2, 2, 1][region], region))
        got = content(lines)
        assert got == plain_choice(lines)
        some += len(got) < len(lines)
    assert some > 100


def test_teasers_that_are_articles_do_not_win():
    story = "".join(f"<p>{' '.join(f'word{i}x{k}' for i in range(50))}</p>" for k in range(3))
    page = (
        "<body><article class=card><a href=x>Teaser one</a> in short</article><div>" + story
        + "</div><article class=card><a href=y>Teaser two</a></article></body>"
    )
    assert H.main_text(page) == " ".join(f"word{i}x{k}" for k in range(3) for i in range(50))


def test_implied_ends_at_any_depth():
    for n in (5, 45, 3000):
        assert H.main_text("<p class='advert'>buy now" + "<b>" * n + "<p>the article text is here") == "the article text is here"


def test_repeated_long_and_clashing_pages(spark):
    from pyspark.sql import functions as F

    long = "<article>" + "<p>many words of a very long page</p>" * 20000 + "</article>"
    rows = [(1, "u", "<p>one page</p>"), (1, "u", "<p>one page</p>"), (2, None, long), (3, "u", ""), (None, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"n_chars": F.lit("x"), "Text": F.lit(1)})
    got = sorted(((r.page_id or 0, r.n_chars) for r in H.extract(df, keep=["page_id", "url"]).collect()))
    assert got == [(0, 0), (1, 8), (1, 8), (2, 20000 * 30 + 19999), (3, 0)]
