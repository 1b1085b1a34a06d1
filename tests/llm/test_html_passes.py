"""Block rules on pages without article, class names or well-formed markup."""

from __future__ import annotations

import re
import time
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from textward.llm import html

PROSE = "It is the end of the road and we are not there yet, but that is what they said to all of us. " * 4
PAGES = "/root/testdata/sf0.01/pages.parquet"


def bare(page: str) -> str:
    """The page without its article element and the class of its adverts."""
    return re.sub(r"</?article[^>]*>", "", page).replace('<div class="ad">', "<div>")


def test_density_length_and_links_find_the_text_without_an_article():
    kept = total = added = empty = 0
    for page in pq.read_table(PAGES).column("html").to_pylist():
        want = Counter(html.main_text(page).split("\n\n"))  # the article's blocks, see the next test
        got = Counter(html.main_text(bare(page)).split("\n\n"))
        total += sum(len(b) * n for b, n in want.items())
        kept += sum(len(b) * n for b, n in (want & got).items())
        added += sum(len(b) * n for b, n in (got - want).items())
        empty += got == Counter([""])
    assert kept >= 0.95 * total and added <= 0.01 * total and empty == 0


def test_all_blocks_of_the_given_articles_are_kept():
    for page in pq.read_table(PAGES).column("html").to_pylist():
        article = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        blocks = [" ".join(html.html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split())
                  for x in re.split(r"</?(?:p|h1)>", article)]
        assert html.main_text(page) == "\n\n".join(b for b in blocks if b)


def test_first_pass_outside_an_article():
    label = lambda text, linked=0, **kw: html._first_pass(
        html.Block(kw.get("main", False), kw.get("apart", False), kw.get("heading", False), [], linked, text), 0.2, 0.3)
    words = "turbine gasket flange bearing sprocket washer " * 6
    assert label(PROSE) == "text" and label(PROSE, apart=True) == "other"
    assert label(PROSE, linked=len(PROSE) // 2) == "other"
    assert label(PROSE[:150]) == "open" and label("Short one") == "open" and label("Short one", linked=9) == "other"
    assert label(words) == "other" and label(words, main=True) == "open"
    assert label("© 2020 somebody") == "other" and label("A title", heading=True) == "open"


def test_word_lists_go_and_pages_in_unlisted_languages_stay():
    words = "turbine gasket flange bearing sprocket washer " * 6
    page = f"<h1>On roads</h1><p>{PROSE}</p><p>{PROSE}</p><div>{words}</div><p>{PROSE}</p>"
    assert html.main_text(page) == "\n\n".join(["On roads", *[PROSE.strip()] * 3])
    foreign = "Zażółć gęślą jaźń " * 20
    assert html.main_text(f"<nav><a href=x>A</a></nav><h1>Tytuł</h1><p>{foreign}</p><footer>x</footer>") \
        == f"Tytuł\n\n{foreign.strip()}"
    noisy = " ".join(w + "%%%" for w in PROSE.split())
    assert html.main_text(f"<p>{noisy}</p>") == noisy


def test_second_pass_outside_an_article():
    page = f"<nav><a href=x>A</a></nav><div>Buy it now</div><h1>Title</h1><p>One.</p><p>{PROSE}</p><p>Two.</p>" \
           "<p>Three.</p><footer>end</footer>"
    assert html.main_text(page) == f"Title\n\nOne.\n\n{PROSE.strip()}\n\nTwo.\n\nThree."
    short = "<nav><a href=x>A</a></nav><div>Buy it now</div><h1>Title</h1><p>All there is.</p><footer>end</footer>"
    assert html.main_text(short) == "Title\n\nAll there is."
    assert html.main_text("<div>Buy it now</div><footer>end</footer>") == ""


def test_links_around_blocks_count_and_end_with_their_element():
    teaser = f"<div><a href=x><div><p>{PROSE}</p></div></a></div>"
    assert html.main_text(f"<p>{PROSE}</p>{teaser}") == PROSE.strip()
    for unclosed in ("<p><a href=x>go<p>", "<ul><li><a href=x>go</li></ul><p>", "<div><a href=x>go</div><p>"):
        assert PROSE.strip() in html.main_text(f"{unclosed}{PROSE}</p><p>{PROSE}")


def test_deep_and_unmatched_tags_take_linear_time():
    page = "<div>" * 100_000 + PROSE + "</span></section></table>" * 100_000 + "</div>" * 100_000
    begin = time.perf_counter()
    assert html.main_text(page) == PROSE.strip()
    assert time.perf_counter() - begin < 20


def test_tables_with_odd_rows_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (None, f"<p>{PROSE}"), (3, f"<p>{PROSE}"), (3, f"<p>{PROSE}"), (4, "<"), (5, "plain words"),
            (6, "</div>" * 500), (7, "<article><p>" + "long word " * 100_000)]
    table = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("text", F.lit("t")) \
        .withColumn("block", F.lit(0)).withColumn("url", F.lit(None).cast("string"))
    out = table.withColumn("main", html.extract(F.col("html"))).select("page_id", "main", "text", "block").collect()
    want = [(i, html.main_text(p)) for i, p in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.page_id, r.main) for r in out), key=key) == sorted(want, key=key)
    assert {r.text for r in out} == {"t"} and sum(r.main == PROSE.strip() for r in out) == 3
    none = table.limit(0).select(html.extract(F.col("html")).alias("main"))
    assert none.count() == 0 and none.schema["main"].dataType.simpleString() == "string"
