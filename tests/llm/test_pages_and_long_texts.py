"""Page layouts that change what is main text, and texts that are long or do not fit a bound."""

import time

import pytest

from reportmill.llm import decontaminate, html_text, quality

from .test_operators import docs


def say(n, word="w"):
    return " ".join(f"{word}{i}" for i in range(n))


STORY = say(50)
COMMENTS = f"<ol class='comment-list'><li><article class='comment-body'><p>{say(90, 'c')}</p></article></li></ol>"
PAGES = {
    "comments in articles": (f"<article><h1>T</h1><p>{STORY}</p></article><div id='comments' class='comments-area'>{COMMENTS}</div>", "T " + STORY),
    "comments in a section of main": (f"<main><article><p>{STORY}</p></article><section id='comments'>{COMMENTS}</section></main>", STORY),
    "form around a page": (f"<form action='x'><div><p>{STORY}</p></div></form>", STORY),
    "form around a layout": (f"<form><header>top</header><nav>a b c</nav><div><p>{STORY}</p></div><footer>f</footer></form>", STORY),
    "form of a page": (f"<p>{STORY}</p><form><label>name</label><input></form>", STORY),
    "unclosed menu": (f"<nav><ul><li>a<li>b</ul><div><p>{STORY}</p></div>", STORY),
    "unclosed menu and a closed one": (f"<nav><ul><li>a<li>b</ul><div><p>{STORY}</p></div><footer><nav>x</nav></footer>", STORY),
    "unclosed menu before an article": (f"<nav><ul><li>a<li>b</ul><article><p>{STORY}</p></article>", STORY),
    "hidden by style": (f"<p>{STORY}</p><div style='color:red; display: none'>{say(60, 'h')}</div>", STORY),
    "hidden article": (f"<article hidden>{say(60, 'h')}</article><div><p>{STORY}</p></div>", STORY),
    "promoted story": (f"<div><p>{STORY}</p></div><div class='promoted-story'><p>{say(60, 'h')}</p></div>", STORY),
    "short sidebar": (f"<div class='post'><p>{STORY}</p></div><div class='sidebar'>{say(40, 'x')}</div>", STORY),
    "long sidebar": (f"<div class='post'><p>{STORY}</p></div><div class='sidebar'>{say(200, 'x')}</div>", STORY),
    "line of rights": (f"<div><p>{STORY}</p></div><div>Copyright 2024 Someone. All rights reserved.</div>", STORY),
    "layout class with a heading": (f"<div class='layout-sidebar'><h1>T</h1><div><p>{STORY}</p></div></div>", "T " + STORY),
    "layout class around all": (f"<div class='layout-sidebar'><div><p>{STORY}</p></div></div>", STORY),
    "layout class around an article": (f"<div class='sidebar-wrap'><article><p>{STORY}</p></article></div>", STORY),
    "cards in an aside": (f"<article><p>{STORY}</p></article><aside><article>{say(90, 'k')}</article></aside>", STORY),
    "related cards": (f"<article><p>{STORY}</p></article><div class='related'><article>{say(90, 'k')}</article></div>", STORY),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_layout(name):
    page, want = PAGES[name]
    assert html_text.main_text(f"<html><body>{page}</body></html>", html_text.DEFAULTS) == want


@pytest.mark.parametrize("part", ["<nav>", "<nav>a<div>b", "<form><p>", "<aside><article>", "<div class='ad'><h1>x"])
def test_layout_takes_linear_time(part):
    began = time.monotonic()
    html_text.main_text(part * 30_000, html_text.DEFAULTS)
    assert time.monotonic() - began < 15


def test_a_long_contaminated_text_takes_linear_time(spark):
    items = spark.createDataFrame([(i, say(40, f"t{i}x")) for i in range(40)], "item_id long, text string")
    text = " ".join(say(40, f"t{i % 40}x") for i in range(7_500))
    began = time.monotonic()
    row = decontaminate.contamination(docs(spark, [(1, text, "en", "s", 0)]), items).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (300_000, 300_000, 40, True)
    assert time.monotonic() - began < 60


def test_one_text_over_the_bound_changes_only_its_own_part(spark):
    rows = [(i, say(30, "good" if i % 2 else "bad") + f" {i}", "en", "s", 0) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    huge = [(i, t * (2_000 if i == 7 else 1), lang, s, n) for i, t, lang, s, n in rows]
    for table in (rows, huge):
        model = quality.train(docs(spark, table), labels, sample_bytes=100_000)
        got = {r.doc_id: r.score for r in quality.score(docs(spark, rows), model).collect()}
        assert min(got[i] for i in range(1, 200, 2)) > 0.6 > 0.4 > max(got[i] for i in range(0, 200, 2))
