"""Operators against brute force, exact round trips and held-out accuracy; hard cases of every kind."""

import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportmill.llm import decontaminate, hashing, html_text, line_dedup, lm_score, mixing, ngram_join, quality, sharding, topk, warc
from reportmill.llm.components import connected_components

from ..helpers import connection, same

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
HARD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, "one", None, "b", 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3),
    (6, "ÉÈ   x\ny", "fr", "b", 7), (7, "w " * 30_000, "en", "c", 60_000), (None, "two words", "en", "c", 9), (8, "<b>&amp;\r\n\r\n", "en", "c", 5),
]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit(c) for c in ("key", "n", "h", "id", "size", "words", "k1", "part", "group", "copies")})


def hard(spark):
    return docs(spark, HARD)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def made_texts(n, seed, vocabulary=60, low=0, high=40):
    draw = random.Random(seed)
    base = [[f"w{draw.randrange(vocabulary)}" for _ in range(draw.randint(low, high))] for _ in range(n)]
    for i in range(0, n, 3):  # near copies
        copy = list(base[i - 1])
        if copy:
            copy[draw.randrange(len(copy))] = "edit"
        base[i] = copy
    return [(i, " ".join(w), "en", f"s{i % 4}", 0) for i, w in enumerate(base)]


# Hashing.


def test_hashes_follow_words():
    draw = random.Random(2)
    texts = ["".join(draw.choice("aB é\n\t ") for _ in range(draw.randint(0, 60))) for _ in range(300)] + ["", None]
    got, first = hashing.word_hashes(*hashing.string_buffer(pa.array(texts)))
    flat = [w for t in texts for w in words(t)]
    assert len(got) == len(flat)
    assert [int(x) for x in np.diff(first)] == [len(words(t)) for t in texts]
    seen = defaultdict(set)
    for h, w in zip(got.tolist(), flat, strict=True):
        seen[w].add(h)
    assert all(len(s) == 1 for s in seen.values())
    assert len({next(iter(s)) for s in seen.values()}) == len(seen)


def test_hashes_across_segments(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500))
    whole = hashing.word_hashes(*hashing.string_buffer(pa.array([text, "x"])))
    monkeypatch.setattr(hashing, "SEGMENT", 64)
    cut = hashing.word_hashes(*hashing.string_buffer(pa.array([text, "x"])))
    assert (whole[0] == cut[0]).all()
    assert (whole[1] == cut[1]).all()


def test_long_words_stay_whole(monkeypatch):
    texts = ["x" * 200 + " b " + "y" * 129, "z" * 64 + " q", "k" * 65, "é" * 100 + "\n" + "A" * 70 + "B"]
    whole = hashing.word_hashes(*hashing.string_buffer(pa.array(texts)))
    monkeypatch.setattr(hashing, "SEGMENT", 64)
    cut = hashing.word_hashes(*hashing.string_buffer(pa.array(texts)))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert [len(x) for x in ngram_join.shingle_sets(pa.array(["w" * 300 + " b c d e"]), 5)] == [1]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (100, 102)], "a long, b long")
    got = {r.node: r.comp for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert connected_components(edges.limit(0)).count() == 0


# Mixing.


def mixed_by_hand(rows, weights=(5, 2, 1), cap=3.0):
    size = {i: len(WORD.findall(r[1] or "")) for i, r in enumerate(rows)}
    total = Counter()
    for i, r in enumerate(rows):
        total[r[3]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(total.values()))
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > cap * total[s]}
        if not over:
            target |= {s: rate * weight[s] for s in free}
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
        free -= over
    return size, total, target


@pytest.mark.parametrize("rows", [made_texts(200, 5), HARD, []], ids=["made", "hard", "empty"])
def test_mixing(spark, rows):
    got = mixing.mix(docs(spark, rows)).collect()
    size, total, target = mixed_by_hand(rows)
    assert len(got) == len(rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == total[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    assert sorted(map(str, mixing.mix(docs(spark, rows)).collect())) == sorted(map(str, got))


def test_mixed_rows_repeat(spark):
    rows = made_texts(60, 6)
    got = Counter(r.doc_id for r in mixing.mixed_rows(docs(spark, rows)).collect())
    want = {r.doc_id: r.copies for r in mixing.mix(docs(spark, rows)).collect()}
    assert got == Counter({k: v for k, v in want.items() if v})


# HTML.


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>The head</h1><p>First &amp; <b>bold</b>er  text with quite a
few words in it to read.<br>After a break.<aside>Buy now</aside><p>Second block &eacute;&nbsp;end of the text, longer than the menu.</p><form>Sign up</form></article>
<div id="comments"><p>Nice post!</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    weight = html_text.weights(html_text.count_kinds(PAGE))
    want = "The head First & bolder text with quite a few words in it to read. After a break. Second block é end of the text, longer than the menu."
    assert html_text.main_text(PAGE, weight) == want
    assert html_text.main_text(PAGE, html_text.DEFAULTS) == want
    assert html_text.main_text(PAGE.replace("<article>", "<div id=x>").replace("</article>", "</div>"), weight) == want
    assert html_text.main_text("plain a < b", weight) == "plain a < b"
    assert html_text.main_text("<p>x<!-- open", weight) == "x"
    assert html_text.main_text(None, weight) == ""


def test_main_text_keeps_all_of_the_article():
    """Lists of short items and what stands before a box in the article stay, with weights from pages that have lists in their menus only."""
    say = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    menu = "<nav><ul>" + "<li><a href=/x>Menu</a></li>" * 9 + "</ul></nav><div>short note</div><ul><li>loose item</li></ul>"
    pages = [f"<html><body>{menu}<article><h1>Head</h1><p>{say(200, 'w')}</p></article><footer>us</footer></body></html>" for _ in range(20)]
    counts = sum((html_text.count_kinds(p) for p in pages), Counter())
    items = "".join(f"<li>item n{i}</li>" for i in range(12)) + "<li>last</li>"
    trailing = f"<div id=x><h1>Head</h1><p>{say(60, 'w')}</p><ul>{items}</ul></div>"
    leading = f"<div id=x><ul>{items}</ul><p>{say(60, 'w')}</p></div>"
    boxed = f"<div id=x><h1>Head line</h1><p>{say(30, 'lead')}</p><div class=newsletter><p>{say(45, 'box')}</p><ul><li>one</li></ul></div><p>{say(200, 'w')}</p></div>"
    listed = " ".join(f"item n{i}" for i in range(12)) + " last"
    for weight in (html_text.weights(counts), html_text.DEFAULTS):
        assert html_text.main_text(f"<body>{trailing}<footer>us</footer>", weight) == f"Head {say(60, 'w')} {listed}"
        assert html_text.main_text(f"<body>{leading}<footer>us</footer>", weight) == f"{listed} {say(60, 'w')}"
        assert html_text.main_text(f"<body>{boxed}<footer>us</footer>", weight) == f"Head line {say(30, 'lead')} {say(200, 'w')}"
        menu_page = f"<body><ul>{'<li><a href=/x>Menu</a></li>' * 9}</ul>{trailing}<footer>us</footer>"
        assert html_text.main_text(menu_page, weight) == f"Head {say(60, 'w')} {listed}"


FIFTY = " ".join(f"word{i}" for i in range(50))
MENU = "<ul>" + "".join(f"<li><a href=x>menu {i}</a></li>" for i in range(200)) + "</ul>"


@pytest.mark.parametrize(("page", "text"), [
    (f'<div class="search-results"><p>{FIFTY}</p></div>', FIFTY),
    (f'<body class="blog with-sidebar"><div class="post has-header"><p>{FIFTY}</p></div></body>', FIFTY),
    (f'<article><div class="article-share-wrap"><p>{FIFTY}</p></div></article>', FIFTY),
    (f"<article><header><h1>The title</h1></header><p>{FIFTY}</p></article>", "The title " + FIFTY),
    (f"<article><p>{FIFTY}</p></article>{MENU}<article><p>{FIFTY}</p></article>", FIFTY + " " + FIFTY),
    (f"<body><article><p>{FIFTY}</p></article><aside><p>advert text here</p></body>", FIFTY),
    (f"<body><article><p>{FIFTY}</p></article><footer>foot text here", FIFTY),
    (f'<article><p>{FIFTY}</p><div class="comment-body"><p>a reader says</p></div></article>', FIFTY),
    (f"<aside>x <article><p>{FIFTY}</p></article>", FIFTY),
    (f"<p>a &lt; b < c {FIFTY} 3 <4</p>", f"a < b < c {FIFTY} 3 <4"),
    (f"<part><p>{FIFTY}</p></part>", FIFTY),
])
def test_main_text_of_layouts(page, text):
    assert html_text.main_text(page, html_text.DEFAULTS) == text


@pytest.mark.parametrize("piece", ["<script x", "<a ", '<a href="', "<p '", "<div class=ad>", "<", "<!", "</b>", "<!--", "<a =", "<p>", "<article>"])
def test_unclosed_markup_takes_linear_time(piece):
    began = time.process_time()
    html_text.main_text(piece * ((1 << 18) // len(piece)), html_text.DEFAULTS)
    assert time.process_time() - began < 5


def test_class_words_are_learned():
    page = '<div class="promo">x y</div><main><div class="widget">a b c d e f g</div></main>'
    weight = html_text.weights(sum((html_text.count_kinds(page) for _ in range(20)), Counter()))
    assert weight[".widget"] > 0 > weight[".promo"]
    assert html_text.main_text('<div class="widget"><p>one two three four</p></div>', weight) == "one two three four"


def region_by_hand(scores):
    """Of all runs of highest positive sum the longest, the first of equals."""
    runs = [(sum(scores[a:b]), b - a, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    best = max(runs, default=(0, 0, 0))
    return (-best[2], -best[2] + best[1]) if best[0] > 0 else (0, 0)


def test_whole_extraction_matches_brute_force():
    """Pages of flat blocks: the text is that of the best run of blocks, found by trying all."""
    draw = random.Random(41)
    for _ in range(200):
        blocks = [("li" if draw.random() < 0.4 else "p", [f"w{draw.randrange(99)}" for _ in range(draw.choice((0, 1, 3, 9)))], draw.random() < 0.4) for _ in range(draw.randint(0, 7))]
        page = "".join(f"<{n}>" + (f"<a href=x>{' '.join(w)}</a>" if linked else " ".join(w)) + f"</{n}>" for n, w, linked in blocks)
        weight = {"word": 0.5, "link": 0.125, "<li>": -0.75, "</li>": -0.75, "<p>": -0.125, "</p>": -0.125, "<a>": -0.25, "</a>": -0.25}
        flat = []
        for n, w, linked in blocks:
            flat += [(weight[f"<{n}>"], "")] + [(weight["<a>"], "")] * linked
            flat += [(len(w) * weight["link" if linked else "word"], " ".join(w))] * bool(w)
            flat += [(weight["</a>"], "")] * linked + [(weight[f"</{n}>"], "")]
        a, b = region_by_hand([x for x, _ in flat])
        assert html_text.main_text(page, weight).split() == " ".join(t for _, t in flat[a:b]).split()


def test_best_region_is_the_best():
    draw = random.Random(1)
    for _ in range(200):
        scores = [draw.randint(-4, 4) for _ in range(draw.randint(0, 12))]
        a, b = html_text.best_region(scores)
        best = max([0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        assert sum(scores[a:b]) == best


def test_extract_hard_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (4, "u", "<p>" + "word " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in html_text.extract(pages).collect())
    assert [g[:2] for g in got[:2]] == [(1, 0), (2, 0)]
    assert all(n == k for _, n, k in got)
    assert got[4][1] == 5 * 50_000 - 1
    assert html_text.extract(pages.limit(0)).count() == 0


# Line dedup.


def test_repeated_passage_goes(spark):
    draw = random.Random(8)
    line = lambda: " ".join(f"v{draw.randrange(10**6)}" for _ in range(9))
    passage = [line() for _ in range(30)]
    rows = [(i, "\n".join([line() for _ in range(i % 7 + 1)] + passage + [line() for _ in range(5)]), "en", "s", 0) for i in range(12)]
    clean = [(100 + i, "\n".join(line() for _ in range(20)), "en", "s", 0) for i in range(5)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows + clean)).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].n_removed >= 24 for i in range(1, 12))
    assert all(got[i].text.split("\n")[0] == rows[i][1].split("\n")[0] for i in range(12))
    assert all(got[i].text == t for i, t, *_ in clean)


def test_line_dedup_matches_brute_force(spark):
    draw = random.Random(9)
    pool = ["\n".join(f"line number {draw.randrange(40)} of the pool" for _ in range(6)) for _ in range(10)]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(3)), "en", "s", 0) for i in range(40)]
    seen, want = set(), {}
    for i, text, *_ in rows:
        lines, kept = text.split("\n"), []
        for a, b in line_dedup.chunk_spans(lines):
            piece = "\n".join(lines[a:b])
            if b - a < 2 or not piece.strip() or piece not in seen:
                kept += lines[a:b]
            if b - a >= 2:
                seen.add(piece)
        want[i] = "\n".join(kept)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()} == want


def test_line_dedup_hard(spark):
    got = line_dedup.dedup_lines(hard(spark)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in HARD)
    assert line_dedup.dedup_lines(hard(spark).limit(0)).count() == 0


def passages_by_hand(rows):
    """Every run of two lines that are not all blank, and every line of over 50 words, that stands at an earlier place goes."""
    seen, want = set(), {}
    for i, text, *_ in sorted(rows):
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = "\n".join(lines[a:b])
                if (b - a >= 2 and run.strip()) or (b - a == 1 and len(run.split()) > 50):
                    if run in seen:
                        gone |= set(range(a, b))
                    seen.add(run)
        want[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return want


def test_short_lines_go_too(spark):
    rows = [(i, "\n".join(f"l{k}" for k in range(12)), "en", "s", 0) for i in range(3)] + [(9, "a\n\n\nb", "en", "s", 0), (10, "c\n\n\nd", "en", "s", 0)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_passages(docs(spark, rows)).collect()}
    assert got == {0: 0, 1: 12, 2: 12, 9: 0, 10: 0}
    assert all(r.n_removed == 0 for r in line_dedup.dedup_passages(docs(spark, rows), least_bytes=40).collect())


def test_passages_of_any_length_go_whole(spark):
    draw = random.Random(10)
    line = lambda n: " ".join(f"v{draw.randrange(10**6)}" for _ in range(n))
    rows = []
    for n, k in ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (60, 1)):
        for _ in range(5):
            passage = [line(k) for _ in range(n)]
            for _ in range(2):
                rows.append((len(rows), "\n".join([line(9), *passage, line(9)]), "en", "s", 0))
    rows.append((len(rows), rows[0][1].split("\n")[1], "en", "s", 0))
    short = ["", "a", "é", "x" * 39, "line of text"]
    rows += [(len(rows) + i, "\n".join(draw.choice(short) for _ in range(12)), "en", "s", 0) for i in range(30)]
    got = {r.doc_id: r for r in line_dedup.dedup_passages(docs(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == passages_by_hand(rows)
    assert all(got[i].n_lines - got[i].n_removed == (3 - 1 if i % 2 else got[i].n_lines) for i in range(60))
    hard_got = line_dedup.dedup_passages(hard(spark)).collect()
    assert Counter((r.doc_id, r.text) for r in hard_got) == Counter((r[0], r[1]) for r in HARD)
    assert line_dedup.dedup_passages(hard(spark).limit(0)).count() == 0


# Language model.


def scored_by_hand(texts, leave_one_out):
    grams = [Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)) for w in texts]
    every = sum(grams, Counter())
    total = sum(map(len, texts))
    out = []
    for w, own in zip(texts, grams, strict=True):
        c = lambda *g, own=own: every[g] - own[g] * leave_one_out
        s = 0.0
        for i, x in enumerate(w):
            value = math.log(max(c(x), 0.5) / max(total - len(w) * leave_one_out, 1))
            for n in (2, 3):
                if i >= n - 1:
                    g = tuple(w[i - n + 1 : i + 1])
                    value = math.log(c(*g) / max(c(*g[:-1]), 1)) if c(*g) > 0 else math.log(0.4) + value
            s += value
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("rows", [made_texts(120, 11), HARD, []], ids=["made", "hard", "empty"])
@pytest.mark.parametrize("leave", [False, True])
def test_lm_scores(spark, rows, leave):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, round(r.log_score, 4)) for r in lm_score.score(docs(spark, rows), leave_one_out=leave).collect())
    want = sorted((r[0] is None, r[0] or 0, n, round(s, 4)) for r, (n, s) in zip(rows, scored_by_hand([words(r[1]) for r in rows], leave), strict=True))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-6, abs_tol=1e-3) for g, w in zip(got, want, strict=True))


# Quality.


def test_quality_learns(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, " ".join(word().upper() + "!!" if bad and draw.random() < 0.7 else word() for _ in range(60)), "en", "s", 0))
        labels.append((i, int(not bad), 0))
    d, truth = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score(d, quality.train(d, truth)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    again = {r.doc_id: r.score for r in quality.score(d, quality.train(d, truth)).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_quality_hard(spark):
    truth = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    for labels in (truth, truth.limit(0)):
        got = quality.score(hard(spark), quality.train(hard(spark), labels)).collect()
        assert len(got) == len(HARD)
        assert all(0 <= r.score <= 1 for r in got)
    assert quality.score(hard(spark).limit(0), quality.train(hard(spark), truth)).count() == 0


# WARC.


def test_warc_round_trip(spark, tmp_path):
    payloads = {1: None, 2: "", 3: "same", 4: "same", 5: "a\r\n", 6: "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", 7: "é" * 5000 + "\r", 8: "\r" * 9 + "\n", 9: "same", 10: "a\nb\r\nc"}
    rows = [(i, f"http://x/{i}\n y", h) for i, h in payloads.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("k1", F.lit("clash"))
    for chunk in (64, 1 << 18):
        path = str(tmp_path / f"w{chunk}")
        got = {r.page_id: r for r in warc.archive(pages, path, chunk=chunk).collect()}
        assert set(got) == set(payloads)
        for i, h in payloads.items():
            raw = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), warc.digest32(hashlib.sha1(raw).digest()))
        assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 2, 3: 9, 4: 9}
        chunks = defaultdict(bytes)
        for r in warc.read_chunks(spark, path).where("record_type <> 'revisit'").orderBy("record_id", "chunk_no").collect():
            chunks[int(r.record_id)] += r.chunk
            assert len(r.chunk) <= chunk
        assert chunks == {i: (payloads[i] or "").encode() for i in payloads if i not in (1, 3, 4)}
    assert warc.archive(pages.limit(0), str(tmp_path / "none")).count() == 0
    twice = pages.where("page_id in (7, 10)").union(pages.where("page_id in (7, 10)"))
    assert Counter(r.page_id for r in warc.archive(twice, str(tmp_path / "twice"), chunk=64).collect()) == {7: 2, 10: 2}
    ids = [r[0] for r in spark.read.option("lineSep", "\r\n").text(str(tmp_path / "twice")).where("value like 'WARC-Record-ID: %'").collect()]
    assert len(ids) == len(set(ids)) > 4


def test_warc_holds_no_payload_twice():
    page = pa.array(["é" * (16 << 20)])
    full = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["u"]), page, pa.array([32 << 20]), pa.array(["x"]), pa.nulls(1, pa.int64()), pa.array([1])], names=list("abcdefg"))
    digest = pa.RecordBatch.from_arrays([pa.array([1]), page, pa.array([1]), pa.array([1])], names=list("abcd"))
    tracemalloc.start()
    seen = sum(len(v.as_py()) for b in warc._records(1 << 18)(iter([full])) for v in b.column(0))
    got = next(iter(warc._digests(iter([digest]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen > 16 << 20 and got.column(4)[0].as_py() == warc.digest32(hashlib.sha1("é".encode() * (16 << 20)).digest())
    assert peak < 12 << 20


# Top-k.


def best_by_hand(rows, k=5):
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(ints):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for m, (i, w) in enumerate(ints) if m != n)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("bucket", [16, 8192])
def test_top_k(spark, bucket, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=8).astype(np.float32) * (1 + i % 9)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [0.0] * 8), (None, [1.0] * 8)]
    rows += [(2300, [draw.normal() * 1e-3 for _ in range(8)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit("clash"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect())
    assert got == best_by_hand(rows)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame([(50, [400_000.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0**20, -3.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, 400_000 * 256 * 2**28 - 256 * 768), (1, 26_214_400_000)]
    for rows in ([(50, [2.0**60]), (1, [1.0])], [(50, [2.0**40]), (1, [2.0**40])]):
        with pytest.raises(Exception, match="beyond a long"):
            topk.top_k(frame(rows), F.col("vec_id") % 50 == 0).collect()


# Sharding.


def test_sharding_keeps_rows_and_versions(spark, tmp_path):
    rows = [(i, "x" * (i % 50), "en", "s", 0) for i in range(2000)]
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=60_000)
    for k in range(6):
        store.append(docs(spark, rows[k::6]).repartition(3), 40)
    before = store.shards()
    version = store.compact()
    after = store.shards()
    assert version > 6
    assert len(after) < len(before)
    assert Counter(r.doc_id for r in store.read().collect()) == Counter(range(2000))
    assert not store.merges_due(after)
    assert {r.doc_id for r in store.listing("doc_id").collect()} == set(range(2000))
    with pytest.raises(sharding.CommitConflict):
        store.commit(version - 1, after)
    assert store.version() == version
    assert Counter(r.doc_id for r in store.read(6).collect()) == Counter(range(2000))
    assert store.vacuum() == list(range(1, version))
    assert Counter(r.doc_id for r in store.read().collect()) == Counter(range(2000))


def test_sharding_hard(spark, tmp_path):
    store = sharding.shard(hard(spark), str(tmp_path / "a"), target=10_000, arrival_rows=2)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, hard(spark).collect()))
    assert sharding.shard(hard(spark).limit(0), str(tmp_path / "b")).listing("doc_id").count() == 0


# Decontamination.


def hits_by_hand(rows, items):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for i, t in items:
        w = split.findall((t or "").translate(LOW))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            wins[tuple(w[k : k + n])].add(str(i))
    out = []
    for r in rows:
        w = split.findall((r[1] or "").translate(LOW))
        hit, found = set(), set()
        for n in range(1, 14):
            for k in range(len(w) - n + 1):
                if got := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((r[0], len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


@pytest.mark.parametrize("case", ["made", "hard", "no items", "no rows"])
def test_decontamination(spark, case):
    draw = random.Random(21)
    items = [(i, " ".join(f"w{draw.randrange(60)}" for _ in range(draw.choice([1, 3, 12, 13, 14, 30]) if i % 4 else 20))) for i in range(12)] + [(50, None), (None, "w1 w2"), (51, "--"), (52, "one")]
    rows = HARD if case == "hard" else made_texts(80, 22, high=60)
    rows = [(r[0], (r[1] or "") + " " + (items[r[0] % 12][1].upper() if r[0] % 5 == 0 else ""), *r[2:]) for r in rows] if case == "made" else rows
    items = [] if case == "no items" else items
    rows = [] if case == "no rows" else rows
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    got = decontaminate.contamination(docs(spark, rows), bench).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == hits_by_hand(rows, items)


def test_decontamination_is_native(spark):
    plan = decontaminate.contamination(docs(spark, made_texts(9, 1)), spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# N-gram join.


def components_by_hand(rows):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    smallest = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            smallest[root(a)] = min(smallest.get(root(a), r[0]), r[0])
    return sorted(str((r[0], len(sets[a]), smallest.get(root(a)))) for a, r in enumerate(rows))


@pytest.mark.parametrize(("pairwise", "block"), [(64, 256), (1, 3)])
def test_ngram_join(spark, pairwise, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRWISE", pairwise)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    draw = random.Random(31)
    base = [f"b{i}" for i in range(70)]
    near = []
    for i in range(60):  # a group of near copies, some of which link to few
        copy = list(base)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(70)] = f"e{draw.randrange(10**6)}"
        near.append((500 + i, " ".join(copy), "en", "s", 0))
    rows = made_texts(120, 32) + near + [(900 + i, "Same text for all of these copies here", "en", "s", 0) for i in range(30)]
    got = sorted(str(tuple(r)) for r in ngram_join.similar_components(docs(spark, rows)).collect())
    assert got == components_by_hand(rows)


def test_ngram_join_tells_clashing_keys_apart(spark, monkeypatch):
    rows = made_texts(60, 33)
    plain = ngram_join._keys
    monkeypatch.setattr(ngram_join, "KEY_BITS", 4)
    got = sorted(str(tuple(r)) for r in ngram_join.similar_components(docs(spark, rows)).collect())
    assert got == components_by_hand(rows)
    monkeypatch.setattr(ngram_join, "_keys", lambda own, clashing: (7, plain(own, frozenset())[1]))
    with pytest.raises(RuntimeError, match="equal keys"):
        ngram_join.similar_components(docs(spark, rows))


@pytest.mark.parametrize("rows", [HARD, []], ids=["hard", "empty"])
def test_ngram_join_hard(spark, rows):
    assert sorted(str(tuple(r)) for r in ngram_join.similar_components(docs(spark, rows)).collect()) == components_by_hand(rows)


def test_suffix_bound_is_a_bound():
    draw = random.Random(3)
    for _ in range(300):
        a, b = (np.unique(np.array([draw.randrange(30) for _ in range(draw.randint(0, 20))], np.uint64)) for _ in range(2))
        assert ngram_join.suffix_bound(a, b) <= len(set(a.tolist()) ^ set(b.tolist()))


# Registered queries.


@needs_tables
def test_queries_match_sql(spark):
    from reportmill.llm import queries

    con = connection(SF)
    for name, sql in queries.ORACLE_SQL.items():
        same(queries.QUERIES[name](spark, SF), con, sql)
