"""The divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reportmill.llm import divergence

from .test_operators import LOW, SF, docs, hard, needs_tables
from ..helpers import connection, same

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs=10):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s, _ in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOW))
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(own, kept=kept):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, scored, most in (("pair", pairs, None), ("term", terms, 10)):
                for rank, (v, item) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


def made(seed=2, n=400):
    draw = random.Random(seed)
    vocabulary = ["Alpha", "beta", "ÉÈ", "é", "x-y", "naïve", "日本", "a_b", "c1d", *[f"{a}{b}" for a in "abcdef" for b in "ghij"]]
    rows = []
    for i in range(n):
        lang = draw.choice(["en", "en", "de", None, "fr"])
        source = draw.choice(["s1", "s2", "s3", None, "s5", "s6", "é"])
        text = " ".join(draw.choice(vocabulary[: 10 + 3 * (len(lang or "") % 5)] if lang != "fr" else ["only", "1 2"]) for _ in range(draw.randint(0, 12)))
        rows.append((i, draw.choice([text, text, text, None, ""]), lang, source, 0))
    return [*rows, (n, "lonely words here", "it", "s1", 0), (n + 1, None, "it", "s2", 0), (n + 1, None, "it", "s2", 0), (n + 2, "x", "pt", "s1", 0)]


@pytest.mark.parametrize(("block", "chunk"), [(512, 128), (3, 2), (1, 1)])
def test_brute_force(spark, block, chunk):
    rows = made()
    got = sorted(tuple(r) for r in divergence.audit(docs(spark, rows), block=block, chunk=chunk).collect())
    assert got == brute(rows)


def test_shares_are_exact():
    draw = random.Random(1)
    for _ in range(300):
        terms, total = draw.randint(1, 10**6), draw.randint(0, 10 ** draw.randint(1, 15))
        count = draw.randint(0, total)
        got = divergence.shares(np.array([count]), total, terms)
        assert int(got[0]) == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def test_long_text_is_split_in_pieces():
    text = ("Word é-x " * 300_000).encode()
    parts = list(divergence._pieces(text))
    assert len(parts) > 2 and Counter(w for p in parts for w in p) == Counter({b"word": 300_000, "é".encode(): 300_000, b"x": 300_000})


def test_hard_cases(spark):
    rows = [tuple(r) for r in hard(spark).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(tuple(r) for r in divergence.audit(hard(spark), least_docs=1).collect()) == brute(rows, 1)
    assert divergence.audit(hard(spark).limit(0)).collect() == []
    assert divergence.audit(hard(spark)).where("part = 'term'").collect() == []


@needs_tables
def test_against_sql(spark):
    same(divergence.audit(spark.read.parquet(f"{SF}/documents.parquet")), connection(SF), divergence.ORACLE)
