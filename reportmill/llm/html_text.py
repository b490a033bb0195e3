"""Main text of web pages by maximum-scoring subsequence.

A page is a row of tokens: words score positive, tags negative, words and tags
inside menus, notices and the like nothing, as they are left out anyway.  The
weights are log-odds from labelled pages, those whose own markup names one main
region; a tag costs a part of a word at most, so that a block of one word earns
more than its own tags cost.  One linear scan finds the contiguous region of
highest sum; its text, without what belongs to other parts of the page, is the
main text.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .workspace import bound_batches

#: Labelled pages that the weights are taken from, at most.
SAMPLE = 400

# Element names of HTML, and words that mark parts of a page in class, id and role.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
RAW = "script style textarea title noscript template iframe svg math object select button".split()
OTHER_PARTS = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role attributes: such as stand for other parts, such as do so only by themselves, for content, and before a feature of the page.
PART_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription login signup recommended comment comments commentlist disqus replies reply pagination pager complementary contentinfo".split())
WEAK_WORDS = frozenset("header banner share sharing social related respond widget toolbar copyright search skip".split())
CONTENT_WORDS = frozenset("article content entry main post story text body results page blog".split())
FEATURES = frozenset("has with without no is".split())
READERS = frozenset("comment comments commentlist disqus replies reply".split())

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"'<]")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = "/part"
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
STYLE = re.compile(r"\bstyle\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Elements that a form, or a part named by its class, holds only if it is the layout of a page; blocks that a menu which isn't closed ends at.
LAYOUT = {"form": frozenset("main article h1 header footer nav aside".split()), "class": frozenset(("main", "h1"))}
NEXT_BLOCKS = frozenset("address article aside blockquote div figure footer form h1 h2 h3 h4 h5 h6 header main p pre section table".split())
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
#: Words of a closing line of rights, at most.
RIGHTS_WORDS = 40

TEXT, TAG = 0, 1
#: Weights where no page is labelled.
DEFAULTS = {"word": 0.6, "link": 0.1, "part": 0.0}
#: The most that a block or an inline tag costs, as a share of what a word earns.
BLOCK_SHARE, INLINE_SHARE = 0.2, 0.05


def class_words(rest: str) -> list[list[str]]:
    """The words of each name in the class, id and role of a tag, without names such as has-sidebar."""
    found = []
    for groups in ATTRIBUTE.findall(rest) if "=" in rest else ():
        for name in "".join(groups).split():
            split = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            if split and split[0] not in FEATURES:
                found.append(split)
    return found


def _prior(word: str) -> float:
    return -2.0 if word in PART_WORDS else -1.0 if word in WEAK_WORDS else 1.0 if word in CONTENT_WORDS else 0.0


def _unseen(rest: str) -> bool:
    """Whether the attributes hide an element."""
    styles = STYLE.findall(rest) if "=" in rest else ()
    return any(UNSEEN.search("".join(x)) for x in styles) or bool(HIDDEN.search(STYLE.sub(" ", ATTRIBUTE.sub(" ", rest))))


def _part(name: str, rest: str, in_main: bool, weight: dict[str, float]) -> str:
    """Why an element is a menu, notice or another part that is not main text: element, form, readers, class, or empty if it isn't."""
    if name not in ("body", "html") and rest and _unseen(rest):
        return "hidden"
    if name in ("article", "main", "body", "html"):
        return ""
    if name == "form":
        return "form"
    if name in OTHER_PARTS or (name == "header" and not in_main):
        return "element"
    for split in class_words(rest):
        if not (in_main and split == ["header"]) and sum(weight.get(f".{w}", _prior(w)) for w in split) < 0:
            return "class" if READERS.isdisjoint(split) else "readers"
    return ""


class _Scan:
    """Tags of a page in one pass; what isn't there is looked for once only."""

    def __init__(self, page: str):
        self.page, self.lost = page, set()
        self.edges: dict[str, list[tuple[int, int, int]]] = {}
        self.low = page.lower() if page.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), page)

    def find(self, what: str, at: int) -> int:
        """Where ``what`` is next, -1 if nowhere."""
        if what in self.lost:
            return -1
        found = self.low.find(what, at)
        if found < 0:
            self.lost.add(what)
        return found

    def is_closed(self, name: str, at: int) -> bool:
        """Whether the element ``name`` that is open at ``at`` has an end tag of its own further on."""
        if name not in self.edges:  # places of its tags with the depth after each, once for a page
            depth, tags = 0, []
            for m in re.finditer(rf"<(/?){re.escape(name)}(?![a-z0-9:-])", self.low):
                depth += -1 if m[1] else 1
                tags.append((m.start(), -depth))
            low = [0] * (len(tags) + 1)  # the least depth from each tag on
            low[-1] = 1 << 60
            for i in range(len(tags) - 1, -1, -1):
                low[i] = min(low[i + 1], -tags[i][1])
            self.edges[name] = [(place, -depth, least) for (place, depth), least in zip(tags, low, strict=False)]
        tags = self.edges[name]
        i = bisect_left(tags, (at,))
        return i < len(tags) and tags[i][2] < (tags[i - 1][1] if i else 1)

    def tag_end(self, at: int) -> tuple[int, bool]:
        """(end of the attributes, whether the tag is closed); a tag that isn't ends at the next one."""
        i = at
        while stop := STOP.search(self.page, i):
            i, mark = stop.end(), stop[0]
            if mark == ">":
                return stop.start(), True
            if mark == "<":
                return stop.start(), False
            if self.page[at : stop.start()][-8:].rstrip().endswith("="):
                close = self.find(mark, i)
                i = close + 1 if close >= 0 else i
        return len(self.page), False


def tokens(page: str, weight: dict[str, float] | None = None) -> list[list]:
    """[kind, value, in a link, in another part, in the named main region, class words] for every text run and tag.

    An element that is not closed ends with the one around it.  Before any
    article a part without an end tag ends where one begins, and a menu at the
    next block.  An article inside a part
    that is named by its class ends that part, if it is the page's first; readers'
    comments never end so.  A form, or a part named by its class, that holds the
    layout of a page or all its words, is none.
    """
    scan, weight = _Scan(page), weight or {}
    out: list[list] = []
    stack: list[tuple[str, int, str]] = []  # name, its tag's place in ``out``, why it is a part
    held: Counter = Counter()
    spans: list[tuple[int, int, str]] = []
    link = at = articles = 0

    def text(piece: str) -> None:
        piece = html.unescape(piece) if "&" in piece else piece
        if out and out[-1][0] == TEXT:
            out[-1][1].append(piece)
        elif piece:
            out.append([TEXT, [piece], link > 0, False, False, ()])

    def close() -> None:
        name, begin, why = stack.pop()
        held[name] -= 1
        held[PART] -= bool(why)
        held[why] -= bool(why)
        if why or name in ("article", "main"):
            spans.append((begin, len(out), why or name))

    while at < len(page):
        tag = scan.find("<", at)
        if tag < 0:
            text(page[at:])
            break
        if tag > at:
            text(page[at:tag])
        m = NAME.match(page, tag)
        if page.startswith("<!--", tag):
            end = scan.find("-->", tag + 4)
            at = end + 3 if end >= 0 else len(page)
        elif not m:
            end = scan.find(">", tag) if page[tag + 1 : tag + 2] in ("!", "?") else -1
            if end < 0:
                text("<")
            at = end + 1 if end >= 0 else tag + 1
        else:
            name = m[2].lower()
            end, closed = scan.tag_end(m.end())
            rest, at = page[m.end() : end], end + closed
            if not closed:
                continue
            if name == "a":
                link = 0 if m[1] else 1
            if name in RAW and not m[1] and not rest.endswith("/"):
                out.append([TAG, name, False, True, False, ()])
                end = scan.find(f"</{name}", at)
                at = end if end >= 0 else len(page)
                if end >= 0:
                    end, closed = scan.tag_end(at + 2 + len(name))
                    at = end + closed
                continue
            if m[1]:
                out.append([TAG, "/" + name, False, False, False, ()])
                if held[name]:
                    while stack[-1][0] != name:
                        close()
                    close()
                continue
            if held["element"] and not articles and name in NEXT_BLOCKS:
                top = next(x for x in reversed(stack) if x[2] == "element")
                if (top[0] in ("nav", "menu") or name in ("article", "main")) and not scan.is_closed(top[0], tag):
                    while stack[-1] is not top:
                        close()
                    close()
            if name in ("article", "main"):
                if held["class"] and not articles and not held["readers"] and not held["element"]:
                    while held["class"]:
                        close()
                articles += not held[PART]
            found = class_words(rest)
            out.append([TAG, name, False, False, False, tuple(dict.fromkeys(w for x in found for w in x))])
            if name not in VOID and not rest.endswith("/"):
                why = _part(name, rest, held["article"] + held["main"] > 0, weight)
                stack.append((name, len(out) - 1, why))
                held[name] += 1
                held[PART] += bool(why)
                held[why] += bool(why)
    while stack:
        close()
    for t in out:
        if t[0] == TEXT:
            t[1] = "".join(t[1])
    upto = {why: [0, *accumulate(int(t[0] == TAG and t[1] in names) for t in out)] for why, names in LAYOUT.items()}
    spans = [(begin, end, why) for begin, end, why in spans if why not in LAYOUT or upto[why][end] == upto[why][begin + 1]]
    parts = ("element", "hidden", "readers", "form", "class")
    for left_out in (parts, parts[:4], parts[:3]):  # of a page with nothing else a part named by its class, then a form, is the text
        depths = _depths(spans, left_out, len(out))
        if any(t[0] == TEXT and not d and not t[1].isspace() for t, d in zip(out, depths, strict=False)):
            break
    else:
        depths = _depths(spans, parts, len(out))
    for t, part, main in zip(out, depths, _depths(spans, ("article", "main"), len(out)), strict=False):
        t[3], t[4] = t[3] or part > 0, main > 0
    return out


def _depths(spans: list[tuple[int, int, str]], named: tuple[str, ...], n: int) -> list[int]:
    """In how many spans of these names each of ``n`` tokens lies."""
    change = [0] * (n + 1)
    for begin, end, why in spans:
        if why in named:
            change[begin] += 1
            change[end] -= 1
    return list(accumulate(change))


def _kind(token: list) -> str:
    if token[3]:
        return "part"
    if token[0] == TAG:
        name = token[1]
        bare = name.removeprefix("/")
        return f"<{name}>" if bare in BLOCKS or bare in INLINE or bare in RAW or bare in VOID else "<other>"
    return "link" if token[2] else "word"


def count_kinds(page: str) -> Counter:
    """(kind, inside) counts of a labelled page; empty if the page names no main region or several."""
    found = tokens(page)
    if sum(t[0] == TAG and t[1] in ("article", "main") for t in found) != 1 or not any(t[4] for t in found):
        return Counter()
    counts: Counter = Counter()
    for t in found:
        edge = t[0] == TAG and t[1].removeprefix("/") in ("article", "main")
        counts[_kind(t), t[4] and not edge] += len(t[1].split()) if t[0] == TEXT else 1
        for word in () if edge else t[5]:
            counts["." + word, t[4]] += 1
    return counts


def _most(kind: str, weight: dict[str, float]) -> float:
    """What a tag costs at most."""
    return weight["word"] * (INLINE_SHARE if kind.strip("</>") in INLINE else BLOCK_SHARE)


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of each kind of token inside the main region, held above 0 for words and a little below 0 for tags."""
    inside, outside = (sum(n for (k, i), n in counts.items() if i == side and k[0] != ".") for side in (True, False))
    out = dict(DEFAULTS)
    if not inside or not outside:
        return out
    odds = {k: math.log((counts.get((k, True), 0) + 0.5) / (inside + 1)) - math.log((counts.get((k, False), 0) + 0.5) / (outside + 1)) for k, _ in counts}
    if "word" in odds:
        out["word"] = max(0.1, min(2.0, odds["word"]))
    if "link" in odds:
        out["link"] = max(0.05, min(0.3, odds["link"]))
    for kind in odds:
        if kind.startswith("."):
            out[kind] = _prior(kind[1:]) + max(-2.0, min(2.0, math.log((counts.get((kind, True), 0) + 1) / (counts.get((kind, False), 0) + 1))))
        elif kind.startswith("<"):
            most = _most(kind, out)
            out[kind] = min(-0.2 * most, max(-most, odds[kind]))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of highest sum, the longer one of equals; empty if no score is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and i + 1 - start > bounds[1] - bounds[0]):
            best, bounds = total, (start, i + 1)
    return bounds


def _drop_rights(found: list[list], taken: list[bool]) -> None:
    """Take a last block that is a line of rights out of what is taken."""
    last, words = [], []
    for i in range(len(found) - 1, -1, -1):
        t = found[i]
        if taken[i] and t[0] == TEXT and not t[3]:
            last.append(i)
            words = t[1].split() + words
        elif words and t[0] == TAG and t[1].removeprefix("/") not in INLINE:
            break
        if len(words) > RIGHTS_WORDS:
            return
    else:
        return  # the whole page is one block
    if words and RIGHTS.match(" ".join(words)):
        for i in last:
            taken[i] = False


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The main text of a page; empty for a page without words."""
    found = tokens(page or "", weight)
    scores = []
    for t in found:
        kind = _kind(t)
        if t[3]:
            scores.append(0.0)
        elif t[0] == TEXT:
            scores.append(weight[kind] * len(t[1].split()))
        else:
            scores.append(weight[kind] if kind in weight else -_most(kind, weight))
    a, b = best_region(scores)
    taken = [a <= i < b for i in range(len(found))]
    # Of an article in several parts each that earns more than its tags cost is main text.
    begin = depth = 0
    for i, t in enumerate(found):
        if t[0] == TAG and t[1] in ("article", "/article") and not t[3]:
            if t[1] == "article":
                begin = begin if depth else i
                depth += 1
            elif depth:
                depth -= 1
                if not depth and any(taken) and sum(scores[begin:i]) > 0:
                    taken[begin : i + 1] = [True] * (i + 1 - begin)
    # Beside a named main region, links outside it are a menu.
    if any(t[4] and taken[i] for i, t in enumerate(found)):
        taken = [x and (t[4] or not t[2]) for x, t in zip(taken, found, strict=True)]
    _drop_rights(found, taken)
    pieces = []
    for i, t in enumerate(found):
        if not taken[i]:
            if i and taken[i - 1]:
                pieces.append(" ")
        elif t[0] == TEXT:
            if not t[3]:
                pieces.append(t[1])
        elif t[1].removeprefix("/") not in INLINE:
            pieces.append(" ")
    return " ".join("".join(pieces).split())


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` pages that name a main region, those of smallest id hash.

    Defined cases: null and empty pages teach nothing; of equal ids the smaller
    page comes first; repeated rows count each; without any labelled page the
    weights are DEFAULTS; other columns are ignored.
    """
    bound_batches(pages.sparkSession, rows=200)
    named = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)\b")).select(F.xxhash64(id_col).alias("h"), F.col(html_col).alias("html"))
    chosen = named.orderBy("h", "html").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(1):
                counts.update(count_kinds(page.as_py() or ""))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "inside", "n"])

    rows = chosen.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights({(r.kind, r.inside): r.n for r in rows.collect()})  # a row for each HTML element name at most


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row per page: (id_col, url_col, text, n_chars).

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by one space.

    Defined cases: a null or empty page, or one without words outside other
    parts, has the empty text; an element that is never closed ends with the one
    around it, an unclosed tag at the next tag, an unclosed comment or script at
    the end of the page; time is in proportion to the page's length; repeated rows give repeated
    rows; an empty table gives an empty result; other columns are ignored.
    """
    weight = learn(pages, id_col, html_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), weight).encode("utf-8", "replace").decode() for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["a", "b", "text", "n_chars"])

    taken = pages.select(F.col(id_col).alias("a"), F.col(url_col).alias("b"), F.col(html_col).cast("string").alias("c"))
    kinds = [taken.schema[i].dataType.simpleString() for i in range(2)]
    out = taken.mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}, text string, n_chars long")
    return out.select(F.col("a").alias(id_col), F.col("b").alias(url_col), "text", "n_chars")
