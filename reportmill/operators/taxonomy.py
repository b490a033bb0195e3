"""Rule sets: ordered label patterns compiled to column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.text import once
from ..sources.tables import observed

NEEDS_REVIEW = "needs_review"


@dataclass(frozen=True)
class RuleSet:
    """Labels with their patterns, in order of priority."""

    rules: tuple[tuple[str, str], ...]
    default: str = NEEDS_REVIEW
    #: Patterns with a faster expression that is true of the same texts.
    tests: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict, compare=False)

    def matches(self, text: Column, pattern: str) -> Column:
        """Whether a pattern matches, by its faster expression if it has one."""
        return self.tests[pattern](text) if pattern in self.tests else text.rlike(pattern)

    def labels(self, text: Column) -> Column:
        """All labels that match, in rule order; a null text matches none."""
        return F.filter(F.array(*[F.when(self.matches(text, p), F.lit(n)) for n, p in self.rules]), lambda x: x.isNotNull())

    def label_string(self, text: Column) -> Column:
        """The labels joined by pipes, the default if none matches."""
        return once(self.labels(text), lambda found: F.when(F.size(found) == 0, F.lit(self.default)).otherwise(F.array_join(found, "|")))

    def primary(self, text: Column) -> Column:
        """The first label that matches, else the default."""
        return F.coalesce(*[F.when(self.matches(text, p), F.lit(n)) for n, p in self.rules], F.lit(self.default))

    def first_and_last(self, text: Column) -> Column:
        """(first, last): the label of highest and of lowest priority that match, each pattern tried once; use it with ``F.inline``.

        An array of one struct: expanding it is what keeps Spark from trying the
        patterns again for each column that is made of it.
        """
        default = F.lit(self.default)
        return F.transform(F.array(self.labels(text)), lambda m: F.struct(F.coalesce(F.get(m, F.lit(0)), default).alias("first"), F.coalesce(F.get(m, F.size(m) - 1), default).alias("last")))

    def any(self, text: Column, names: tuple[str, ...] | None = None) -> Column:
        """Whether one of the named rules, or any, matches."""
        out = F.lit(False)
        for n, p in self.rules:
            if names is None or n in names:
                out = out | F.coalesce(self.matches(text, p), F.lit(False))
        return out

    def count(self, text: Column, name: str) -> Column:
        """How often the patterns of one label occur."""
        found = [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for n, p in self.rules if n == name]
        return sum(found[1:], found[0])

    def reversed(self) -> RuleSet:
        """The same rules, lowest priority first."""
        return RuleSet(self.rules[::-1], self.default, self.tests)

    def names(self) -> tuple[str, ...]:
        """The labels in order, each once."""
        return tuple(dict.fromkeys(n for n, _ in self.rules))

    def table(self, spark: SparkSession) -> DataFrame:
        """(label, pattern, priority) rows."""
        return spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(self.rules)], "label string, pattern string, priority int")


def rule_set(table: DataFrame, default: str = NEEDS_REVIEW) -> RuleSet:
    """A rule set from (label, pattern, priority) rows, a small table by nature."""
    return RuleSet(tuple((r.label, r.pattern) for r in table.orderBy("priority").collect()), default)


# The published weak-label patterns of issue reports.
FAILURES = RuleSet((
    ("nan_inf", r"(?i)\b(nan|inf|infinite|nonfinite|non-finite)\b"),
    ("overflow_underflow", r"(?i)\b(over[- ]?flow|under[- ]?flow)\b"),
    ("precision_tolerance", r"(?i)\b(precision|rounding|tolerance|allclose|rtol|atol|wrong result|incorrect result|incorrect output|mismatch)\b"),
    ("dtype_casting", r"(?i)\b(dtype|data type|cast|casting|float16|float32|float64|bfloat16|bf16|fp16|fp32|fp64|int64|int32|complex64|complex128)\b"),
    ("crash_compile", r"(?i)\b(segfault|crash|assert|exception|compile error|compilation|fails to compile|error when compiling)\b"),
    ("performance_only", r"(?i)\b(slow|slower|performance|tflops|benchmark|regression)\b"),
))
CAUSES = RuleSet((
    ("memory_mask_bounds", r"(?i)\b(mask|out[- ]of[- ]bounds|boundary|stride|descriptor|pointer|offset|broadcast)\b"),
    ("compiler_codegen", r"(?i)\b(compiler|codegen|lowering|ptx|llvm|inductor|xla|nightly|fusion|fused|kernel generation)\b"),
    ("async_race_ordering", r"(?i)\b(async|synchroni[sz]e|race|stream|barrier|order|nondeterministic|deterministic)\b"),
    ("hardware_backend", r"(?i)\b(cuda|gpu|h100|h200|b200|a100|rtx|hopper|rocm|xla|mps|sm[0-9])\b"),
    ("reduction_accumulation", r"(?i)\b(reduction|sum|accumulat|softmax|attention|matmul|dot|exp|log)\b"),
))
TRUE_FAILURES = ["nan_inf", "overflow_underflow", "precision_tolerance", "dtype_casting", "crash_compile"]
FALSE_FAILURES = ["performance_only", "not_numerical_failure"]


def _word(words: str) -> str:
    return f"(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"


def _has_word(words: str) -> Callable[[Column], Column]:
    """``_word`` without a pass of its pattern over the text.

    A word between spaces settles most texts, a word that is nowhere in the text
    most others; what remains is a pattern for each word that begins with the
    word itself, so it fails at a text's other characters at once.
    """

    def test(text: Column) -> Column:
        out = None
        for w in words.split("|"):
            inside = F.contains(text, F.lit(w)) & text.rlike(f"{w}(?![A-Za-z0-9_])(?<![A-Za-z0-9_]{w})")
            out = F.contains(text, F.lit(f" {w} ")) | inside if out is None else out | F.contains(text, F.lit(f" {w} ")) | inside
        return out

    return test


LICENSE, CONTACT = "[Ll]icens", "[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]+"
_ENGLISH, _ROMANCE, _GERMAN = "the", "que|para|los|les|pour", "der|die|das|und|ist"
_ARTICLES, _LINKS, _PREPOSITIONS = "the|la|le|der|el", "and|et|und|y", "of|de|von|in|en"

#: A lexicon for prose in four languages; its patterns mean the same to Java and RE2.
PROSE = RuleSet(
    (("license_notice", LICENSE), ("contact_pii", CONTACT), ("english_prose", _word(_ENGLISH)), ("romance_prose", _word(_ROMANCE)), ("german_prose", _word(_GERMAN))),
    tests={
        LICENSE: lambda text: F.contains(text, F.lit("licens")) | F.contains(text, F.lit("Licens")),
        CONTACT: lambda text: F.contains(text, F.lit("@")) & text.rlike("@(?<=[A-Za-z0-9._]@)[A-Za-z0-9]+[.][a-z]"),
    } | {_word(w): _has_word(w) for w in (_ENGLISH, _ROMANCE, _GERMAN)},
)
PROSE_CAUSES = RuleSet(
    (("article_words", _word(_ARTICLES)), ("linking_words", _word(_LINKS)), ("preposition_words", _word(_PREPOSITIONS)), ("digits", "[0-9]")),
    tests={_word(w): _has_word(w) for w in (_ARTICLES, _LINKS, _PREPOSITIONS)},
)


@dataclass(frozen=True)
class Weighted:
    """A pattern of a label with its weight in title, body and comments, and the most that it earns in each (None: no limit)."""

    pattern: str
    weights: tuple[int, int, int]
    most: tuple[int | None, int | None, int | None] = (None, None, None)


# The published weights of the dtype label, whose plain tokens in code say little.
DTYPE_SYMPTOM_WEIGHTS, DTYPE_TOKEN_WEIGHTS, DTYPE_TOKEN_MOST = (6, 3, 1), (2, 1, 1), (None, 2, 1)


def weighted_scores(rules: RuleSet, title: Column, body: Column, comments: Column, weights: tuple[int, int, int] = (5, 2, 1), body_chars: int = 4000, comment_chars: int = 8000, special: dict[str, list[Weighted]] | None = None) -> Column:
    """array<struct<label, score>>: matches in three sections, weighted, in rule order.

    Labels in ``special`` are scored by their own weighted patterns instead.
    """
    sections = (title, F.substring(body, 1, body_chars), F.substring(comments, 1, comment_chars))
    parts = []
    for n in rules.names():
        own = (special or {}).get(n) or [Weighted(p, weights) for label, p in rules.rules if label == n]
        earned = []
        for w in own:
            for text, by, most in zip(sections, w.weights, w.most, strict=True):
                points = by * F.coalesce(F.regexp_count(text, F.lit(w.pattern)), F.lit(0))
                earned.append(points if most is None else F.least(points, F.lit(most)))
        parts.append(F.struct(F.lit(n).alias("label"), sum(earned[1:], earned[0]).cast("long").alias("score")))
    return F.array(*parts)


def penalised(scores: Column, label: str, bonus: int = 4, penalty: int = 3) -> Column:
    """A side label gains ``bonus`` if it stands alone and loses ``penalty``, to 0 at least, beside others."""
    others = F.aggregate(F.filter(scores, lambda s: s["label"] != label), F.lit(0).cast("long"), lambda a, s: a + s["score"])

    def one(s: Column) -> Column:
        mine = F.when((others == 0) & (s["score"] > 0), s["score"] + bonus).when(others > 0, F.greatest(s["score"] - penalty, F.lit(0))).otherwise(s["score"])
        return F.struct(s["label"].alias("label"), F.when(s["label"] == label, mine).otherwise(s["score"]).alias("score"))

    return F.transform(scores, one)


def score_of(scores: Column, label: str) -> Column:
    """The score of one label."""
    return F.element_at(F.filter(scores, lambda s: s["label"] == label), 1)["score"]


def ranked(scores: Column) -> Column:
    """struct<label, score> of the highest score, ties to the first label in the alphabet."""
    top = F.array_min(F.transform(scores, lambda s: F.struct((-s["score"]).alias("neg"), s["label"].alias("label"))))
    return F.struct(top["label"].alias("label"), (-top["neg"]).alias("score"))


def decide(rules: RuleSet, title: Column, body: Column, comments: Column, strong: tuple[str, ...], side: str, early: tuple[str, ...], discussion: str, phrases: str, phrase_label: str, early_chars: int = 1200, special: dict[str, list[Weighted]] | None = None) -> Column:
    """struct<label, confidence> by a decision list over title, early text and ranked scores.

    In order: a strong label in the title; the side label in the title alone; a
    discussion title; a phrase in the title; early labels with a score of 3; a
    phrase early on; the ranked scores.
    """
    scores = penalised(weighted_scores(rules, title, body, comments, special=special), side)
    start = F.concat(title, F.lit("\n"), F.substring(body, 1, early_chars))
    pick = lambda label, confidence: F.struct(F.lit(label).alias("label"), confidence.alias("confidence"))
    grade = lambda label, least: F.when(score_of(scores, label) >= least, F.lit("high")).otherwise(F.lit("medium"))
    out = None

    def add(condition: Column, value: Column) -> None:
        nonlocal out
        out = F.when(condition, value) if out is None else out.when(condition, value)

    for n in strong:
        add(rules.any(title, (n,)), pick(n, grade(n, 5)))
    add(rules.any(title, (side,)), pick(side, grade(side, 5)))
    add(title.rlike(discussion), pick(side, F.lit("medium")))
    add(title.rlike(phrases), pick(phrase_label, grade(phrase_label, 5)))
    for n in early:
        add(rules.any(start, (n,)) & (score_of(scores, n) >= 3), pick(n, grade(n, 6)))
    add(start.rlike(phrases), pick(phrase_label, F.lit("medium")))
    top = ranked(scores)
    rest = lambda label, confidence: F.struct(label.alias("label"), F.lit(confidence).alias("confidence"))
    side_grade = F.struct(top["label"].alias("label"), F.when(top["score"] >= 4, "medium").otherwise("low").alias("confidence"))
    return (
        out.when(top["score"] == 0, rest(F.lit(rules.default), "low"))
        .when(top["label"] == side, side_grade)
        .when(top["score"] >= 6, rest(top["label"], "high"))
        .when(top["score"] >= 2, rest(top["label"], "medium"))
        .otherwise(rest(F.lit(rules.default), "low"))
    )


def evidence(pattern: str, text: Column, before: int = 180, after: int = 220, limit: int = 420) -> Column:
    """The text around the first match, white space normalised, at most ``limit`` characters; empty without a match."""
    from ..functions.text import squash

    hit = F.regexp_extract(text, f"({pattern})", 1) if not pattern.startswith("(?i)") else F.regexp_extract(text, f"(?i)({pattern[4:]})", 1)
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - 1 - before, F.lit(0))
    stop = F.least(at - 1 + F.length(hit) + after, F.length(text))
    return F.when(at > 0, F.substring(squash(F.substr(text, start + 1, stop - start)), 1, limit)).otherwise("")


def candidate_aware(label: Column, confidence: Column, candidate: Column, rules: RuleSet, text: Column) -> Column:
    """struct<label, confidence>: a strict label stands; else a candidate, medium if its rule matches the text."""
    confirmed = F.lit(False)
    for n in rules.names():
        confirmed = confirmed | ((candidate == n) & rules.any(text, (n,)))
    pair = lambda a, b: F.struct(a.alias("label"), b.alias("confidence"))
    return (
        F.when(confidence.isin("high", "medium") & (label != rules.default), pair(label, confidence))
        .when(confirmed, pair(candidate, F.lit("medium")))
        .when(~candidate.isin(rules.default, ""), pair(candidate, F.lit("low")))
        .otherwise(pair(label, confidence))
    )


def repair(label: Column, secondary: Column, allowed: list[str], moves: dict[str, tuple[str, str | None]], guess: Column) -> Column:
    """struct<label, secondary, rule>: labels outside the vocabulary move to an allowed one.

    ``moves`` maps a known stray label to (label, cause to append); any other
    one takes ``guess``.
    """
    plain = F.when(F.trim(secondary) == "", "unknown").otherwise(secondary)
    out = F.when(label.isin(allowed), F.struct(label.alias("label"), plain.alias("secondary"), F.lit("unchanged").alias("rule")))
    for stray, (target, cause) in moves.items():
        added = plain if cause is None else F.array_join(F.array_distinct(F.concat(F.filter(F.split(F.replace(secondary, F.lit(","), F.lit("|")), r"\|"), lambda x: F.trim(x) != ""), F.array(F.lit(cause)))), "|")
        out = out.when(label == stray, F.struct(F.lit(target).alias("label"), added.alias("secondary"), F.lit(f"{stray}_to_{target}").alias("rule")))
    return out.otherwise(F.struct(guess.alias("label"), plain.alias("secondary"), F.concat(label, F.lit("_to_"), guess).alias("rule")))


def violations(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Values outside a vocabulary with their counts."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(vocabulary)).groupBy(column).agg(F.count("*").alias("n"))


def validate(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """``df`` itself; raises ValueError that lists the first offending values if there are any."""
    bad = violations(df, column, vocabulary).orderBy(column).limit(20).collect()
    if bad:
        raise ValueError(f"{column} holds " + ", ".join(f"{r[0]!r} ({r.n} rows)" for r in bad))
    return df


def checked(df: DataFrame, column: str, vocabulary: list[str]) -> tuple[DataFrame, Observation]:
    """(rows, counts): ``df``, and how many of its values lie outside the vocabulary (``invalid``), counted in the pass that reads it."""
    return observed(df, invalid=F.col(column).isNull() | ~F.col(column).isin(vocabulary))
