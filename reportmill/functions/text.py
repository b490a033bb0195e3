"""Scalar text functions as column expressions; none needs Python at run time.

A null input gives a null output unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The published token and url patterns.
TOKEN_A = r"([A-Za-z_][A-Za-z_0-9]{1,}|[0-9]+)"
TOKEN_B = r"([a-zA-Z_][a-zA-Z0-9_+\-.]{1,})"
PULL_URL = r"https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/pull/[0-9]+"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(text: Column) -> Column:
    """Runs of Unicode white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def ellipsis(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three being dots if anything was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def excerpt(text: Column, limit: int, mark: str = " ... [truncated]") -> Column:
    """At most about ``limit`` characters with ``mark`` after a cut, white space before it removed."""
    cut = F.regexp_replace(F.substring(text, 1, limit - 15), r"\s+$", "")
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(mark))).otherwise(text)


def head_and_tail(text: Column, limit: int, head_share: float = 0.72, mark: str = "\n...\n") -> Column:
    """The first ``head_share`` and the rest from the end of a text longer than ``limit``."""
    head = int(limit * head_share)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(limit - head)))).otherwise(text)


def tokens_a(text: Column, limit: int | None = None) -> Column:
    """Identifiers of two or more characters and runs of digits, lower-cased after they are found."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN_A), 1), F.lower)
    return F.slice(found, 1, limit) if limit else found


def tokens_b(text: Column, longest: int = 40) -> Column:
    """Dotted and dashed identifiers of at most ``longest`` characters, lower-cased."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(TOKEN_B), 1), F.lower), lambda t: F.length(t) <= longest)


def bigrams(tokens: Column, joint: str = "__") -> Column:
    """Adjacent pairs of tokens."""
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(joint), b))).otherwise(F.array().cast("array<string>"))


def terms(tokens: Column, with_bigrams: bool) -> Column:
    """Tokens, and after them their bigrams if asked."""
    return F.concat(tokens, bigrams(tokens)) if with_bigrams else tokens


def issue_number(url: Column) -> Column:
    """The last path element of a url."""
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def owner_repo(url: Column) -> Column:
    """owner/repo of a url, empty if there is none."""
    return F.regexp_extract(url, r"https?://[^/]+/([^/?#]+/[^/?#]+)", 1)


def file_stem(repository: Column, url: Column) -> Column:
    """owner__repo__number, the stem of a context file."""
    return F.concat(F.replace(repository, F.lit("/"), F.lit("__")), F.lit("__"), issue_number(url))


def pull_urls(text: Column, first: int) -> Column:
    """The first ``first`` of the sorted distinct pull request urls."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({PULL_URL})"), 1))), 1, first)


def issue_refs(text: Column) -> Column:
    """Numbers of references like #123 that follow no word character or slash."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\w/])#([0-9]+)"), 1)


def commit_refs(text: Column) -> Column:
    """Hexadecimal commit references."""
    return F.regexp_extract_all(text, F.lit(r"\b([0-9a-f]{7,40})\b"), 1)


def pull_urls_of(repository: Column, refs: Column) -> Column:
    """Pull request urls in the own repository for reference numbers, sorted as strings."""
    return F.array_sort(F.array_distinct(F.transform(refs, lambda r: F.concat(F.lit("https://github.com/"), repository, F.lit("/pull/"), r))))


def fenced_diff(text: Column) -> Column:
    """The first fenced diff or patch block, else the first diff header to the end of its hunk; empty if none."""
    fenced = F.regexp_extract(text, r"(?is)```(?:diff|patch)\s(.*?)```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(diff --git .*?)(?:\n\n|\z)", 1))


def changed_files(diff: Column) -> Column:
    """Sorted distinct paths of a unified diff's new side."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git a/(.*?) b/(.*?)$"), 2)))


def clean_urls(piped: Column) -> Column:
    """Valid urls of a pipe-joined list, trailing punctuation removed."""
    found = F.transform(F.split(piped, r"\|"), lambda u: F.regexp_replace(F.trim(u), r"[.,)]+$", ""))
    return F.filter(found, lambda u: u.rlike(r"^https?://"))


def label_list(piped: Column) -> Column:
    """Labels of a pipe-joined set; blank entries are left out, null is empty."""
    return F.filter(F.transform(F.split(F.coalesce(piped, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def json_value(text: Column) -> Column:
    """The JSON object or list in a model's answer: without fences, else from the first brace or bracket to its last; null if none parses."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```[a-zA-Z]*|```\s*$", " "))
    pieces = [bare, F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.regexp_extract(bare, r"(?s)(\[.*\])", 1)]
    fine = [F.when(p.rlike(r"^[\[{]") & F.try_parse_json(p).isNotNull(), p) for p in pieces]
    braces_first = F.instr(bare, "[") == 0
    both = (F.instr(bare, "{") > 0) & (braces_first | (F.instr(bare, "{") < F.instr(bare, "[")))
    return F.coalesce(fine[0], F.when(both, F.coalesce(fine[1], fine[2])).otherwise(F.coalesce(fine[2], fine[1])))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer; null if there is none."""
    found = json_value(text)
    return F.when(found.startswith("{"), found)


def normal_prediction(answer: Column, labels: list[str], causes: list[str], default: str = "needs_review") -> Column:
    """struct<label, causes, true_failure, quote, confidence> of a prediction's JSON object, every field held to its vocabulary.

    Causes come as a list or as a string joined by pipes or commas, truth as a
    boolean or a word, confidence as a number, a boolean or a word.
    """
    names = ("primary_failure_label", "secondary_cause_labels", "is_true_numerical_failure", "evidence_quote", "confidence")
    field = lambda n: F.coalesce(F.get_json_object(json_object(answer), f"$.{n}"), F.lit(""))
    label, cause, truth, quote, confidence = (field(n) for n in names)
    listed = F.when(cause.startswith("["), F.from_json(cause, "array<string>")).otherwise(F.split(F.replace(cause, F.lit(","), F.lit("|")), r"\|"))
    kept = F.array_distinct(F.filter(F.transform(listed, lambda c: F.trim(c)), lambda c: c.isin(causes)))
    word = F.lower(F.trim(truth))
    return F.struct(
        F.when(F.trim(label).isin(labels), F.trim(label)).otherwise(default).alias("label"),
        F.when(F.size(kept) > 0, F.array_join(kept, "|")).otherwise("unknown").alias("causes"),
        F.when(word.isin("true", "yes"), "yes").when(word.isin("false", "no"), "no").otherwise("unclear").alias("true_failure"),
        F.substring(quote, 1, 500).alias("quote"), confidence_word(confidence).alias("confidence"),
    )


def hash_bucket(key: Column, buckets: int) -> Column:
    """The first 32 bits of the SHA-256 digest, modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % buckets


def stable_order(key: Column, salt: str) -> Column:
    """A fixed pseudo-random sort key."""
    return F.sha2(F.concat(F.lit(f"{salt}|"), key), 256)


def stable_id(prefix: str, number: Column, key: Column) -> Column:
    """prefix-0001-<first 8 hex digits of the key's SHA-1>; numbers of more than four digits stay whole."""
    digits = number.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")), F.lit("-"), F.substring(F.sha1(key.cast("binary")), 1, 8))


def truth_value(label: Column, true_labels: list[str], false_labels: list[str]) -> Column:
    """yes, no or unclear for a label."""
    return F.when(label.isin(false_labels), "no").when(label.isin(true_labels), "yes").otherwise("unclear")


def confidence_word(value: Column) -> Column:
    """high, medium or low for a number, a boolean or a word; low for anything else."""
    number = value.try_cast("double")
    word = F.lower(F.trim(value))
    return F.when(word.isin("high", "medium", "low"), word).when(word == "true", "high").when(number >= 0.75, "high").when(number >= 0.4, "medium").otherwise("low")
