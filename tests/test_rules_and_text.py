"""Rules, tokens and text functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from reportmill.functions import text as tx
from reportmill.operators import taxonomy
from reportmill.operators.taxonomy import CAUSES, FAILURES

LEXICON = [
    ("NaN in softmax on GPU", "nan_inf", "nan_inf", "hardware_backend|reduction_accumulation"),
    ("overflow when casting to float16", "overflow_underflow|dtype_casting", "overflow_underflow", "needs_review"),
    ("inference is slow on A100", "performance_only", "performance_only", "hardware_backend"),
    ("wrong result: allclose fails, rtol mismatch", "precision_tolerance", "precision_tolerance", "needs_review"),
    ("docs typo", "needs_review", "needs_review", "needs_review"),
    ("Over-flow in int32 sum; segfault in compiler", "overflow_underflow|dtype_casting|crash_compile", "overflow_underflow", "compiler_codegen|reduction_accumulation"),
    ("accumulation order is nondeterministic", "needs_review", "needs_review", "async_race_ordering"),
    ("matmul accumulat error", "needs_review", "needs_review", "reduction_accumulation"),
    ("sm_70 build", "needs_review", "needs_review", "needs_review"),
    ("xla fusion drops mask", "needs_review", "needs_review", "memory_mask_bounds|compiler_codegen|hardware_backend"),
]


def test_lexicon(spark):
    df = spark.createDataFrame([(t,) for t, *_ in LEXICON], "t string")
    got = df.select("t", FAILURES.label_string(F.col("t")), FAILURES.primary(F.col("t")), CAUSES.label_string(F.col("t"))).collect()
    assert [tuple(r) for r in got] == LEXICON


def one(spark, column, **values):
    kinds = {str: "string", int: "long"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_tokens(spark):
    text = "a NaN_val x1 7 éclair fp16-float 10.5e3 _z"
    assert one(spark, tx.tokens_a(F.col("t")), t=text) == ["nan_val", "x1", "7", "clair", "fp16", "float", "10", "5", "e3", "_z"]
    assert one(spark, tx.tokens_b(F.col("t")), t=text) == ["nan_val", "x1", "clair", "fp16-float", "e3", "_z"]
    assert one(spark, tx.terms(tx.tokens_a(F.col("t")), True), t="aa bb cc") == ["aa", "bb", "cc", "aa__bb", "bb__cc"]
    assert one(spark, tx.bigrams(tx.tokens_a(F.col("t"))), t="aa") == []


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (lambda: tx.ellipsis(F.col("t"), 8), "abcdefghij", "abcde..."),
        (lambda: tx.squash(F.col("t")), "  a  b\n\tc ", "a b c"),
        (lambda: tx.excerpt(F.col("t"), 20), "abcd                              x", "abcd ... [truncated]"),
        (lambda: tx.issue_number(F.col("t")), "https://github.com/o/r/issues/12/", "12"),
        (lambda: tx.owner_repo(F.col("t")), "https://github.com/o/r/issues/12", "o/r"),
        (lambda: tx.fenced_diff(F.col("t")), "x\n```diff\n-a\n+b\n```", "-a\n+b\n"),
        (lambda: tx.json_object(F.col("t")), '```json\n{"a": {"b": 1}}\n```', '{"a": {"b": 1}}'),
        (lambda: tx.confidence_word(F.col("t")), "0.8", "high"),
        (lambda: tx.confidence_word(F.col("t")), "0.5", "medium"),
        (lambda: tx.confidence_word(F.col("t")), "nonsense", "low"),
        (lambda: taxonomy.evidence(r"(?i)\bnan\b", F.col("t")), "ab NaN\n cd", "ab NaN cd"),
        (lambda: taxonomy.evidence("zz", F.col("t")), "ab", ""),
    ],
)
def test_text_functions(spark, column, text, want):
    assert one(spark, column(), t=text) == want


def test_references(spark):
    text = "see #12, a#3 and /x#4 https://github.com/o/r/pull/9 https://github.com/o/r/pull/10 fix 0a1b2c3d"
    assert one(spark, tx.issue_refs(F.col("t")), t=text) == ["12"]
    assert one(spark, tx.pull_urls(F.col("t"), 1), t=text) == ["https://github.com/o/r/pull/10"]
    assert one(spark, tx.commit_refs(F.col("t")), t=text) == ["0a1b2c3d"]
    assert one(spark, tx.pull_urls_of(F.lit("o/r"), tx.issue_refs(F.col("t"))), t=text) == ["https://github.com/o/r/pull/12"]
    assert one(spark, tx.clean_urls(F.col("t")), t="https://a/b).|nope| http://c,") == ["https://a/b", "http://c"]
    assert one(spark, tx.changed_files(F.col("t")), t="diff --git a/x b/y\n+1\ndiff --git a/a b/a\n") == ["a", "y"]
    assert one(spark, tx.file_stem(F.lit("o/r"), F.col("t")), t="https://github.com/o/r/issues/5") == "o__r__5"
    assert one(spark, tx.label_list(F.col("t")), t="a| |b") == ["a", "b"]


def test_hash_bucket_and_ids(spark):
    urls = [f"https://github.com/a/b/issues/{i}" for i in (1, 2, 3)]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(tx.hash_bucket(F.col("u"), 10)).collect()] == [6, 8, 5]
    assert [r[0][-8:] for r in df.select(tx.stable_id("E", F.lit(1), F.col("u"))).collect()] == ["22bae86c", "597a0713", "a5ea8ef4"]


def test_repair_and_validate(spark):
    df = spark.createDataFrame([("a", ""), ("feature", "x"), ("odd", "y")], "l string, s string")
    out = df.select(taxonomy.repair(F.col("l"), F.col("s"), ["a", "none"], {"feature": ("none", "api")}, F.lit("a")).alias("o")).select("o.*").collect()
    assert [tuple(r) for r in out] == [("a", "unknown", "unchanged"), ("none", "x|api", "feature_to_none"), ("a", "y", "odd_to_a")]
    with pytest.raises(ValueError, match="odd"):
        taxonomy.validate(df, "l", ["a", "feature"])
    assert taxonomy.validate(df, "l", ["a", "feature", "odd"]) is df


def test_rule_table_round_trip(spark):
    assert taxonomy.rule_set(FAILURES.table(spark)) == FAILURES


def test_faster_expressions_match_where_patterns_do(spark):
    """Every faster expression against its pattern, on words at edges, in words, beside signs and other letters."""
    words = sorted({w for r in (taxonomy.PROSE, taxonomy.PROSE_CAUSES) for _, p in r.rules if p.endswith("|$)") for w in p.split(")(")[1].strip("()").split("|")})
    frames = ["{}", " {} ", "{}\n", "\n{}", "x{}", "{}x", "_{} ", " {}_", "9{}", "{}9", "é{}é", "({})", "{0}{0}", "{0}x {0}", "x{0} x{0}.{0}", "a\u2028{}\u2028", "{}\r\n"]
    mails = ["a@b.c", "@b.c", " @b.c", "a@b.C", "a@.c", "é@b.c", "a@b@c.d", "_@x9.y", "a@é.c", "@", "Licens", "licensed", "LICENS", "", "\n"]
    texts = [f.format(w) for w in words for f in frames] + [f.format(w.upper()) for w in words for f in frames[:2]] + mails
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for rules in (taxonomy.PROSE, taxonomy.PROSE_CAUSES):
        assert sum(p in rules.tests for _, p in rules.rules) >= 3
        for _, p in rules.rules:
            assert df.where(~F.col("t").rlike(p).eqNullSafe(rules.matches(F.col("t"), p))).collect() == []


@pytest.mark.parametrize("name", ["label_sets", "secondary_jaccard", "label_set_algebra", "boundary_notes", "three_way_diagnostic", "vote_gated", "metric_value_share", "model_comparison"])
def test_patterns_are_tried_once_a_row(spark, name):
    from reportmill.plans import catalogue

    df = catalogue.CATALOGUE[name].build(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", licens)") == 1
