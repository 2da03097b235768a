"""Rules of text and numbers on single cases."""

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import numbers as N
from lakeloom.functions import text as T
from lakeloom.operators.tables import read_only, read_only_column

CASES = {
    "clean_memory": (T.clean_memory, [(" a &lt;b&gt; &amp; c\x07 ", "a <b> & c"), (None, None)]),
    "normalize": (lambda c: T.normalize_extracted(c, True), [("中 文 （abc） — x", "中文(abc) - x"), ('"quoted"', "quoted"), ("“引”'号'", "引号")]),
    "slugify": (T.slugify, [("Hello,  World -- 2024!", "Hello-World-2024"), ("***", "page")]),
    "relation": (T.sanitize_relation, [("a/b (c)...", "a_slash_b _lparen_c_rparen_ellipsis"), ("knows", "knows")]),
    "front_matter": (lambda c: T.front_matter(c, "title"), [("---\ntitle: A page\ntags: x\n---\nbody [[Link]]", "A page"), ("no front", None)]),
    "wiki_links": (lambda c: F.array_join(T.wiki_links(c), ","), [("see [[A]] and [[B c]]", "A,B c"), ("", "")]),
    "number": (lambda c: N.to_number(c).cast("string"), [("1百万", "1000000.0"), ("1.5亿", "1.5E8"), ("2.3 million", "2300000.0"), ("1.2B", "1.2E9"), ("1,234", "1234.0"), ("苹果公司", None)]),
    "market_cap": (lambda c: N.format_market_cap(c.cast("double")), [("2e12", "2.00 万亿美元"), ("3.5e9", "35.00 亿美元"), ("2e6", "2.00 百万美元"), ("12.345", "12.35 美元")]),
    "mixed_tokens": (lambda c: F.array_join(T.mixed_tokens(c), "|"), [("hello 世界你好 x1", "hello|世界|界你|你好|x1")]),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    rule, cases = CASES[name]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    assert [r.out for r in df.select("i", rule(F.col("x")).alias("out")).orderBy("i").collect()] == [want for _, want in cases]


def test_quarters(spark):
    assert spark.range(1).select(N.quarters(2020, 2022, 2, 3).alias("q")).first().q == [f"{2020 + i // 4} Q{i % 4 + 1}" for i in range(1, 11)]


def test_guard_of_a_column_agrees_with_the_guard_of_one_statement(spark):
    cases = [
        "SELECT created_at FROM {t}", "DROP TABLE x", "WITH a AS (SELECT 1) SELECT * FROM a;", "SELECT 1; SELECT 2", "SELECT 'delete' AS word", "select * from (delete from x)",
        "select 'it''s; drop' from t -- delete\n", "/* a */ select 1", "select \"update\" from t", "explain select 1", "", "select '" + "x''" * 20_000 + "'", "select '" + "y" * 100_000 + "' ; x",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)] + [(99, None)], "i int, s string")
    got = {r.i: r.ok for r in df.select("i", read_only_column(F.col("s")).alias("ok")).collect()}
    assert got == {i: read_only(s) for i, s in enumerate(cases)} | {99: False}
    assert [got[i] for i in range(6)] == [True, False, True, False, True, False]
