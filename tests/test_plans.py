from datetime import date

import pytest

from lettermill.plans.grammar import Filter, Term, date_bounds, date_range, parse, render, size_of
from lettermill.plans.planner import classify_intent, edit_budget, intent_features, plan
from lettermill.plans.predicates import Fields, glob_pattern, mask, quiet
from lettermill.plans.sandbox import Refused, run_bounded, run_select, validate
from pyspark.sql import functions as F

DAY = date(2026, 2, 14)


def test_parse_every_form():
    q = parse('-"a b" from:x ~foo =bar key:val "unterminated')
    assert q.filters == [Filter("from", "x")]
    assert q.terms == [Term("a b", True, True), Term("foo", mode="semantic"), Term("bar", mode="lexical"), Term("key:val"), Term("unterminated", phrase=True)]


@pytest.mark.parametrize("raw", ["from:ann -tag:x/y hello", 'subject:"big deal" -"not this" ~soft =hard', "larger:5mb date:2024..2025 word"])
def test_render_is_the_inverse(raw):
    assert parse(render(parse(raw))) == parse(raw)


def test_sizes_and_dates():
    assert size_of("5mb") == 5_000_000 and size_of("1.5kb") == 1500 and size_of("x") is None
    assert date_range("2024-02", DAY) == (date(2024, 2, 1), date(2024, 3, 1))
    assert date_range("last-week", DAY) == (date(2026, 2, 2), date(2026, 2, 9))
    assert date_range("last-month", date(2026, 1, 5)) == (date(2025, 12, 1), date(2026, 1, 1))
    assert date_range("2024-13", DAY) is None
    assert date_bounds("before", "2024", DAY) == (None, date(2024, 1, 1))
    assert date_bounds("date", "2024-01..2024-02", DAY) == (date(2024, 1, 1), date(2024, 3, 1))


@pytest.fixture(scope="module")
def mails(spark):
    return spark.sql("SELECT * FROM VALUES (1, 'a', 5000000, TIMESTAMP_NTZ '2026-02-14 23:59:59'), (2, NULL, 5000001, TIMESTAMP_NTZ '2026-02-15 00:00:00'), (3, 'tag_x', 1, NULL) AS t(id, subject, size, at)")


def ids(mails, text, **more):
    f = Fields("id", text={"subject": ["subject"]}, size="size", time="at", **more)
    return sorted(r.id for r in mask(parse(text), f, DAY).apply(mails, "id").collect())


def test_masks(spark, mails):
    assert ids(mails, "on:2026-02-14") == [1] and ids(mails, "larger:5mb") == [2]
    assert ids(mails, "-subject:a") == [2]  # a null is no match, so its negation keeps the row; tag_x holds an a
    assert ids(mails, "subject:_") == [3]  # wildcards are plain characters
    assert ids(mails, "-is:muted") == [1, 2, 3] and ids(mails, "is:muted") == []
    tags = spark.createDataFrame([(1, "work/x/y"), (3, "works")], "m int, tag string")
    assert ids(mails, "tag:Work/*", relations={"tag": (tags, "m", "tag")}) == [1]
    assert ids(mails, "-has:tag", relations={"tag": (tags, "m", "tag")}) == [2]
    assert mask(parse("cc:x from:y ok"), Fields("id"), DAY).dropped == ["cc:x", "from:y"]


def test_globs_and_quiet_hours(spark):
    assert spark.range(1).select(F.lit("Report.PDF").rlike(glob_pattern("rep?rt.*"))).first()[0]
    hours = spark.createDataFrame([(6.9,), (7.0,), (21.9,), (22.0,)], "h double")
    assert [r[0] for r in hours.select(quiet(F.col("h"), 22, 7)).collect()] == [True, False, False, True]
    assert not hours.select(F.max(quiet(F.col("h"), 7, 7))).first()[0]


def test_planner():
    assert [edit_budget(w) for w in ("abc", "abcd", "abcde", "abcdef")] == [0, 1, 1, 2]
    assert classify_intent(["invoice", "tracking", "number"]) == "lookup"
    assert classify_intent(["ideas", "about", "travel"]) == "exploratory"
    assert classify_intent(["x"], operator=True, contact=True) == "navigational"
    x = intent_features(["report", "what"], raw='report "a b" what', phrases=1)
    assert x[0] == 3 / 8 and x[2] == 1.0 and x[3] == 0.0 and x[5] == 0.0
    assert intent_features(["what", "moved"], raw="What moved last week")[3:6] == [1.0, 0.0, 1.0]
    assert intent_features([])[0] == 0.0 and plan(parse("what about the move")).get("intent") == "exploratory"
    assert plan(parse('a -b "c d"')) ["excluded"] == ["b"]


@pytest.mark.parametrize("sql", ["SELECT 1; SELECT 2", "DELETE FROM v", "SELECT * FROM other", "WITH RECURSIVE r AS (SELECT 1) SELECT * FROM r", "SELECT java_method('a', 'b') FROM v", "SELECT * FROM v WHERE x IN (SELECT y FROM hidden)", "SELECT '" + "x" * 4000 + "'", "SELECT `java_method`('java.lang.System', 'getProperty', 'user.home') FROM v", "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home') FROM v", "SELECT 1 AS `'`, java_method('a', 'b') AS `'` FROM v", "SELECT * FROM other WHERE 1 IN (WITH other AS (SELECT 1 AS a) SELECT a FROM other)", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM range(5)", "SELECT IDENTIFIER('java_' || 'method')('a', 'b') FROM v", "SELECT explode(x) FROM v", "SELECT (SELECT max(y) FROM hidden) FROM v", "WITH w AS (SELECT * FROM hidden) SELECT * FROM w", "nonsense"])
def test_refused(spark, sql):
    with pytest.raises((Refused, Exception)) as e:
        validate(spark, sql, {"v"})
    assert isinstance(e.value, Refused)


def test_allowed(spark):
    v = spark.range(600).withColumn("t", F.repeat(F.lit("a"), 600))
    assert validate(spark, "SELECT ';' AS x FROM v -- ;", {"v"})
    out = run_select(spark, "WITH w AS (SELECT id, t FROM v) SELECT id, t, rank() OVER (ORDER BY id) AS r FROM w WHERE id >= :low", {"v": v}, {"low": 10}).frame
    got = out.collect()
    assert len(got) == 500 and all(len(r.t) == 513 for r in got)
    rows, more = run_bounded(v.select("id"))
    assert len(rows) == 500 and more


def test_sandbox_leaves_the_session_alone(spark):
    spark.range(3).createOrReplaceTempView("v")
    out = run_select(spark, "SELECT count(*) AS n FROM v", {"v": spark.range(600)})
    assert out.fetch() == ([(600,)], False)
    assert spark.table("v").count() == 3 and [t.name for t in spark.catalog.listTables() if t.name.startswith("lettermill_")] == []
    rows, more = run_select(spark, "SELECT id FROM v ORDER BY id DESC", {"v": spark.range(600)}).fetch()
    assert more and [r.id for r in rows] == list(range(599, 99, -1))
    spark.catalog.dropTempView("v")
    slow = run_select(spark, "SELECT sum(length(replace(t, 'a', 'b'))) AS n FROM v", {"v": spark.range(1 << 40).withColumn("t", F.repeat(F.lit("a"), 200))}, seconds=2)
    with pytest.raises(Exception, match="(?i)cancel|interrupt"):
        slow.fetch()
