"""Filters, joins, aggregates, windows and set operations over the tables, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.plans.grammar import parse
from lettermill.plans.predicates import Fields, Rule, mask, policy_mode, quiet, rule_predicate
from lettermill.sources.tables import epoch, messages, table

TODAY = date(1996, 6, 12)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _mask(df: DataFrame, text: str, fields: Fields) -> DataFrame:
    return mask(parse(text), fields, TODAY).apply(df, fields.id)


def _customers() -> Fields:
    return Fields("c_custkey", text={"from": ["c_name", "c_mktsegment"], "subject": ["c_name"]}, account="c_mktsegment")


def _orders(**more) -> Fields:
    return Fields("o_orderkey", text={"subject": ["o_orderpriority"]}, size="o_totalprice", time="o_orderdate", mailbox="o_orderpriority", account="o_orderstatus", thread="o_custkey", **more)


# Filters


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '0007') OR contains(lower(c_mktsegment), '0007')")
def filter_substring(spark: SparkSession, d: str) -> DataFrame:
    return _mask(table(spark, d, "customer"), "from:0007", _customers()).select("c_custkey", "c_name")


@query("SELECT doc_id, lang FROM documents WHERE NOT coalesce(contains(lower(lang), 'en'), false)")
def filter_negated_null_safe(spark, d):
    f = Fields("doc_id", text={"subject": ["lang"]})
    return _mask(table(spark, d, "documents"), "-subject:EN", f).select("doc_id", "lang")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_totalprice < 400000")
def filter_size(spark, d):
    return _mask(table(spark, d, "orders"), "larger:300kb smaller:0.4mb", _orders()).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-02-01' AND o_orderdate < TIMESTAMP '1995-05-01' AND NOT (o_orderdate >= TIMESTAMP '1995-03-03' AND o_orderdate < TIMESTAMP '1995-03-04')")
def filter_date_range(spark, d):
    return _mask(table(spark, d, "orders"), "date:1995-02..1995-04 -on:1995-03-03", _orders()).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-03' AND o_orderdate < TIMESTAMP '1996-06-10'")
def filter_relative_date(spark, d):
    return _mask(table(spark, d, "orders"), "on:last-week", _orders()).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE lower(n_name) LIKE 'nation_1%')")
def filter_glob(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("n_nationkey") == F.col("c_nationkey"))
    f = Fields("c_custkey", relations={"filename": (n, "c_custkey", "n_name")})
    return _mask(table(spark, d, "customer"), "filename:NATION?1*", f).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND lower(o_orderstatus) = 'f'")
def filter_in_nocase(spark, d):
    return _mask(table(spark, d, "orders"), "in:1-Urgent account:f", _orders()).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def filter_thread(spark, d):
    return _mask(table(spark, d, "orders"), "thread:7 -thread:x -is:muted", _orders()).select("o_orderkey")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE false")
def filter_never(spark, d):
    return _mask(table(spark, d, "orders"), "is:pinned", _orders()).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'a.*e') OR regexp_matches(p_type, 'MALL$') OR p_size <= 3")
def filter_any_all(spark, d):
    return table(spark, d, "part").filter(rule_predicate(Rule("any", (("p_name", "a.*e"), ("p_type", "MALL$")), max_bytes=3), size="p_size")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'ECONOMY|SMALL') AND p_size >= 10 AND p_size <= 20")
def rule_backtest(spark, d):
    return table(spark, d, "part").filter(rule_predicate(Rule("all", (("p_type", "ECONOMY|SMALL"),), min_bytes=10, max_bytes=20), size="p_size")).select("p_partkey")


@query("SELECT event_id FROM events WHERE hour(ts) + minute(ts) / 60.0 >= 22 OR hour(ts) + minute(ts) / 60.0 < 7")
def quiet_hours(spark, d):
    h = F.hour("ts") + F.minute("ts") / 60.0
    return table(spark, d, "events").filter(quiet(h, 22, 7)).select("event_id")


@query("SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN 'deny' WHEN c_name LIKE '%00_1' THEN 'allow' WHEN c_name LIKE '%7' THEN 'ask' WHEN c_nationkey = 3 THEN 'deny' ELSE 'allow' END AS mode FROM customer")
def policy_tiers(spark, d):
    rules = spark.createDataFrame([("folder", "building", "allow"), ("folder", "BUILDING", "deny"), ("pattern", "*00?1", "allow"), ("pattern", "*7", "ask"), ("account", "3", "deny")], "tier string, value string, mode string")
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("folder"), F.col("c_nationkey").cast("string").alias("account"))
    return policy_mode(c, rules, account="account", folder="folder", sender="c_name", default="allow").select("c_custkey", "mode")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END > 2")
def ai_priority_above(spark, d):
    p = F.create_map(*(F.lit(x) for x in ("1-URGENT", "critical", "2-HIGH", "high", "3-MEDIUM", "normal")))
    o = table(spark, d, "orders").withColumn("pri", F.coalesce(F.element_at(p, F.col("o_orderpriority")), F.lit("low")))
    return _mask(o, "ai:priority>normal", Fields("o_orderkey", ai={"priority": "pri"})).select("o_orderkey", "o_orderpriority")


# Joins


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_has_line(spark, d):
    l = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return _mask(table(spark, d, "orders"), "has:tag", _orders(relations={"tag": (l, "l_orderkey", "l_returnflag")})).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_no_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50) OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def theta_or_semi(spark, d):
    o = table(spark, d, "orders")
    own = o.join(table(spark, d, "lineitem").filter("l_quantity >= 50"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    other = o.join(table(spark, d, "customer").filter("c_acctbal < 0"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return own.select("o_orderkey").union(other.select("o_orderkey")).distinct()


@query("SELECT DISTINCT o_orderkey, tag FROM (SELECT l_orderkey AS o_orderkey, l_returnflag AS tag FROM lineitem UNION ALL SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey)")
def effective_tags(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("tag"))
    of_thread = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("tag"))
    return own.union(of_thread).distinct()


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dim_join(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_text(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "n_chars", "quality", "toxic")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY o_custkey")
def latest_per_key(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def dedupe_newest(spark, d):
    w = Window.partitionBy("o_custkey", F.to_date("o_orderdate")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r = 1").select("o_orderkey")


def keyset_page(df: DataFrame, sort: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """Newest first; after is the (sort, key) of the last row seen."""
    if after is not None:
        df = df.filter((F.col(sort) < after[0]) | ((F.col(sort) == after[0]) & (F.col(key) < after[1])))
    return df.orderBy(F.desc(sort), F.desc(key)).limit(size)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 200000 AND (o_totalprice < 200000 OR o_orderkey < 100) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def keyset_second_page(spark, d):
    return keyset_page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", (200000.0, 100), 25)


@query("SELECT a.l_partkey AS src, b.l_partkey AS dst, count(DISTINCT a.l_orderkey) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2")
def self_pairs(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = l.alias("a"), l.alias("b")
    return a.join(b, F.expr("a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey")).groupBy(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


@query("SELECT event_id, CAST(band AS INTEGER) AS band FROM events JOIN (SELECT unnest([1, 2, 3]) AS band, unnest([0.0, 20.0, 60.0]) AS low, unnest([20.0, 60.0, 1e9]) AS high) ON value >= low AND value < high")
def range_containment(spark, d):
    bands = spark.createDataFrame([(1, 0.0, 20.0), (2, 20.0, 60.0), (3, 60.0, 1e9)], "band int, low double, high double")
    return table(spark, d, "events").join(F.broadcast(bands), F.expr("value >= low AND value < high")).select("event_id", "band")


@query("SELECT c_custkey, n.n_nationkey FROM customer c FULL JOIN nation n ON c.c_nationkey = n.n_nationkey")
def full_outer(spark, d):
    c = table(spark, d, "customer")
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "full").select("c_custkey", "n_nationkey")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def asof_last(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


# Analytics views


@query("SELECT event_id AS message_id, user_id AS sender, event_type AS mailbox, CASE WHEN event_type = 'purchase' THEN 'outbound' ELSE 'inbound' END AS direction, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events")
def analytics_messages(spark, d):
    return messages(spark, d).select("message_id", "sender", "mailbox", "direction", "at")


@query("SELECT user_id AS sender, count(*) AS messages, round(sum(value), 4) AS total, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS read_rate, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT event_type) AS mailboxes FROM events WHERE event_type <> 'purchase' GROUP BY user_id")
def sender_summary(spark, d):
    m = messages(spark, d).filter("direction = 'inbound'")
    return m.groupBy("sender").agg(F.count(F.lit(1)).alias("messages"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg(F.when(F.col("mailbox") == "click", 1.0).otherwise(0.0)), 6).alias("read_rate"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_distinct("mailbox").alias("mailboxes"))


@query("SELECT event_type AS mailbox, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'purchase' THEN 'outbound' ELSE 'inbound' END AS direction, count(*) AS messages, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def daily_volume(spark, d):
    return messages(spark, d).groupBy("mailbox", F.date_format("ts", "yyyy-MM-dd").alias("day"), "direction").agg(F.count(F.lit(1)).alias("messages"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT conv_id, count(*) AS messages, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS inbound, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS outbound, array_to_string(list_sort(list_distinct(list(role))), ',') AS participants FROM conversations GROUP BY conv_id")
def thread_rollup(spark, d):
    c = table(spark, d, "conversations")
    n = lambda r: F.sum(F.when(F.col("role") == r, 1).otherwise(0)).cast("long")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), n("user").alias("inbound"), n("assistant").alias("outbound"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("participants"))


@query("SELECT event_type AS mailbox, count(*) AS messages, CAST(sum(CASE WHEN json_extract_string(props, '$.k')::BIGINT % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unread FROM events GROUP BY event_type")
def mailbox_unread(spark, d):
    return messages(spark, d).groupBy("mailbox").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.when(F.col("k") % 2 == 0, 1).otherwise(0)).cast("long").alias("unread"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def analytics_contacts(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT DISTINCT user_id AS self FROM events WHERE event_type = 'purchase' UNION SELECT c_custkey FROM customer WHERE contains(c_name, '#00001')")
def self_identity(spark, d):
    sent = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("self"))
    return sent.union(table(spark, d, "customer").filter(F.contains("c_name", F.lit("#00001"))).select("c_custkey")).distinct()


# Aggregates, windows, sets


@query("SELECT date_trunc('month', l_shipdate) AS month, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned, round(sum(l_extendedprice * (1 - l_discount)), 2) AS spent, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM lineitem GROUP BY 1")
def spend_windows(spark, d):
    l = table(spark, d, "lineitem")
    return l.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0)), 2).alias("returned"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("spent"), F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).cast("long").alias("large"))


@query("SELECT l_returnflag, spent, CASE WHEN spent >= 1.1e9 THEN 'blocked' WHEN spent >= 9e8 THEN 'downgrade' ELSE 'ok' END AS verdict FROM (SELECT l_returnflag, round(sum(l_extendedprice), 2) AS spent FROM lineitem GROUP BY 1)")
def spend_verdict(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("spent"))
    return s.withColumn("verdict", F.when(F.col("spent") >= 1.1e9, "blocked").when(F.col("spent") >= 9e8, "downgrade").otherwise("ok"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * CASE l_returnflag WHEN 'R' THEN 3.0 WHEN 'A' THEN 15.0 ELSE 0.0 END / 1000, 6) AS cost FROM lineitem")
def cost_estimate(spark, d):
    prices = spark.createDataFrame([("R", 3.0), ("A", 15.0)], "model string, price double")
    l = table(spark, d, "lineitem").join(F.broadcast(prices), F.col("l_returnflag") == F.col("model"), "left")
    return l.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.coalesce("price", F.lit(0.0)) / 1000, 6).alias("cost"))


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(l_quantity), 2) AS tokens FROM lineitem GROUP BY 1")
def usage_daily(spark, d):
    return table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("l_quantity"), 2).alias("tokens"))


@query("SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM lineitem GROUP BY 1")
def queue_stats(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n, list_aggregate(list_sort(list(CAST(o_orderkey AS VARCHAR))), 'string_agg', '|') AS ids, coalesce(sum(o_totalprice), 0.0)::DECIMAL(18,2)::DOUBLE AS total FROM orders GROUP BY 1, 2")
def adhoc_aggregates(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))), "|").alias("ids"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE)) AS rk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE)) AS dr, round(percent_rank() OVER w, 6) AS pr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)")
def win_rank_family(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    day = Window.partitionBy("o_orderpriority").orderBy(F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(day).cast("long").alias("rk"), F.dense_rank().over(day).cast("long").alias("dr"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.ntile(4).over(w).cast("long").alias("nt"))


@query("SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next, first_value(event_id) OVER w AS first_id, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("prev"), F.lead("event_id").over(w).alias("next"), F.first("event_id").over(w).alias("first_id"), F.last("event_id").over(whole).alias("last_id"))


@query("SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topn_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("o_custkey", "o_orderkey", "r")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk_total_order(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT o_orderkey, true AS truncated FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100)")
def limit_with_flag(spark, d):
    probe = table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(101)
    return probe.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).orderBy("o_orderkey").limit(100).select("o_orderkey", (F.col("n") > 100).alias("truncated"))


@query("SELECT user_id AS id FROM events WHERE event_type = 'click' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def union_distinct(spark, d):
    return table(spark, d, "events").filter("event_type = 'click'").select(F.col("user_id").alias("id")).union(table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey")).distinct()


@query("SELECT id, CAST(side AS INTEGER) AS side FROM ((SELECT c_custkey AS id, 1 AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) UNION ALL (SELECT DISTINCT o_custkey, 2 FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)))")
def set_diff(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'P'")
    left = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"), F.lit(1).alias("side"))
    right = o.join(c.filter("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("o_custkey").distinct().select(F.col("o_custkey").alias("id"), F.lit(2).alias("side"))
    return left.union(right)


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 70 INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 70 EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 120")
def required_and_excluded(spark, d):
    e = table(spark, d, "events")
    of = lambda t, least: e.filter((F.col("event_type") == t) & (F.col("value") > least)).select("user_id")
    return of("click", 70).distinct().join(of("purchase", 70), "user_id", "left_semi").join(of("signup", 120), "user_id", "left_anti")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def grouping_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("g"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("g"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, to_json({'id': event_id, 'type': event_type})::VARCHAR AS payload FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("payload"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start_at, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_at"), "event_type", "n")


@query("SELECT TIMESTAMP '1970-01-01' + CAST(b * 7 AS INTEGER) * INTERVAL '1 day' AS start_at, count(*) AS n FROM (SELECT unnest(generate_series(CAST(floor(epoch(ts) / 604800) AS BIGINT) - 3, CAST(floor(epoch(ts) / 604800) AS BIGINT))) AS b FROM events) GROUP BY 1")
def sliding(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "28 days", "7 days").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_at"), "n")


@query("SELECT user_id, min(ts) AS start_at, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start_at"), "n")


@query("SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS period, count(*) AS n, CAST(floor(epoch(ts) / 86400) AS BIGINT) < CAST(floor((SELECT max(epoch(ts)) FROM events) / 86400) AS BIGINT) AS completed FROM events GROUP BY 1, 3")
def period_grid(spark, d):
    e = messages(spark, d).withColumn("period", F.floor(F.col("at") / 86400))
    last = e.agg(F.max("period").alias("last"))
    return e.groupBy("period").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(last)).select("period", "n", (F.col("period") < F.col("last")).alias("completed"))


# Scalars


@query("SELECT doc_id, sha256(text) AS hash, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, lower(trim(source)) AS address, nullif(lang, 'en') AS other_lang, instr(text, 'the') AS at, upper(source) AS head, replace(source, 'src', 's') AS short FROM documents")
def scalar_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.ceil(F.octet_length("text") / 4.0).alias("tokens"), F.lower(F.trim("source")).alias("address"), F.nullif("lang", F.lit("en")).alias("other_lang"), F.instr("text", "the").cast("long").alias("at"), F.upper("source").alias("head"), F.replace("source", F.lit("src"), F.lit("s")).alias("short"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS unix, round(epoch(o_orderdate) / 86400.0 + 2440587.5, 5) AS julian, round(abs(o_totalprice - 150000), 2) AS away, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS open FROM orders")
def scalar_dates(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), epoch("o_orderdate").alias("unix"), F.round(epoch("o_orderdate") / 86400.0 + 2440587.5, 5).alias("julian"), F.round(F.abs(F.col("o_totalprice") - 150000), 2).alias("away"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("open"))


# Tags and maintenance


@query("SELECT p_partkey, tag FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS s FROM part), LATERAL (SELECT unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], '/'))) AS tag)")
def tag_ancestors(spark, d):
    s = F.split(F.lower("p_name"), " ")
    paths = F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, 1, i), "/"))
    return table(spark, d, "part").select("p_partkey", F.explode(paths).alias("tag"))


@query("SELECT r_name AS tag, count(DISTINCT c_custkey) AS messages FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def tag_counts(spark, d):
    return dim_join(spark, d).groupBy(F.col("r_name").alias("tag")).agg(F.count_distinct("c_custkey").alias("messages"))


@query("SELECT event_type AS tag, accepted, rejected, CASE WHEN rejected >= 3 AND rejected / (accepted + rejected) >= 0.75 THEN 1.0 ELSE round(0.5 + rejected / (accepted + rejected) * 0.5, 6) END AS floor FROM (SELECT event_type, sum(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END) AS accepted, sum(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END) AS rejected FROM events GROUP BY 1)")
def tag_learning(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("tag")).agg(F.sum(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)).alias("accepted"), F.sum(F.when(F.col("value") < 50, 1.0).otherwise(0.0)).alias("rejected"))
    rate = F.col("rejected") / (F.col("accepted") + F.col("rejected"))
    return e.withColumn("floor", F.when((F.col("rejected") >= 3) & (rate >= 0.75), 1.0).otherwise(F.round(0.5 + rate * 0.5, 6)))


@query("SELECT hash, min(doc_id) AS keeper, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS hash FROM documents) GROUP BY hash HAVING count(*) > 1")
def hash_dedup(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return h.groupBy("hash").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("SELECT doc_id AS id, 'missing' AS drift FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'orphan' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT d.doc_id, 'changed' FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.n_chars % 2 <> l.quality")
def index_drift(spark, d):
    docs, index = table(spark, d, "documents"), table(spark, d, "labels")
    one = docs.join(index, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.lit("missing").alias("drift"))
    two = index.join(docs, "doc_id", "left_anti").select("doc_id", F.lit("orphan"))
    three = docs.join(index, "doc_id").filter(F.col("n_chars") % 2 != F.col("quality")).select("doc_id", F.lit("changed"))
    return one.union(two).union(three)


@query("SELECT l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def orphans(spark, d):
    return table(spark, d, "lineitem").select("l_partkey").distinct().join(table(spark, d, "part").filter("p_size < 40"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r > 500")
def cache_sweep(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(docs.orderBy(F.desc("n_chars"), "doc_id").limit(500).select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def dirty_feed(spark, d):
    """The last operation of each key."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id", "ts"), "event_id").alias("x"))
    return last.select("x.event_type", "x.event_id", "x.ts")
