"""Upkeep operators applied to the tables, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.operators import fuse, retrieve, upkeep
from lettermill.plans.grammar import parse
from lettermill.plans.predicates import Fields, mask
from lettermill.queries.search import _bm25_sql as BM25_SQL
from lettermill.queries.search import _query_vector, docs
from lettermill.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def capped_scan(spark, d):
    """All urgent orders, however many: nothing here holds them, so the scan has no cap."""
    return upkeep.capped(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey"), None)


@query("SELECT o_orderkey, 'urgent' AS tag FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_totalprice > 400000")
def bulk_tag(spark, d):
    """Tags what a query finds; parts that it cannot enforce would be named, not ignored."""
    m = mask(parse("subject:urgent larger:400kb"), Fields("o_orderkey", text={"subject": ["o_orderpriority"]}, size="o_totalprice"), date(2024, 1, 1))
    assert not m.dropped
    return m.apply(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", F.lit("urgent").alias("tag"))


@query("SELECT c_custkey, c_name, round(0.5 * least(n, 20) / 20.0, 6) AS boost FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE contains(lower(c_name), '00012') ORDER BY boost DESC, c_custkey LIMIT 32")
def entity_resolution(spark, d):
    """Contacts whose name holds the query's word, boosted by how often they write."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").filter(F.contains(F.lower("c_name"), F.lit("00012"))).join(n, F.col("c_custkey") == F.col("o_custkey"))
    return c.select("c_custkey", "c_name", F.round(0.5 * F.least("n", F.lit(20)) / 20.0, 6).alias("boost")).orderBy(F.desc("boost"), "c_custkey").limit(32)


@query("SELECT event_id AS doc_id, 'structured' AS source FROM events WHERE event_type = 'click'")
def fan_out_degraded(spark, d):
    e = table(spark, d, "events")
    arms = {"structured": lambda: e.filter("event_type = 'click'").select(F.col("event_id").alias("doc_id"), F.lit("structured").alias("source")), "broken": lambda: e.select("no_such_column")}
    return upkeep.fan_out(arms, "doc_id long, source string", spark)[0]


@query("WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id AS chunk_id, vec_id // 3 AS doc_id, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) AS s FROM embeddings, q ORDER BY s DESC, chunk_id LIMIT 64) SELECT doc_id, round(max(s), 5) AS score, count(*) AS chunks FROM s GROUP BY 1")
def chunk_search(spark, d):
    """The nearest chunks, gathered by document."""
    top = retrieve.knn(table(spark, d, "embeddings"), _query_vector(spark, d), 64, units=True)
    return top.groupBy(F.expr("doc_id div 3").alias("doc_id")).agg(F.round(F.max("score"), 5).alias("score"), F.count(F.lit(1)).alias("chunks"))


@query(f"""WITH {BM25_SQL(['thing'])}, q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 7),
both_arms AS ((SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM lexical ORDER BY score DESC, doc_id LIMIT 100) UNION ALL (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) FROM (SELECT vec_id AS doc_id, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) AS s FROM embeddings, q) ORDER BY s DESC, doc_id LIMIT 100))
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM both_arms GROUP BY 1""")
def attachment_hybrid(spark, d):
    one = retrieve.ranked(retrieve.bm25(docs(spark, d), ["thing"]), "lexical", 100)
    two = retrieve.knn(table(spark, d, "embeddings"), _query_vector(spark, d), 100, units=True)
    cols = ["doc_id", "source", "score", "rank"]
    return fuse.rrf(one.select(*cols).unionByName(two.select(*cols)), {"lexical": 1.0, "dense": 1.0}).select("doc_id", F.round("score", 9).alias("score"))


@query("WITH t AS (SELECT doc_id, n_chars::DOUBLE AS score, doc_id * 7 % 41 AS place FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20), a AS (SELECT score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM t), b AS (SELECT doc_id, row_number() OVER (ORDER BY place, doc_id) AS r FROM t) SELECT doc_id, round(score - r * 1e-9, 6) AS score FROM b JOIN a USING (r)")
def l2_rerank(spark, d):
    t = docs(spark, d).select("doc_id", F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
    return upkeep.rerank(t, t.select("doc_id", (F.col("doc_id") * 7 % 41).alias("place"))).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def missing_vectors(spark, d):
    t = docs(spark, d).select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    cache = t.filter("lang = 'en'").select(F.lit("m").alias("model"), F.lit(64).alias("dim"), "hash")
    return upkeep.missing_vectors(t, cache, "m", 64).select("doc_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '3 days' AND event_type = 'view'")
def reindex_selection(spark, d):
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts")).first()[0]
    from datetime import timedelta

    return upkeep.reindex(e, since=newest - timedelta(days=3), mailbox="view", id_col="event_id", time_col="ts", mailbox_col="event_type").select("event_id")


@query("""WITH RECURSIVE n AS (SELECT 'tree' AS kind, 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'ring', 'n' || n_nationkey, 'n' || ((n_nationkey + 1) % 25) FROM nation
 UNION ALL SELECT 'chain of ' || k, 'p' || p_partkey, 'p' || (p_partkey + 1) FROM part, (SELECT unnest([64, 65, 100]) AS k) WHERE p_partkey <= k),
w AS (SELECT kind, node, parent, 1 AS links FROM n UNION ALL SELECT w.kind, w.node, n.parent, links + 1 FROM w JOIN n ON w.kind = n.kind AND w.parent = n.node WHERE links <= 64)
SELECT kind, max(links) > 64 AS cyclic FROM w GROUP BY kind""")
def hierarchy_cycle(spark, d):
    """Trees of nations, a ring of them, and chains of parts; what loops or is deeper than 64 links is refused."""
    n, p = table(spark, d, "nation"), table(spark, d, "part")
    say = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    found = {"tree": n.select(say("n", F.col("n_nationkey")).alias("node"), say("r", F.col("n_regionkey")).alias("parent")), "ring": n.select(say("n", F.col("n_nationkey")).alias("node"), say("n", (F.col("n_nationkey") + 1) % 25).alias("parent"))}
    for k in (64, 65, 100):
        found[f"chain of {k}"] = p.filter(F.col("p_partkey") <= k).select(say("p", F.col("p_partkey")).alias("node"), say("p", F.col("p_partkey") + 1).alias("parent"))
    return spark.createDataFrame([(kind, upkeep.has_cycle(x)) for kind, x in found.items()], "kind string, cyclic boolean")


@query("SELECT event_id AS id, event_type AS tag, CASE WHEN event_id % 3 = 0 THEN 'pending' WHEN value > 50 THEN 'accepted' ELSE 'rejected' END AS state FROM events")
def suggestion_states(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tag"), "value")
    return upkeep.resolve_suggestions(e.select("id", "tag"), e.filter("id % 3 <> 0").select("id", "tag", (F.col("value") > 50).alias("accepted")))


@query("WITH i AS (SELECT user_id AS q, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS np, event_type = 'click' AS engaged FROM events) SELECT q, round(avg(CASE WHEN engaged THEN 1.0 / pos END), 6) AS now_mrr, round(avg(CASE WHEN engaged THEN 1.0 / np END), 6) AS then_mrr, 0::BIGINT AS unlabelled FROM i GROUP BY q")
def shadow_eval(spark, d):
    e = table(spark, d, "events")
    i = e.select(F.col("user_id").alias("q"), F.col("event_id").alias("doc_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("pos"), (F.col("event_type") == "click").alias("engaged"))
    n = e.select(F.col("user_id").alias("q"), F.col("event_id").alias("doc_id"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("new_pos"))
    return upkeep.shadow(i, n).select("q", F.round("now", 6).alias("now_mrr"), F.round("then", 6).alias("then_mrr"), "unlabelled")


@query("WITH e AS (SELECT * FROM events WHERE event_type <> 'view') SELECT event_id FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL '10 days' AND event_id IN (SELECT event_id FROM e ORDER BY event_id DESC LIMIT 3000)")
def feedback_prune(spark, d):
    from datetime import timedelta

    e = table(spark, d, "events").filter("event_type <> 'view'")
    return upkeep.prune(e, oldest=e.agg(F.max("ts")).first()[0] - timedelta(days=10), rows=3000, id_col="event_id", time_col="ts").select("event_id")


@query("SELECT event_id AS id, CASE WHEN event_type IN ('view', 'signup') THEN 'suppressed' WHEN hour(ts) >= 22 OR hour(ts) < 7 THEN 'pending' WHEN value < 100 THEN 'delivered' WHEN event_id % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS next FROM events")
def notification_states(spark, d):
    tier = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type").isin("click", "purchase"), "high").otherwise("normal")
    n = table(spark, d, "events").select(F.col("event_id").alias("id"), tier.alias("tier"), F.lit("pending").alias("state"), (F.col("event_id") % 4).alias("attempts"), (F.col("value") >= 100).alias("failed"), ((F.hour("ts") >= 22) | (F.hour("ts") < 7)).alias("quiet"))
    return upkeep.notify_step(n, quiet_col="quiet", threshold="high").select("id", "next")


@query("WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 7) SELECT doc_id FROM documents WHERE lang = 'en' AND (regexp_matches(lower(text), '(^|[^a-z0-9])thing([^a-z0-9]|$)') OR doc_id IN (SELECT vec_id FROM embeddings, q WHERE list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) >= 0.6))")
def hybrid_folder(spark, d):
    """Members by filters and (words or nearness)."""
    q = F.array(*map(F.lit, _query_vector(spark, d)))
    near = table(spark, d, "embeddings").filter(retrieve.dot(F.col("embedding"), q) >= 0.6).select(F.col("vec_id").alias("doc_id"))
    en = docs(spark, d).filter("lang = 'en'")
    words = en.filter(F.lower("text").rlike("(^|[^a-z0-9])thing([^a-z0-9]|$)")).select("doc_id")
    return words.union(en.join(near, "doc_id", "left_semi").select("doc_id")).distinct()


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND value > 50 AND event_id > 1000 ORDER BY event_id LIMIT 256")
def export_selection(spark, d):
    m = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("mailbox"), "value")
    return upkeep.export_page(m, after=1000, mailbox="click", where=F.col("value") > 50).select("id")


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '5 days' AND event_type = 'error' ORDER BY event_id DESC LIMIT 100")
def ledger_listing(spark, d):
    from datetime import timedelta

    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    return upkeep.ledger_query(e, 100, since=e.agg(F.max("at")).first()[0] - timedelta(days=5), kind="error", id=None).select("id", "kind")


@query("WITH h AS (SELECT 'large' AS rule, event_id AS id FROM events WHERE value > 150 UNION SELECT 'bought', event_id FROM events WHERE event_type = 'purchase') SELECT rule, id FROM h WHERE NOT (rule = 'large' AND id IN (SELECT event_id FROM events WHERE event_type = 'view'))")
def rule_tick(spark, d):
    """Rules that hit again and again fire once for each message; those fired before do not."""
    e = table(spark, d, "events")
    hit = lambda rule, found: found.select(F.lit(rule).alias("rule"), F.col("event_id").alias("id"))
    large, bought = hit("large", e.filter("value > 150")), hit("bought", e.filter("event_type = 'purchase'"))
    return upkeep.to_fire(large.unionByName(bought).unionByName(large), hit("large", e.filter("event_type = 'view'")))


@query("WITH e AS (SELECT row_number() OVER (ORDER BY n_name) AS entity_id, 'nation' AS kind, n_name AS norm FROM nation), n AS (SELECT DISTINCT 'brand' AS kind, p_brand AS norm FROM part) SELECT * FROM e UNION ALL SELECT 25 + row_number() OVER (ORDER BY kind, norm), kind, norm FROM n")
def entity_upsert(spark, d):
    """Nations have ids; brands and the same nations are mentioned."""
    n = table(spark, d, "nation").select(F.row_number().over(Window.orderBy("n_name")).cast("long").alias("entity_id"), F.lit("nation").alias("kind"), F.col("n_name").alias("norm"))
    mentions = table(spark, d, "part").select(F.lit("brand").alias("kind"), F.col("p_brand").alias("norm")).unionByName(n.select("kind", "norm"))
    return upkeep.upsert_entities(n, mentions)


@query("""WITH o AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'scheduled' WHEN 'click' THEN 'sending' ELSE 'sent' END AS state, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CASE WHEN value < 20 THEN 'sent' WHEN value < 40 THEN 'refused' WHEN value < 60 THEN 'cancel' END AS outcome FROM events), n AS (SELECT max(sec) - 432000 AS now FROM o)
SELECT id, CASE state WHEN 'scheduled' THEN CASE WHEN outcome = 'cancel' THEN 'canceled' WHEN sec <= now THEN 'sending' ELSE 'scheduled' END WHEN 'sending' THEN CASE WHEN outcome = 'sent' THEN 'sent' WHEN outcome = 'refused' THEN 'failed' WHEN sec + 600 <= now THEN 'uncertain' ELSE 'sending' END ELSE state END AS next FROM o, n""")
def outbox_states(spark, d):
    at = F.unix_timestamp(F.to_timestamp("ts"))
    o = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "scheduled").when(F.col("event_type") == "click", "sending").otherwise("sent").alias("state"), at.alias("due"), at.alias("started"),
        F.when(F.col("value") < 20, "sent").when(F.col("value") < 40, "refused").when(F.col("value") < 60, "cancel").alias("outcome"),
    )
    return upkeep.outbox_step(o, o.agg(F.max("due")).first()[0] - 432_000).select("id", "next")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 6 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS written FROM orders")
def written_dates(spark, d):
    """Order dates as they are written here and there, some with years that no order has."""
    from lettermill.functions.text import DATE_FORMATS, written_date

    day = F.to_date("o_orderdate")
    said = F.element_at(F.array(*(F.date_format(day, f) for f in DATE_FORMATS), F.date_format(F.add_months(day, 12 * 900), "yyyy-MM-dd")), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", written_date(F.concat(F.lit(" "), said)).cast("string").alias("written"))
