"""Readers, writers and parsers applied to the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.operators import invoices
from lettermill.operators.response import dedupe
from lettermill.sources import attachments, delimited
from lettermill.sources.calendar import parse_calendar, write_calendar
from lettermill.sources.mail import eml, mbox, parse_column
from lettermill.sources.tables import table, write
from lettermill.streaming.log import retain, since
from lettermill.streaming.queue import backoff, enqueue, lease

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def mails(spark, d) -> DataFrame:
    """conversations as raw messages."""
    c = table(spark, d, "conversations").withColumns({
        "from": F.concat("role", F.lit("@example.com")), "to": F.lit("me@example.com"), "subject": F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")),
        "date": F.lit("Wed, 15 Nov 2023 00:00:00 +0000"), "mid": F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("@example.com>")),
        "body": F.regexp_replace("text", "\n", " "),
    })
    return c.withColumn("raw", eml({"from": "from", "to": "to", "subject": "subject", "date": "date", "id": "mid", "body": "body"}))


@query("SELECT conv_id || '.' || turn || '@example.com' AS message_id, role || '@example.com' AS from_addr, 'Conversation ' || conv_id AS subject, 1700006400::BIGINT AS at FROM conversations")
def message_parse(spark, d):
    m = mails(spark, d).select(parse_column()(F.encode("raw", "UTF-8")).alias("m"))
    return m.select("m.message_id", "m.from_addr", "m.subject", "m.at")


@query()
def export_mbox(spark, d):
    return mails(spark, d).select("conv_id", "turn", mbox(F.col("raw"), F.col("from")).alias("entry"))


@query("""SELECT p_partkey, CASE WHEN contains(p_name, ',') THEN '"' || p_name || '"' ELSE p_name END || ',''=' || p_brand || ',' || p_size AS line FROM part""")
def csv_export(spark, d):
    p = table(spark, d, "part").withColumn("formula", F.concat(F.lit("="), "p_brand"))
    return p.select("p_partkey", F.concat_ws(",", *(delimited.safe_cell(F.col(c)) for c in ("p_name", "formula", "p_size"))).alias("line"))


@query("SELECT p_brand, count(*) AS n, sum(p_size)::DOUBLE AS total FROM part GROUP BY p_brand")
def csv_tables(spark, d):
    """Written as delimited text with a semicolon, sniffed, read back with types, and summed."""
    text = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(F.concat_ws(";", "p_name", F.col("p_size").cast("string"))), "\n").alias("t"))
    x = text.select("p_brand", F.explode(delimited.tables_column("csv")(F.concat(F.lit("name;size\n"), "t"))).alias("x"))
    r = x.select("p_brand", F.explode("x.rows").alias("r")).select("p_brand", F.try_element_at("r", F.lit(2)).cast("double").alias("v"))
    return r.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("SELECT n_regionkey, n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def html_tables(spark, d):
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), "n_name", F.lit("</td></tr>"))
    h = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<table><tr><th>id</th><th>name</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("h"))
    t = h.select("n_regionkey", F.explode(delimited.tables_column("html")("h")).alias("t")).select("n_regionkey", F.explode("t.rows").alias("r"))
    return t.select("n_regionkey", F.col("r")[0].alias("id"), F.col("r")[1].alias("name"))


@query("SELECT o_orderkey::VARCHAR AS uid, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS start, CAST(floor(epoch(o_orderdate)) AS BIGINT) + 3600 AS stop FROM orders")
def calendar_round_trip(spark, d):
    @F.pandas_udf("array<struct<uid:string,start:long,stop:long>>")
    def trip(uid: pd.Series, start: pd.Series) -> pd.Series:
        def one(u, s):
            entries = parse_calendar(write_calendar([{"kind": "event", "uid": u, "summary": "a; b, c", "start": int(s), "end": int(s) + 3600}]))
            return [{"uid": e["uid"], "start": e["start"], "stop": e["end"]} for e in entries]

        return pd.Series([one(u, s) for u, s in zip(uid, start)])

    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("u"), F.unix_timestamp(F.to_timestamp("o_orderdate")).alias("s"))
    return o.select(F.explode(trip("u", "s")).alias("x")).select("x.*")


@query("SELECT o_orderkey, 'invoice' AS kind, CAST(round(o_totalprice * 100) AS BIGINT) AS total, CAST(round(o_totalprice * 100) AS BIGINT) = CAST(round(o_totalprice * 90) AS BIGINT) + CAST(round(o_totalprice * 10) AS BIGINT) AS consistent FROM orders")
def invoice_parse(spark, d):
    @F.pandas_udf("kind string, total long, consistent boolean")
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = [(invoices.detect(t), invoices.parse(t)) for t in texts]
        return pd.DataFrame({"kind": [k for k, _ in rows], "total": [p.get("total") for _, p in rows], "consistent": [p["consistent"] for _, p in rows]})

    money = lambda c: F.format_string("EUR %.2f", c)
    price = F.col("o_totalprice")
    text = F.concat(F.lit("Invoice number: "), F.col("o_orderkey").cast("string"), F.lit("\nSubtotal: "), money(F.round(price * 90) / 100), F.lit("\nVAT: "), money(F.round(price * 10) / 100), F.lit("\nTotal: "), money(F.round(price * 100) / 100), F.lit("\nAmount due by due date"))
    o = table(spark, d, "orders")
    return o.select("o_orderkey", read(text).alias("x")).select("o_orderkey", "x.*")


@query("SELECT o_custkey, count(*) AS invoices, list_sort(list(o_orderkey))::VARCHAR AS items, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def invoice_listing(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP_NTZ '1995-01-01'")
    items = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ", "), F.lit("]"))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("invoices"), items.alias("items"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id * 100 + event_id % 5 END ORDER BY event_id) AS r, event_id % 7 = 0 AS free FROM events) WHERE r = 1 OR free")
def dedupe_null_keys(spark, d):
    e = table(spark, d, "events").withColumn("key", F.when(F.col("event_id") % 7 != 0, F.col("user_id") * 100 + F.col("event_id") % 5))
    return dedupe(e, "key", "event_id").select("event_id")


@query("SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def event_log_since(spark, d):
    return since(table(spark, d, "events").select("event_id", "event_type"), 100, 50)


@query("WITH e AS (SELECT * FROM events WHERE event_type <> 'view') SELECT event_id FROM e WHERE event_id IN (SELECT event_id FROM e ORDER BY event_id DESC LIMIT 5000) AND ts >= (SELECT max(ts) FROM e) - INTERVAL '20 days'")
def event_retention(spark, d):
    """Of a log with gaps between its ids."""
    e = table(spark, d, "events").filter("event_type <> 'view'")
    return retain(e, now=e.agg(F.max("ts")).first()[0], rows=5000, days=20).select("event_id")


@query("""WITH q AS (SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT % 3 * 100 AS priority, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), due AS (SELECT id FROM q WHERE sec <= 1705000000 ORDER BY priority, sec, id LIMIT 40)
SELECT id, CASE WHEN id IN (SELECT id FROM due) THEN 'leased' ELSE 'pending' END AS state, CAST(CASE WHEN id IN (SELECT id FROM due) THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM q""")
def queue_lease(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.get_json_object("props", "$.k").cast("long") % 3 * 100).alias("priority"), F.unix_timestamp(F.to_timestamp("ts")).alias("at"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("lease_until"))
    return lease(q, 1_705_000_000, 40).select("id", "state", "attempts")


@query("SELECT n, least(30 * CAST(pow(2, n - 1) AS BIGINT), 1800) AS wait FROM (SELECT unnest(range(1, 9)) AS n)")
def queue_backoff(spark, d):
    return spark.range(1, 9).select(F.col("id").alias("n"), backoff(F.col("id")).alias("wait"))


@query("SELECT a.conv_id, a.turn FROM conversations a WHERE a.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn)")
def waiting_on(spark, d):
    """Messages that no later one in the thread follows."""
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.filter("role = 'user'").join(last, "conv_id").filter("turn = last").select("conv_id", "turn")


@query("SELECT conv_id, turn, root, CASE WHEN turn = root THEN 'root' ELSE 'reply' END AS place FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS root FROM conversations)")
def thread_roots(spark, d):
    c = table(spark, d, "conversations")
    root = F.min("turn").over(Window.partitionBy("conv_id"))
    return c.select("conv_id", "turn", root.alias("root"), F.when(F.col("turn") == root, "root").otherwise("reply").alias("place"))


@query()
def normalised_texts(spark, d):
    from lettermill.functions.text import detect_language, normalise_text

    @F.pandas_udf("text string, language string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            t = s.map(normalise_text)
            yield pd.DataFrame({"text": t, "language": t.map(detect_language)})

    return table(spark, d, "documents").select("doc_id", run("text").alias("x")).select("doc_id", F.sha2("x.text", 256).alias("hash"), "x.language")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN CASE WHEN html IS NULL THEN 'empty' ELSE 'ok' END WHEN 1 THEN 'empty' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'encrypted' WHEN 4 THEN 'failed' ELSE 'too_large' END AS status,
 CASE WHEN page_id % 6 = 0 THEN sha256('Source: ' || html) END AS hash FROM pages""")
def attachment_texts(spark, d):
    """Pages as attachments of every status: text files, empty ones, archives, sealed ones, broken ones and large ones."""
    sixth, html = F.col("page_id") % 6, F.col("html").cast("string")
    content = F.when(sixth == 0, F.concat(F.lit("Source: "), html).cast("binary")).when(sixth == 1, F.lit("").cast("binary")).when(sixth == 2, F.lit(b"PK\x03\x04 and more")).when(sixth == 3, F.lit(b"\xd0\xcf\x11\xe0 and more")).when(sixth == 4, F.lit(b"caf\xe9")).otherwise(F.lit(b"x" * 200_001))
    files = table(spark, d, "pages").select("page_id", F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".TXT")).alias("name"), content.alias("content"))
    return attachments.texts(files, "name", "content", most=200_000).select("page_id", "status", F.sha2("text", 256).alias("hash"))


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def table_writes(spark, d):
    """Written, replaced and appended to, then read back."""
    import uuid

    from lettermill.session import shared_dir

    path = f"{shared_dir(spark)}/lettermill/writes-{uuid.uuid4().hex[:8]}"
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    dear = o.filter("o_totalprice > 200000")
    write(dear, path)
    write(o, path, "overwrite")
    write(dear, path)
    return spark.read.parquet(path)


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'leased' ELSE 'pending' END AS state, CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM events WHERE NOT (event_type = 'click' AND event_id % 2 = 0)")
def queue_enqueue(spark, d):
    """Views wait already; clicks are done, every other one with what they held before."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("embed").alias("kind"), F.concat_ws("/", "event_type", "user_id").alias("hash"), "event_type")
    queue = e.filter("event_type = 'view'").select("id", "kind", F.lit("leased").alias("state"), F.lit(1).alias("attempts"))
    done = e.filter("event_type = 'click'").select("id", "kind", F.when(F.col("id") % 2 == 0, F.col("hash")).otherwise("old").alias("hash"))
    return enqueue(queue, e.drop("event_type"), done).select("id", "state", "attempts")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS v FROM lineitem), n AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS v FROM lineitem WHERE l_returnflag <> 'R'),
e AS (SELECT a.v AS src, b.v AS dst, count(*) AS weight FROM a JOIN a b ON a.d = b.d AND a.v < b.v GROUP BY 1, 2)
SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM n x JOIN n y ON x.d = y.d WHERE x.v = e.src AND y.v = e.dst)""")
def edges_to_drop(spark, d):
    """Pairs of parts that stood together only in orders of which one of them came back."""
    from lettermill.operators.mining import cooccurrence, orphan_edges

    m = table(spark, d, "lineitem")
    return orphan_edges(cooccurrence(m, "l_orderkey", "l_partkey"), m.filter("l_returnflag <> 'R'"), "l_orderkey", "l_partkey")
