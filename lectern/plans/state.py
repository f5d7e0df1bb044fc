"""State that changes: tombstones, tokens, limits, ages, incremental plans, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import state as S
from lectern.registry import query


# The window of a hit follows from the hit before it, so the plain form goes along each key.
_LIMITED = """
WITH RECURSIVE h AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
r AS (SELECT key, ms, id, i, ms AS start, 1::BIGINT AS n FROM h WHERE i = 1
  UNION ALL SELECT h.key, h.ms, h.id, h.i, CASE WHEN r.start <= h.ms - 3600000 THEN h.ms ELSE r.start END, CASE WHEN r.start <= h.ms - 3600000 THEN 1 ELSE r.n + 1 END FROM r JOIN h ON h.key = r.key AND h.i = r.i + 1)
SELECT key, ms, id, n AS count, n <= 5 AS allowed FROM r"""


@query("rate_limited_stream", "T1 T3", _LIMITED)
def rate_limited_stream(t):
    """The rate limit as a stream whose state expires with the windows."""
    from lectern.sources.files import work_folder
    from lectern.streaming.rates import drained, rate_limit

    # a stream reads a table that is one file only by a pattern
    events = t.spark.readStream.schema(t("events").schema).parquet(f"{t.folder}/events.parque[t]")
    hits = events.select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("id"))
    return drained(rate_limit(hits, 5, 3_600_000), work_folder(t.spark))


@query("tokens_stream", "T6 T3", """
WITH u AS (SELECT user_id AS token, epoch_us(ts) // 1000 AS ms, event_id AS id, epoch_us(date_trunc('day', ts)) // 1000 AS issued FROM events),
f AS (SELECT token, min(ROW(ms, id)) AS m FROM u WHERE ms < issued + 900000 GROUP BY 1)
SELECT token, ms, id, coalesce(m[1] = ms AND m[2] = id, false) AS accepted FROM u LEFT JOIN f USING (token)""")
def tokens_stream(t):
    """Tokens that count once, within a quarter of an hour after they are given out, as a stream."""
    from lectern.sources.files import work_folder
    from lectern.streaming.rates import drained, one_time

    events = t.spark.readStream.schema(t("events").schema).parquet(f"{t.folder}/events.parque[t]")
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    uses = events.select(F.col("user_id").alias("token"), ms(F.col("ts")).alias("ms"), F.col("event_id").alias("id"), ms(F.date_trunc("day", "ts")).alias("issued"))
    # a token here is one user, so it is remembered as long as the table spans
    return drained(one_time(uses, 900_000), work_folder(t.spark))


@query("rate_limited", "T1", _LIMITED)
def rate_limited(t):
    e = t("events").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("id"))
    return S.rate_limited(e, 5, 3_600_000)


@query("expired_dropped", "T3 M62", "SELECT event_type, count(*) AS live FROM events WHERE ts >= TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 7 DAY GROUP BY 1")
def expired(t):
    return S.fresh(t("events"), "ts", "2024-01-28 00:00:00", "7 DAYS").groupBy("event_type").agg(F.count("*").alias("live"))


@query("tombstones_win", "T4", """
WITH d AS (SELECT o_orderkey, 50 AS deleted_at FROM orders WHERE o_orderkey % 7 = 0)
SELECT o.o_orderkey, CASE WHEN d.deleted_at IS NULL THEN o.o_custkey ELSE greatest(d.deleted_at, o.o_custkey + 1) END AS updated_at, CASE WHEN d.deleted_at IS NULL THEN o_orderstatus END AS data FROM orders o LEFT JOIN d USING (o_orderkey)""")
def tombstones(t):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("updated_at"), F.col("o_orderstatus").alias("data"))
    return S.tombstones(o, t("orders").where("o_orderkey % 7 = 0").select("o_orderkey", F.lit(50).cast("long").alias("deleted_at")), "o_orderkey")


@query("one_time_tokens", "T6 T8", "SELECT user_id AS token, min(ROW(ts, event_id))[2] AS event_id FROM events WHERE event_type = 'click' GROUP BY 1")
def tokens(t):
    return S.first_use(t("events").where("event_type = 'click'").withColumnRenamed("user_id", "token"), "token", ["ts", "event_id"]).select("token", "event_id")


@query("conditional_upsert", "T5 T15 S19", """
WITH s AS (SELECT user_id, max(event_id) AS stamp FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id, max(event_id) - 40 AS stamp FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT coalesce(s.user_id, n.user_id) AS user_id, CASE WHEN n.stamp > s.stamp OR s.stamp IS NULL THEN n.stamp ELSE s.stamp END AS stamp, CASE WHEN n.stamp > s.stamp OR s.stamp IS NULL THEN 'new' ELSE 'old' END AS side FROM s FULL JOIN n ON s.user_id = n.user_id""")
def conditional(t):
    e = t("events")
    stored = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("stamp")).withColumn("side", F.lit("old"))
    new = e.where("event_id % 3 = 0").groupBy("user_id").agg((F.max("event_id") - 40).alias("stamp")).withColumn("side", F.lit("new"))
    return S.upsert_newer(stored, new, ["user_id"], "stamp")


@query("incremental_plan", "T10 T11 M37 M38 M39", """
WITH old AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE doc_id % 9 <> 0), new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS s, text FROM documents WHERE doc_id % 8 <> 0)
SELECT CASE WHEN new.doc_id IS NULL THEN 'gone' WHEN old.doc_id IS NULL THEN 'new' WHEN old.s = new.s THEN 'same' ELSE 'changed' END AS step, count(*) AS n FROM old FULL JOIN new ON old.doc_id = new.doc_id GROUP BY 1""")
def incremental(t):
    from lectern.operators.ingest import classify

    d = t("documents")
    old = d.where("doc_id % 9 <> 0").select("doc_id", F.sha2("text", 256).alias("check"))
    new = d.where("doc_id % 8 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("check"))
    return classify(old, new, "doc_id").groupBy("step").agg(F.count("*").alias("n"))


@query("kept_still_valid", "T14 T16 T18", """
WITH k AS (SELECT doc_id, substr(sha256(text), 1, 32) AS "check" FROM documents WHERE doc_id % 2 = 0)
SELECT d.doc_id, CASE WHEN k."check" IS NULL THEN 'missing' WHEN k."check" = substr(sha256(d.text || CASE WHEN d.doc_id % 10 = 0 THEN ' ' ELSE '' END), 1, 32) THEN 'kept' ELSE 'stale' END AS state FROM documents d LEFT JOIN k USING (doc_id)""")
def kept(t):
    k = t("documents").where("doc_id % 2 = 0").select("doc_id", X.checksum(F.array("text")).alias("check"))
    now = X.checksum(F.array(F.concat("text", F.when(F.col("doc_id") % 10 == 0, " ").otherwise(""))))
    d = t("documents").select("doc_id", now.alias("now")).join(k, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("check").isNull(), "missing").when(F.col("check") == F.col("now"), "kept").otherwise("stale").alias("state"))


@query("stale_jobs", "T19 T21 T22 M49 M66", "SELECT event_type, count(*) FILTER (TIMESTAMP '2024-01-28 00:00:00' - ts > INTERVAL 6 MINUTE AND event_type = 'view') AS failed, count(*) FILTER (value > 50) AS kept FROM events GROUP BY 1")
def stale(t):
    late = (F.lit("2024-01-28 00:00:00").cast("timestamp_ntz") - F.col("ts")) > F.expr("INTERVAL 6 MINUTES")
    return t("events").groupBy("event_type").agg(F.count_if(late & (F.col("event_type") == "view")).alias("failed"), F.count_if(F.col("value") > 50).alias("kept"))


@query("person_export", "S26 M63 M64", "SELECT event_id, event_type FROM events WHERE user_id IN (3, 7)")
def export(t):
    return t("events").where(F.col("user_id").isin(3, 7)).select("event_id", "event_type")


@query("carry_over", "S21", "SELECT l.doc_id, l.quality FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de') UNION ALL SELECT doc_id, 1 AS quality FROM documents WHERE lang = 'de'")
def carry_over(t):
    new = t("documents").where("lang = 'de'").select("doc_id", F.lit(1).alias("quality"))
    return t("labels").select("doc_id", "quality").join(new, "doc_id", "left_anti").unionByName(new)


@query("posts_delta", "S11", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'body of ' || s_name END AS body FROM supplier")
def posts_delta(t):
    """A listing of ids and dates is read first, then the bodies of what has changed since the last crawl."""
    import json

    from lectern.sources.files import work_folder
    from lectern.sources.posts import Posts, put_posts

    folder = work_folder(t.spark)
    posts = t("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "2024-02-01").otherwise("2024-01-01").alias("modified"), F.concat(F.lit("body of "), "s_name").alias("content"))
    put_posts(posts, folder)
    t.spark.dataSource.register(Posts)
    listed = t.spark.read.format("posts").option("path", folder).load()
    changed = [r["id"] for r in listed.where("modified > '2024-01-15'").select("id").collect()]  # what one crawl fetches
    bodies = t.spark.read.format("posts").option("path", folder).option("ids", ",".join(map(str, changed))).option("bodies", "true").load()
    return listed.select("id").join(bodies.select("id", "body"), "id", "left")


@query("crawl_resumed", "T13", "SELECT o_orderkey % 5 AS part, count(*) AS n FROM orders GROUP BY 1")
def crawl_resumed(t):
    """A run that stops and goes on: what arrives between two runs is taken once, and nothing twice."""
    from lectern.operators.ingest import resume
    from lectern.sources.files import work_folder

    folder = work_folder(t.spark)
    orders = t("orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("part"))
    put = lambda df, n: df.write.mode("append").parquet(f"{folder}/kept")
    for share in ("part < 2", "part >= 2"):
        orders.where(share).write.mode("append").parquet(f"{folder}/found")
        for _ in range(2):
            resume(t.spark, f"{folder}/found", "o_orderkey long, part long", f"{folder}/state", put)
    return t.spark.read.parquet(f"{folder}/kept").groupBy("part").agg(F.count("*").alias("n"))
