"""What is written by the library's own sinks, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.registry import query
from lectern.sources import sinks
from lectern.sources.files import work_folder


@query("calendar_round_trip", "S23", r"""
SELECT 'e' || event_id || '@lectern' AS uid, event_type || ', user ' || user_id || '; ' || props || chr(10) || 'end' AS title,
  CASE WHEN event_id % 5 = 0 THEN 'VALUE=DATE:' || strftime(ts, '%Y%m%d') ELSE strftime(ts, '%Y%m%dT%H%M00') END AS start,
  CASE WHEN event_id % 5 = 0 THEN 'VALUE=DATE:' || strftime(ts + INTERVAL 1 DAY, '%Y%m%d') ELSE strftime(ts + to_minutes(CASE WHEN event_id % 3 = 0 THEN 15 ELSE 10 + event_id % 50 END), '%Y%m%dT%H%M00') END AS "end",
  CASE WHEN event_id % 2 = 0 THEN 'value ' || event_id || repeat(' and more, again', (event_id % 9)::INT) END AS notes, CASE WHEN event_id % 4 = 0 THEN (event_id % 60)::VARCHAR ELSE '' END AS alarm FROM events""")
def calendar_round_trip(t):
    """All events as calendar files, folded and escaped, and read back from them."""
    sinks.register(t.spark)
    n = F.col("event_id")
    e = t("events").select(
        F.concat(F.lit("e"), n, F.lit("@lectern")).alias("uid"), F.concat("event_type", F.lit(", user "), "user_id", F.lit("; "), "props", F.lit("\nend")).alias("title"), F.col("ts").cast("timestamp_ntz").alias("start"),
        F.when(n % 3 != 0, 10 + n % 50).alias("minutes"), (n % 5 == 0).alias("all_day"), F.when(n % 2 == 0, F.concat(F.lit("value "), n, F.expr("repeat(' and more, again', cast(event_id % 9 as int))"))).alias("notes"), F.when(n % 4 == 0, n % 60).alias("alarm"),
    )
    home = work_folder(t.spark)
    e.write.format("calendar_text").option("name", "events").mode("append").save(home)
    return sinks.read_entries(t.spark, home)


@query("record_log_merged", "S18 S19", """
WITH a AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(n, turn)::BIGINT AS n FROM a GROUP BY 1""")
def record_log_merged(t):
    """Turns appended to a log of records in two writes, and the newest record of each conversation from the log."""
    sinks.register(t.spark)
    rows = t("conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    home = work_folder(t.spark)
    for role in ("user", "assistant"):
        rows.where(F.col("role") == role).write.format("record_log").mode("append").save(home)
    rows.where("role is null or role not in ('user', 'assistant')").write.format("record_log").mode("append").save(home)
    return sinks.merged(t.spark, home, "conv_id long, turn long, role string, n long", "conv_id", "turn")
