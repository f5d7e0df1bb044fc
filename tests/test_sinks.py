"""The library's own sinks: what tasks leave behind, failed writes, folding and escapes."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.sources import sinks

ENTRY = "uid string, title string, start timestamp_ntz, minutes long, all_day boolean, notes string, alarm long"


def test_folding_and_escapes():
    line = "X" * 73 + "Y" * 72 + "Z"
    assert sinks.folded(line).split("\r\n") == ["X" * 73, " " + "Y" * 72, " Z"] and sinks.folded("short") == "short" and sinks.folded("") == ""
    assert sinks.escaped("a,b;c\\d\ne\r\nf") == "a\\,b\\;c\\\\d\\ne\\nf"


def test_calendar_text(spark, tmp_path):
    sinks.register(spark)
    when = datetime.datetime(2024, 2, 28, 23, 50)
    rows = [("1", "a, b; c\\n d\nnext", when, None, False, None, None), ("2", "t" * 200, when, 5, True, "n, " * 60, 30), ("3", "no start", None, 5, False, None, None), ("4", None, when, 90, False, "", 0)]
    home = f"file://{tmp_path}/cal"
    spark.createDataFrame(rows, ENTRY).repartition(3).write.format("calendar_text").option("name", "x,y").mode("append").save(home)
    files = list(Path(tmp_path, "cal").iterdir())
    assert files and all(f.name.startswith("part-") and f.suffix == ".ics" for f in files)
    for f in files:
        lines = f.read_bytes().decode().split("\r\n")
        assert lines[0] == "BEGIN:VCALENDAR" and lines[-2:] == ["END:VCALENDAR", ""] and max(map(len, lines)) <= 73
    got = {r["uid"]: r for r in sinks.read_entries(spark, home).collect()}
    assert set(got) == {"1", "2", "4"} and got["1"]["title"] == "a, b; c\\n d\nnext" and got["1"]["start"] == "20240228T235000" and got["1"]["end"] == "20240229T000500"
    assert got["2"]["title"] == "t" * 200 and got["2"]["start"] == "VALUE=DATE:20240228" and got["2"]["end"] == "VALUE=DATE:20240229" and got["2"]["notes"].startswith("n, n, ") and got["2"]["alarm"] == "30" and got["4"]["end"] == "20240229T012000"
    with pytest.raises(Exception, match="need the columns"):
        spark.createDataFrame([("1",)], "uid string").write.format("calendar_text").mode("append").save(home)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    sinks.register(spark)
    home = f"file://{tmp_path}/log"
    good = spark.range(50).select("id", (F.col("id") % 7).alias("k"))
    good.write.format("record_log").mode("append").save(home)
    before = sorted(p.name for p in Path(tmp_path, "log").iterdir())
    bad = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") < 3500, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id"), F.lit(1).alias("k"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("record_log").mode("append").save(home)
    assert sorted(p.name for p in Path(tmp_path, "log").iterdir()) == before
    newest = sinks.merged(spark, home, "id long, k long", "k", "id").collect()
    assert sorted((r["k"], r["id"]) for r in newest) == [(k, max(i for i in range(50) if i % 7 == k)) for k in range(7)]
    spark.range(2).select("id", F.lit(None).cast("long").alias("k")).write.format("record_log").mode("overwrite").save(home)
    assert [(r["k"], r["id"]) for r in sinks.merged(spark, home, "id long, k long", "k", "id").collect()] == [(None, 1)]
