"""Sinks written in Python for Spark's data source API: calendar text, and records that are appended and then merged.

A task writes files under names of its own into a folder of the write; only the names in the messages of tasks that ended well are
moved into place on commit, and what failed or repeated tasks left is deleted with the folder. Files go through
Arrow's file systems, so the address may be of any store that driver and executors share.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Characters of a line of calendar text before it is folded.
WIDTH = 73


def folded(line: str, width: int = WIDTH) -> str:
    """A content line cut after ``width`` characters; what follows begins with a space that counts as one of them."""
    parts = [line[:width]] + [" " + line[k : k + width - 1] for k in range(width, len(line), width - 1)]
    return "\r\n".join(parts)


def escaped(text: str) -> str:
    for plain, written in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        text = text.replace(plain, written)
    return text


def entry_lines(row: Row, stamp: str) -> list[str]:
    """The content lines of one entry (uid, title, start, minutes, all_day, notes, alarm); a null start gives none."""
    if row["start"] is None:
        return []
    start, title = row["start"], escaped(row["title"] or "")
    if row["all_day"]:
        span = [f"DTSTART;VALUE=DATE:{start:%Y%m%d}", f"DTEND;VALUE=DATE:{start + datetime.timedelta(days=1):%Y%m%d}"]
    else:
        end = start + datetime.timedelta(minutes=15 if row["minutes"] is None else row["minutes"])
        span = [f"DTSTART:{start:%Y%m%dT%H%M}00", f"DTEND:{end:%Y%m%dT%H%M}00"]
    alarm = [] if row["alarm"] is None else ["BEGIN:VALARM", "ACTION:DISPLAY", f"DESCRIPTION:{title}", f"TRIGGER:-PT{max(0, round(row['alarm']))}M", "END:VALARM"]
    notes = [f"DESCRIPTION:{escaped(row['notes'])}"] if row["notes"] else []
    return ["BEGIN:VEVENT", f"UID:{row['uid']}", f"DTSTAMP:{stamp}", *span, f"SUMMARY:{title}", *notes, *alarm, "END:VEVENT"]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    rows: int


class _FileWriter(DataSourceWriter):
    """Files of a write, moved into place when all tasks have ended well."""

    suffix = ""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.home, self.options, self.overwrite = options["path"].rstrip("/"), options, overwrite
        self.write_id = uuid.uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.home)

    def head(self) -> list[str]:
        return []

    def tail(self) -> list[str]:
        return []

    def lines(self, row: Row) -> list[str]:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> Written:
        first = next(iterator, None)
        if first is None:
            return Written([], 0)
        system, path = self._at()
        system.create_dir(f"{path}/_writing-{self.write_id}", recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}{self.suffix}", 0
        with system.open_output_stream(f"{path}/_writing-{self.write_id}/{name}") as sink:
            put = lambda lines: sink.write("".join(f"{x}\r\n" if self.suffix == ".ics" else f"{x}\n" for x in lines).encode())
            put(self.head())
            row = first
            while row is not None:
                put(self.lines(row))
                rows += 1
                row = next(iterator, None)
            put(self.tail())
        return Written([name], rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = self._at()
        system.create_dir(path, recursive=True)
        old = [] if not self.overwrite else [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-")]
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{path}/_writing-{self.write_id}/{name}", f"{path}/{name}")
        for file in old:
            system.delete_file(file)
        self._clear(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._at())

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/_writing-{self.write_id}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/_writing-{self.write_id}")


class _CalendarWriter(_FileWriter):
    suffix = ".ics"

    def head(self) -> list[str]:
        return [folded(x) for x in ("BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{self.options.get('product', 'lectern')}//EN", "CALSCALE:GREGORIAN", f"X-WR-CALNAME:{escaped(self.options.get('name', ''))}")]

    def tail(self) -> list[str]:
        return ["END:VCALENDAR"]

    def lines(self, row: Row) -> list[str]:
        return [folded(x) for x in entry_lines(row, self.options.get("stamp", "19700101T000000Z"))]


class CalendarSink(DataSource):
    """``df.write.format("calendar_text").option("name", ...)``: each task's rows as a calendar file of its own.

    Columns: uid string, title string, start timestamp_ntz, minutes long, all_day boolean, notes string, alarm long.
    """

    @classmethod
    def name(cls) -> str:
        return "calendar_text"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"uid", "title", "start", "minutes", "all_day", "notes", "alarm"} - set(schema.names)
        if missing:
            raise ValueError(f"calendar entries need the columns {sorted(missing)}")
        return _CalendarWriter(dict(self.options), overwrite)


class _RecordWriter(_FileWriter):
    suffix = ".json"

    def lines(self, row: Row) -> list[str]:
        return [json.dumps(row.asDict(recursive=True), ensure_ascii=False, separators=(",", ":"), default=str)]


class RecordSink(DataSource):
    """``df.write.format("record_log").mode("append")``: one JSON object a line, null fields written as null."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RecordWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    for source in (CalendarSink, RecordSink):
        spark.dataSource.register(source)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(uid, title, start, end, notes, alarm) of calendar files, with folded lines joined and escapes undone."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.ics").select(F.regexp_replace("value", "\r?\n[ \t]", "").alias("t"))
    block = whole.select(F.explode(F.expr(r"regexp_extract_all(t, '(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT', 1)")).alias("b"))
    plain = F.regexp_replace("b", r"(?s)BEGIN:VALARM.*?END:VALARM\r?\n", "")
    one = lambda text, key: F.nullif(F.regexp_extract(text, rf"(?m)^{key}[:;]([^\r\n]*)", 1), F.lit(""))
    clear = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\([;,])", "$1"), r"\\\\", r"\\")
    return block.select(one(F.col("b"), "UID").alias("uid"), clear(one(plain, "SUMMARY")).alias("title"), one(F.col("b"), "DTSTART").alias("start"), one(F.col("b"), "DTEND").alias("end"), clear(one(plain, "DESCRIPTION")).alias("notes"), F.regexp_extract("b", r"TRIGGER:-PT(\d+)M", 1).alias("alarm"))


def merged(spark: SparkSession, log: str, schema: str, key: str, order: str) -> DataFrame:
    """The newest record of each key in a log; of equal order the greatest by all columns, so that reruns agree."""
    rows = spark.read.schema(schema).json(log, pathGlobFilter="*.json")
    newest = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(c) for c in rows.columns])
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
