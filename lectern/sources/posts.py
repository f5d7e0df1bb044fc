"""A REST-like source as a Python data source: ids and dates first, bodies only for what a crawl still needs.

Offline it reads pages of a listing from files; a server would be asked the same two questions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _read(folder: str, name: str) -> object:
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    with system.open_input_stream(f"{path}/{name}") as f:
        return json.loads(f.read())


def put_posts(posts: DataFrame, folder: str) -> None:
    """Posts (id, modified, content) as the files that the source reads: one for each, written by the tasks, and the listing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_output_stream(f"{path}/{row['id']}.json") as f:
                    f.write(json.dumps({"content": row["content"]}).encode())
            yield batch.select(["id", "modified"])

    # a listing is what the other side sends at once: ids and dates
    listing = [{"id": r["id"], "modified": r["modified"]} for r in posts.select("id", "modified", "content").mapInArrow(run, "id long, modified string").toLocalIterator()]
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_output_stream(f"{path}/listing.json") as f:
        f.write(json.dumps(listing).encode())


class Posts(DataSource):
    """Options: path (folder with listing.json and one JSON file for each id), ids (comma-separated; all if absent),
    bodies ("true" to fetch them), batch (ids of one partition, 50 by default)."""

    @classmethod
    def name(cls) -> str:
        return "posts"

    def schema(self) -> str:
        return "id long, modified string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Batch(InputPartition):
    def __init__(self, ids: list[int]):
        super().__init__(0)
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bodies = options["path"], options.get("bodies", "false") == "true"
        self.batch = int(options.get("batch", "50"))
        self.ids = [int(x) for x in options["ids"].split(",")] if options.get("ids") else None

    def _listing(self) -> dict[int, str]:
        return {int(p["id"]): p["modified"] for p in _read(self.path, "listing.json")}

    def partitions(self) -> list[_Batch]:
        ids = sorted(self._listing() if self.ids is None else self.ids)
        return [_Batch(ids[n : n + self.batch]) for n in range(0, len(ids), self.batch)]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        known = self._listing()
        for i in partition.ids:
            if i not in known:
                continue
            yield i, known[i], _read(self.path, f"{i}.json")["content"] if self.bodies else None
