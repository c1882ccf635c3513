"""A spool of request files as a data source, in batch and as a stream.

``spark.dataSource.register(RequestFiles)``, then ``spark.read.format("rerank_requests").load(folder)`` or
``spark.readStream.format("rerank_requests").load(folder)``. A file is one request: a JSON object with query,
documents (texts, or objects with text, original_index and similarity), and perhaps policy_id and top_n. The rows
are what ``plans.api.rerank`` takes. Whoever writes the spool names files in ascending order and moves them in
whole, so the stream's offset is the last name it has read: a restart goes on behind it, losing and repeating nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "query_id string, query string, request_index int, original_index long, text string, similarity double, policy_id string, top_n int, error string"


@dataclass
class File(InputPartition):
    name: str


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def names(path: str) -> list[str]:
    """The spool's request files, in order."""
    from pyarrow import fs

    system, folder = _folder(path)
    found = system.get_file_info(fs.FileSelector(folder))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".json") and not f.base_name.startswith((".", "_")))


def rows_of(name: str, source: bytes) -> Iterator[tuple]:
    """Request rows of a file; one that can't be read gives one row with its error and no document."""
    query_id = name.removesuffix(".json")
    try:
        said = json.loads(source)
        query, policy, top = said["query"], said.get("policy_id"), said.get("top_n")
        docs = [d if isinstance(d, dict) else {"text": d} for d in said["documents"]]
        made = [(query_id, query, i, int(d.get("original_index", i)), str(d["text"]), None if d.get("similarity") is None else float(d["similarity"]), policy, None if top is None else int(top), None) for i, d in enumerate(docs)]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        made = [(query_id, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
    yield from made


class _Reads:
    def __init__(self, path: str):
        self.path = path

    def read(self, partition: File) -> Iterator[tuple]:
        system, folder = _folder(self.path)
        with system.open_input_stream(f"{folder}/{partition.name}") as f:
            yield from rows_of(partition.name, f.read())


class _Batch(_Reads, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [File(n) for n in names(self.path)]


class _Stream(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        found = names(self.path)
        return {"last": found[-1] if found else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [File(n) for n in names(self.path) if start["last"] < n <= end["last"]]

    def commit(self, end: dict) -> None:
        pass  # files stay: the checkpoint knows how far the stream has read


class RequestFiles(DataSource):
    """Option ``path``: the spool's folder, which driver and executors can read."""

    @classmethod
    def name(cls) -> str:
        return "rerank_requests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])
