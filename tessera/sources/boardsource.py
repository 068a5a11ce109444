"""Job boards as a data source: spark.read.format("job_boards"), and readStream for polls of the same boards.

Options: boards, a JSON list of [platform, token]; tasks, the partitions that the boards are dealt to (default: one a board);
apart, least seconds between two calls of a partition (default 0.2), so that all of them never exceed tasks / apart calls a
second; wait, the first wait before a failing server is asked again; base, an address that stands for the platforms' own.
"""

from __future__ import annotations

import json
import time
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import live

SCHEMA = "platform string, token string, found boolean, payload string"


@dataclass
class Share(InputPartition):
    """The boards of one task, and the poll that asks for them."""

    boards: tuple[tuple[str, str], ...]
    poll: int = 0


class _Asking:
    def __init__(self, options: dict[str, str]):
        self.boards = [(str(p), str(t)) for p, t in json.loads(options.get("boards", "[]"))]
        unknown = sorted({p for p, _ in self.boards} - set(live.BOARDS))
        if unknown:
            raise ValueError(f"no such platforms: {', '.join(unknown)}")
        self.tasks = int(options.get("tasks", max(1, len(self.boards))))
        self.apart, self.wait, self.base = float(options.get("apart", 0.2)), float(options.get("wait", live.WAIT)), options.get("base")

    def shares(self, poll: int = 0) -> list[Share]:
        n = max(1, min(self.tasks, len(self.boards)))
        return [Share(tuple(self.boards[i::n]), poll) for i in range(n)]

    def _get(self, url: str, headers: dict[str, str]) -> tuple[int, bytes]:
        if self.base:
            at = urllib.parse.urlsplit(url)
            url = self.base.rstrip("/") + at.path + (f"?{at.query}" if at.query else "")
        return live.over_http(url, headers)

    def rows(self, share: Share) -> Iterator[tuple]:
        last = None
        for platform, token in share.boards:
            if last is not None:
                time.sleep(max(0.0, last + self.apart - time.monotonic()))
            last = time.monotonic()
            payload = live.board(platform, token, self._get, wait=self.wait)
            yield platform, token, payload is not None, None if payload is None else json.dumps(payload)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.asking = _Asking(options)

    def partitions(self) -> list[Share]:
        return self.asking.shares()

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.asking.rows(partition)


class Polls(DataSourceStreamReader):
    """A batch asks for every board once. The offset is the poll's time in milliseconds, so that it grows over restarts, after
    which an unfinished batch alone is repeated."""

    def __init__(self, options: dict[str, str]):
        self.asking = _Asking(options)
        self.poll = 0

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        self.poll = max(self.poll + 1, time.time_ns() // 1_000_000)
        return {"poll": self.poll}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.asking.shares(end["poll"])

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.asking.rows(partition)


class JobBoards(DataSource):
    """(platform, token, found, payload) of each board; found is false, and payload null, where the platform says that there is no
    such board. A platform that still fails after all attempts fails its task, which Spark runs again, and no other."""

    @classmethod
    def name(cls) -> str:
        return "job_boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> Polls:
        return Polls(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JobBoards)
