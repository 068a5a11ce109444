"""Job boards as a data source, against a server of this machine that counts what it is asked."""

import json
import re
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessera.sources import boardsource, live


@pytest.fixture
def server():
    asked, failing = [], Counter()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            token = self.path.split("?")[0].rstrip("/").split("/")[-2 if self.path.endswith(("/jobs", "/postings")) else -1]
            asked.append((token, time.monotonic()))
            down, none = failing[token] > 0, token.startswith("none")
            failing[token] -= down
            body = b"" if down or none else json.dumps({"jobs": [{"id": token}]}).encode()
            self.send_response(503 if down else 404 if none else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.asked, s.failing, s.base = asked, failing, f"http://127.0.0.1:{s.server_port}"
    yield s
    s.shutdown()


def options(server, boards, **more):
    return {"boards": json.dumps(boards), "base": server.base, "wait": "0.01", "apart": "0", **more}


BOARDS = [["greenhouse", "acme"], ["lever", "bolt"], ["ashby", "none1"], ["smartrecruiters", "cog"], ["lever", "Ü x/y"]]


def test_boards_are_read_once_each(spark, server):
    boardsource.register(spark)
    df = spark.read.format("job_boards").options(**options(server, BOARDS[:4])).load()
    assert df.rdd.getNumPartitions() == 4
    server.asked.clear()
    server.failing["bolt"] = 2  # answers at the third attempt
    got = {r["token"]: (r["platform"], r["found"], r["payload"] and json.loads(r["payload"])) for r in df.collect()}
    assert got["acme"] == ("greenhouse", True, {"jobs": [{"id": "acme"}]}) and got["none1"] == ("ashby", False, None) and got["bolt"][1]
    assert Counter(t for t, _ in server.asked) == {"acme": 1, "bolt": 3, "none1": 1, "cog": 1}


def test_a_failed_task_asks_again_for_its_part_only(server):
    reader = boardsource.Reader(options(server, BOARDS[:4], tasks="2"))
    one, two = reader.partitions()
    assert [t for _, t in one.boards] == ["acme", "none1"] and [t for _, t in two.boards] == ["bolt", "cog"]
    assert len(list(reader.read(one))) == 2
    server.failing["cog"] = 3  # all attempts of the first run
    with pytest.raises(live.Unavailable, match="after 3 attempts"):
        list(reader.read(two))
    server.asked.clear()
    assert [r[1:3] for r in reader.read(two)] == [("bolt", True), ("cog", True)]
    assert [t for t, _ in server.asked] == ["bolt", "cog"]


def test_a_platform_that_is_down_is_no_missing_board(spark, server):
    boardsource.register(spark)
    server.failing["acme"] = 99
    with pytest.raises(Exception, match="after 3 attempts"):
        spark.read.format("job_boards").options(**options(server, BOARDS[:2])).load().collect()


def test_calls_of_a_partition_keep_apart(server):
    reader = boardsource.Reader(options(server, [["lever", f"b{n}"] for n in range(4)], tasks="1", apart="0.2"))
    assert len(list(reader.read(reader.partitions()[0]))) == 4
    at = [t for _, t in server.asked]
    assert min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.15


def test_no_boards_and_wrong_platforms(spark, server):
    boardsource.register(spark)
    assert spark.read.format("job_boards").options(**options(server, [])).load().count() == 0
    with pytest.raises(ValueError, match="no such platforms: myspace"):
        boardsource.Reader({"boards": '[["myspace", "x"]]'})


def test_polls_count_on_after_a_restart(spark, server, tmp_path):
    boardsource.register(spark)

    def polled(seconds):
        stream = spark.readStream.format("job_boards").options(**options(server, BOARDS[:2])).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
        until = time.monotonic() + seconds
        while time.monotonic() < until and (not q.lastProgress or q.lastProgress["batchId"] < 1 + polled.batch) and q.isActive:
            time.sleep(0.2)
        last = q.lastProgress
        q.stop()
        assert q.exception() is None
        return last

    polled.batch = 0
    first = polled(40)
    polled.batch = first["batchId"] + 1
    second = polled(40)
    poll = lambda p: int(re.search(r"\d+", str(p["sources"][0]["endOffset"]))[0])
    assert second["batchId"] > first["batchId"] and poll(second) > poll(first)
    per = Counter(r["token"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert per["acme"] == per["bolt"] >= 3


def test_companies_are_probed_in_tasks(spark):
    def get(url, headers):
        return (200, b'{"jobs": [{"id": "1"}]}') if "ashby" in url and "acme" in url else (404, b"")

    rows = spark.createDataFrame([("Acme", ["none", "acme"]), ("Void", ["void"]), ("Null", None), (None, [None, "acme"])], "company string, slugs array<string>")
    got = {r["company"]: (r["platform"], r["token"]) for r in live.probed(rows, get, tasks=2).collect()}
    assert got == {"Acme": ("ashby", "acme"), "Void": (None, None), "Null": (None, None), None: ("ashby", "acme")}
