"""A paged service that fails at times, as batch and stream; writes in chunks that fail at times."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from reefline.operators import chunks
from reefline.sources import paged


class Stub:
    """Records by id; every third request is refused, every seventh answered with a failure."""

    def __init__(self):
        self.rows, self.asked, self.fails = {}, 0, True
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                stub.asked += 1
                code = 429 if stub.fails and stub.asked % 3 == 0 else 503 if stub.fails and stub.asked % 7 == 0 else 200
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                if q.get("broken"):
                    code = 404
                rows = sorted(stub.rows.values(), key=lambda r: (r["updated_at"], r["id"]))
                latest = rows[-1]["updated_at"] if rows else None
                rows = [r for r in rows if r["updated_at"] > q.get("changed_since", "")]
                page, size = int(q["page"]), int(q["limit"])
                body = json.dumps({"data": rows[(page - 1) * size : page * size], "meta": {"latest": latest}}).encode()
                self.send_response(code)
                if code == 429:
                    self.send_header("Retry-After", "0.01")
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/sites"

    def put(self, *ids, at):
        self.rows |= {i: {"id": i, "updated_at": at, "name": f"n{i}@{at}"} for i in ids}


@pytest.fixture
def stub():
    made = Stub()
    yield made
    made.server.shutdown()


def options(reader, stub, **more):
    for k, v in {"url": stub.url, "pageSize": 7, "readers": 3, "wait": 0.01, "attempts": 12, **more}.items():
        reader = reader.option(k, str(v))
    return reader


def test_batch(spark, stub):
    spark.dataSource.register(paged.PagedSource)
    for n in (0, 1, 7, 21, 50):
        stub.rows.clear()
        stub.put(*range(n), at="2024-01-01")
        got = options(spark.read.format("paged"), stub).load()
        assert sorted(int(r.id) for r in got.collect()) == list(range(n))
    stub.put(3, 4, at="2024-02-01")
    since = options(spark.read.format("paged"), stub, changedSince="2024-01-01").load()
    assert sorted(tuple(r) for r in paged.parsed(since, "id long, name string, other int").collect()) == [(3, "n3@2024-02-01", None), (4, "n4@2024-02-01", None)]
    with pytest.raises(Exception, match="404"):
        options(spark.read.format("paged"), stub, url=stub.url + "?broken=1").load().collect()


def test_stream(spark, stub, tmp_path):
    """What changes between batches comes once, with the batch whose mark it lies under."""
    spark.dataSource.register(paged.PagedSource)

    def run():
        df = options(spark.readStream.format("paged"), stub).load()
        df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((int(r.id), r.updated_at) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    stub.put(*range(20), at="2024-01-01")
    first = [(i, "2024-01-01") for i in range(20)]
    assert run() == first
    assert run() == first
    stub.put(5, 30, at="2024-01-02")
    assert run() == sorted([*first, (5, "2024-01-02"), (30, "2024-01-02")])


def test_newer_than_the_mark_waits(stub):
    stub.fails = False
    stub.put(1, at="a")
    reader = paged._StreamReader(paged.Service.of({"url": stub.url, "readers": "2", "pageSize": "2"}), None)
    end = reader.latestOffset()
    stub.put(2, at="b")  # changes after the mark was taken
    take = lambda s, e: [r[0] for p in reader.partitions(s, e) for r in reader.read(p)]
    assert take(reader.initialOffset(), end) == ["1"] and take(end, reader.latestOffset()) == ["2"]
    assert reader.partitions(end, end) == []


def test_chunks_are_bounded_and_whole(spark):
    ids = [(k * 7 % 1003, k) for k in range(2500)] + [(None, 1)]
    placed = chunks.numbered(spark.createDataFrame(ids, "id long, v long").repartition(5), "id", 100).collect()
    distinct = sorted({i for i, _ in ids if i is not None})
    assert sorted((r.id, r.chunk) for r in placed) == [(i, k // 100) for k, i in enumerate(distinct)]
    assert chunks.numbered(spark.createDataFrame([], "id long"), "id").collect() == []


def test_a_chunk_that_fails_is_repeated_alone(spark, tmp_path):
    folder = str(tmp_path)

    def sink(chunk, ids, rows):
        tries = len([f for f in os.listdir(folder) if f.startswith(f"try-{chunk}-")])
        open(f"{folder}/try-{chunk}-{tries}", "w").close()
        if chunk == 1 and tries < 2 or chunk == 2 and not os.path.exists(f"{folder}/open"):
            raise OSError("no answer")
        with open(f"{folder}/chunk-{chunk}", "w") as f:
            json.dump([ids, sorted(rows["v"].tolist())], f)

    rows = spark.range(25).select("id", (F.col("id") * 10).alias("v"))
    rows = rows.unionByName(rows.where("id = 3").withColumn("v", F.lit(31).cast("long")))
    gone = spark.createDataFrame([(100,)], "id long")
    done = chunks.write_chunks(rows, "id", sink, size=10, wait=0.0, removed=gone)
    assert sorted(tuple(r) for r in done.collect()) == [(0, 10, 11, 1, None), (1, 10, 10, 3, None), (2, 6, 5, 3, "OSError: no answer")]
    assert [r.chunk for r in chunks.failed(done).collect()] == [2]
    open(f"{folder}/open", "w").close()
    again = chunks.write_chunks(rows, "id", sink, size=10, wait=0.0, removed=gone, only=chunks.failed(done))
    assert [tuple(r) for r in again.collect()] == [(2, 6, 5, 1, None)]
    assert json.load(open(f"{folder}/chunk-2")) == [[20, 21, 22, 23, 24, 100], [200, 210, 220, 230, 240]]
    assert len([f for f in os.listdir(folder) if f.startswith("try-0-")]) == 1
