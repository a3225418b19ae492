"""Cursor pages from a local server and from page files, in batches and as a stream that is stopped between; tables published by manifests."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tessera.sources.cursor import CursorSource, Folder
from tessera.sources.versions import Conflict, Versioned

SCHEMA = "id long, name string, _page int"


@pytest.fixture(scope="module")
def remote():
    """Forms with their rows, and a log of what was asked; every seventh answer asks to come again."""

    class Handler(BaseHTTPRequestHandler):
        forms, asked, n = {}, [], 0

        def do_GET(self):
            Handler.n += 1
            if Handler.n % 7 == 0:
                self.send_response(429)
                self.end_headers()
                return
            url = urlparse(self.path)
            q = {k: int(v[0]) for k, v in parse_qs(url.query).items()}
            Handler.asked.append((url.path[1:], q))
            rows = Handler.forms.get(url.path[1:], [])
            found = rows[-1:] if "last" in q else [r for r in rows if r["id"] > q.get("after", -(10**9))][: q["limit"]]
            body = json.dumps(found).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Handler, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def rows(a, b):
    return [{"id": i * 3, "name": f"n{i}"} for i in range(a, b)]


def test_pages_until_a_short_one(spark, remote):
    spark.dataSource.register(CursorSource)
    handler, base = remote
    handler.forms |= {"a": rows(0, 250), "b": rows(0, 200), "empty": []}
    read = spark.read.format("cursor_pages").schema(SCHEMA).option("base", base).option("key", "id").option("forms", "a,b,empty")
    got = sorted(map(tuple, read.load().collect()))
    assert got == sorted((r["id"], r["name"], i // 100) for f in ("a", "b") for i, r in enumerate(handler.forms[f]))
    assert [q for f, q in handler.asked if f == "a"] == [{"limit": 100}, {"limit": 100, "after": 297}, {"limit": 100, "after": 597}]
    split = read.option("forms", "a").option("bounds", "100,300").option("size", 20).load()
    assert split.rdd.getNumPartitions() == 3 and sorted(r.id for r in split.collect()) == [r["id"] for r in rows(0, 250)]


def test_a_stopped_stream_goes_on_after_the_last_id(spark, remote, tmp_path):
    spark.dataSource.register(CursorSource)
    handler, base = remote
    handler.forms |= {"s": rows(0, 130), "t": []}
    out = str(tmp_path / "rows")

    def run():
        stream = spark.readStream.format("cursor_pages").schema("id long, name string").option("base", base).option("key", "id").option("forms", "s,t").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.schema("id long, name string").parquet(out).collect())

    assert run() == [r["id"] for r in rows(0, 130)]
    handler.asked.clear()
    handler.forms |= {"s": rows(0, 145), "t": rows(0, 2)}
    assert run() == sorted([r["id"] for r in rows(0, 145)] + [0, 3])
    assert [q for f, q in handler.asked if f == "s" and "limit" in q] == [{"limit": 100, "after": 387}]
    assert run() == sorted([r["id"] for r in rows(0, 145)] + [0, 3])


def test_page_files(tmp_path):
    for first in (0, 30, 60):
        d = tmp_path / "f" / f"first={first}"
        d.mkdir(parents=True)
        (d / "part.json").write_text("\n".join(json.dumps({"id": i}) for i in range(first + 29, first - 1, -1)))
    f = Folder(tmp_path.as_uri(), "id")
    assert f.last("f") == 89 and f.last("none") is None and f.page("none", None, 5) == []
    ids = lambda after, n: [r["id"] for r in f.page("f", after, n)]
    assert ids(None, 40) == list(range(40)) and ids(39, 40) == list(range(40, 80)) and ids(79, 40) == list(range(80, 90)) and ids(89, 9) == [] and ids(-5, 2) == [0, 1]


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), ["k"], buckets=8)
    old = {i: f"v{i}" for i in range(200)}
    t.create(spark.createDataFrame(list(old.items()), "k int, v string"))
    before = t.manifest()
    reader = t.read()
    new = spark.createDataFrame([(3, "new"), (3000, None)], "k int, v string")
    t.upsert(new)
    after = t.manifest()
    touched = {r[0] for r in new.select(t._bucket()).collect()}
    assert {int(b) for b in after["files"] if after["files"][b] != before["files"].get(b)} == touched and len(touched) <= 2
    assert dict(map(tuple, t.read().collect())) == old | {3: "new", 3000: None}
    assert dict(map(tuple, t.read(1).collect())) == dict(map(tuple, reader.collect())) == old
    t.upsert(spark.createDataFrame([(3, "no"), (4, "yes")], "k int, v string"), guard=lambda: F.col("t.v") != "new")
    assert dict(map(tuple, t.read().collect())) == old | {3: "new", 3000: None, 4: "yes"}
    t.upsert(new.limit(0))
    assert t.version() == 3 and t.vacuum() == []


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = Versioned(spark, str(tmp_path / "t"), ["k"], buckets=4)
    t.create(spark.createDataFrame([(i, "a") for i in range(50)], "k int, v string"))
    rows = sorted(map(tuple, t.read().collect()))
    with pytest.raises(Exception, match="division by zero"):  # while files are written
        t.upsert(spark.createDataFrame([(i, "b") for i in range(50)], "k int, v string").withColumn("v", F.udf(lambda k: 1 / 0 and "" if k == 49 else "b")("k")))
    monkeypatch.setattr(Versioned, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):  # before the manifest
        t.upsert(spark.createDataFrame([(1, "c")], "k int, v string"))
    monkeypatch.undo()
    assert t.version() == 1 and sorted(map(tuple, t.read().collect())) == rows
    assert len(t.vacuum()) >= 1 and sorted(map(tuple, t.read().collect())) == rows


def test_of_two_writers_one_wins(spark, tmp_path):
    t, u = (Versioned(spark, str(tmp_path / "t"), ["k"], buckets=4) for _ in range(2))
    t.create(spark.createDataFrame([(1, "a")], "k int, v string"))
    seen, u.version = t.version(), lambda: 1
    t.upsert(spark.createDataFrame([(1, "b")], "k int, v string"))
    with pytest.raises(Conflict):
        u.upsert(spark.createDataFrame([(1, "c")], "k int, v string"))
    assert seen == 1 and [tuple(r) for r in t.read().collect()] == [(1, "b")]
    empty = Versioned(spark, str(tmp_path / "e"), ["k"])
    empty.create(spark.createDataFrame([], "k int, v string"))
    assert empty.read().count() == 0
    empty.upsert(spark.createDataFrame([(None, "x")], "k int, v string"))
    assert [tuple(r) for r in empty.read().collect()] == [(None, "x")]


def test_rows_beyond_one_file_come_back_under_their_workbook(spark):
    """Rows of three files; a workbook whose own name ends in a number stays apart."""
    from tessera.sources import sheets

    rows = [(w, "s", r, 1, f"{w}{r}") for w in ("a", "a-1") for r in (1, sheets.ROWS + 1, 2 * sheets.ROWS + 5)]
    back = sheets.read_cells(spark, sheets.write_workbooks(spark.createDataFrame(rows, sheets.CELLS), "workbook"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_cursor_pages_count_rows_where_partitions_are_sampled_and_joined(spark):
    """More rows than a range partition's sample holds, in no order: every page but the last has 100 ids that follow each other."""
    from tessera.operators.scans import cursor_pages

    n = 120_050
    df = spark.range(0, n, 1, 6).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 2).alias("t"))
    pages = cursor_pages(df, "k", 100).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("a"), F.max("k").alias("b"), F.max("t").alias("t")).collect()  # with t, which counts do not need
    assert sorted(tuple(r)[:4] for r in pages) == [(p, min(100, n - 100 * p), 100 * p, min(n, 100 * p + 100) - 1) for p in range(n // 100 + 1)]
