"""The paged source: saved pages, a server that fails, pages that grow, streams that stop and go on."""

import http.server
import json
import threading
import urllib.error
from pathlib import Path

import pytest

from siltstone.sources import pages


def save(root, page, items, more):
    (root / f"{page}.json").write_text(json.dumps({"items": [{"id": i} for i in items], "has_more": more}))


def ids(rows):
    return sorted((r["page"], r["item"], json.loads(r["body"])["id"]) for r in rows)


@pytest.fixture
def source(spark):
    return pages.register(spark)


def test_batch_stops_at_the_last_page_and_at_empty_ones(spark, source, tmp_path):
    for name, more in (("a", [True, False, True]), ("b", [True, True])):
        (tmp_path / name).mkdir()
        for i, m in enumerate(more):
            save(tmp_path / name, i + 1, [10 * i, 10 * i + 1], m)
    save(tmp_path / "b", 3, [], True)
    save(tmp_path / "b", 4, [99], False)
    rows = spark.read.format(source).option("url", f"{tmp_path}/a/{{page}}.json {tmp_path}/b/{{page}}.json").load()
    assert rows.rdd.getNumPartitions() == 2
    got = rows.collect()
    assert ids(r for r in got if r["chain"] == 0) == [(1, 0, 0), (1, 1, 1), (2, 0, 10), (2, 1, 11)]
    assert ids(r for r in got if r["chain"] == 1) == [(1, 0, 0), (1, 1, 1), (2, 0, 10), (2, 1, 11)]
    limited = spark.read.format(source).option("url", f"{tmp_path}/b/{{page}}.json").option("max_pages", 1).load()
    assert limited.count() == 2
    assert spark.read.format(source).option("url", f"{tmp_path}/none/{{page}}.json").load().count() == 0


def test_options_are_checked():
    for wrong in ({"url": "x"}, {}, {"url": "{page}", "start_page": "0"}, {"url": "{page}", "max_pages": "0"}):
        with pytest.raises(ValueError):
            pages.Options.of(wrong)
    with pytest.raises(ValueError):
        pages.PageStream(pages.Options.of({"url": "{page}"}))


class Server(http.server.BaseHTTPRequestHandler):
    asked: dict[int, int] = {}

    def do_GET(self):
        page = int(self.path.rsplit("=", 1)[1])
        n = self.asked[page] = self.asked.get(page, 0) + 1
        if page == 9:
            self.send_error(404)
        elif page == 2 and n < 3:
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
        else:
            body = {"items": [{"id": page}], "has_more": page < 4, "quota_remaining": 10 - page}
            if page == 3 and n == 1:
                body = {"error_id": 502, "error_message": "throttled"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    Server.asked.clear()
    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/questions?page={{page}}"
    httpd.shutdown()


def test_server_errors_are_retried(spark, source, server):
    rows = spark.read.format(source).option("url", server).option("wait", "0.01").load().collect()
    assert ids(rows) == [(p, 0, p) for p in (1, 2, 3, 4)]
    assert Server.asked == {1: 1, 2: 3, 3: 2, 4: 1}


def test_lost_pages_and_quota(server):
    options = pages.Options.of({"url": server, "wait": "0.01", "retries": "1", "quota_reserve": "8"})
    with pytest.raises(pages.PageError, match="404"):
        pages.fetch(server.replace("{page}", "9"), options)
    with pytest.raises(pages.PageError, match="gave up after 2"):
        pages.fetch(server.replace("{page}", "2"), options)
    with pytest.raises(pages.PageError):
        pages.fetch("http://127.0.0.1:1/{page}", options)
    reader = pages.PageReader(options)
    rows = reader.read(pages.Chain(0))
    assert next(rows)[1] == 1
    assert next(rows)[1] == 2
    with pytest.raises(pages.QuotaLow):
        next(rows)


def run(spark, source, root, url, sink, batches=None, **options):
    stream = spark.readStream.format(source).option("url", url).option("spool", f"file://{root}/spool").options(**options).load()
    q = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(sink).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_stream_goes_on_inside_a_page_that_grows(spark, source, tmp_path):
    seen = []
    url = f"{tmp_path}/{{page}}.json"
    sink = lambda df, batch: seen.extend((r["page"], r["item"], json.loads(r["body"])["id"]) for r in df.collect())
    for p in range(1, 4):
        save(tmp_path, p, [10 * p, 10 * p + 1, 10 * p + 2], True)
    save(tmp_path, 4, [40], False)
    run(spark, source, tmp_path, url, sink, pages_per_batch=2)
    assert sorted(seen) == [(p, i, 10 * p + i) for p in (1, 2, 3) for i in range(3)] + [(4, 0, 40)]
    run(spark, source, tmp_path, url, sink)
    assert len(seen) == 10
    save(tmp_path, 4, [40, 41, 42], True)
    save(tmp_path, 5, [50], False)
    run(spark, source, tmp_path, url, sink)
    assert sorted(seen)[9:] == [(4, 0, 40), (4, 1, 41), (4, 2, 42), (5, 0, 50)]


def test_killed_batch_is_run_again_over_the_same_pages(spark, source, tmp_path):
    """The sink fails in the middle; meanwhile the server's pages change; the rerun sees the old ones."""
    url, seen, tries = f"{tmp_path}/{{page}}.json", {}, []
    save(tmp_path, 1, [1, 2], True)
    save(tmp_path, 2, [3], False)

    def sink(df, batch):
        rows = ids(df.collect())
        tries.append((batch, rows))
        if len(tries) == 1:
            raise RuntimeError("killed")
        seen[batch] = rows

    with pytest.raises(Exception, match="killed"):
        run(spark, source, tmp_path, url, sink)
    save(tmp_path, 1, [100, 200, 300], True)
    run(spark, source, tmp_path, url, sink)
    assert tries[0] == tries[1] and seen == {0: [(1, 0, 1), (1, 1, 2), (2, 0, 3)]}


def test_spool_is_not_fetched_twice(spark, source, server, tmp_path):
    seen = []
    run(spark, source, tmp_path, server, lambda df, b: seen.extend(ids(df.collect())), wait="0.01")
    first = dict(Server.asked)
    assert first[1] == 1 and sorted(seen) == [(p, 0, p) for p in (1, 2, 3, 4)]
    run(spark, source, tmp_path, server, lambda df, b: seen.extend(ids(df.collect())), wait="0.01")
    assert Server.asked[1] == 1 and len(seen) == 4
    assert len(list(Path(tmp_path / "spool" / "0").glob("*.json"))) == 4
