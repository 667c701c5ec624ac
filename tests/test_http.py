"""Reachability by headers alone, and URLs dealt by host, against a server of this test."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from ledgerloom.sources import http

BODY = b"%PDF-" + b"x" * 995


class Handler(BaseHTTPRequestHandler):
    sent = 0

    def log_message(self, *_):
        pass

    def _head(self, status, length, **more):
        self.send_response(status)
        self.send_header("Content-Type", "application/pdf; charset=x")
        self.send_header("Content-Length", str(length))
        for k, v in more.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()

    def do_HEAD(self):
        if self.path == "/gone":
            self._head(404, 0)
        elif self.path == "/no-head":
            self._head(405, 0)
        else:
            self._head(200, len(BODY))

    def do_GET(self):
        part = BODY[:1] if self.headers.get("Range") == "bytes=0-0" else BODY
        Handler.sent += len(part)
        self._head(206, len(part), Content_Range=f"bytes 0-0/{len(BODY)}")
        self.wfile.write(part)


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_probe(spark, server):
    urls = [f"{server}/doc", f"{server}/doc", f"{server}/no-head", f"{server}/gone", "no url", "http://127.0.0.1:1/x", None]
    before = Handler.sent
    got = {r.url.removeprefix(server): r for r in http.probe_all(spark.createDataFrame([(u,) for u in urls], "url string"), timeout=5).collect()}
    assert set(got) == {"/doc", "/no-head", "/gone", "no url", "http://127.0.0.1:1/x"}
    assert tuple(got["/doc"])[1:] == (True, 200, "application/pdf", 1000, None)
    assert tuple(got["/no-head"])[1:] == (True, 206, "application/pdf", 1000, None)
    assert (got["/gone"].reachable, got["/gone"].status) == (False, 404)
    assert not got["no url"].reachable and got["no url"].error and not got["http://127.0.0.1:1/x"].reachable
    assert Handler.sent - before == 1


def test_urls_are_dealt_by_host():
    urls = [f"http://{h}/{i}" for i in range(5) for h in ("a.de", "b.de:8080")] + ["data:,x"]
    dealt = lambda n: [p.value for p in http.HttpReader({"urls": " ".join(urls), "per_host": n}).partitions()]
    assert [{http.host_of(u) for u in p} for p in dealt(1)] == [{"a.de"}, {"b.de"}, {""}]
    assert len(dealt(3)) == 7 and sorted(u for p in dealt(3) for u in p) == sorted(urls)
