"""HTTP as a Python data source: a row for each URL, fetched where the partitions run."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, body string, error string, attempts int"


def fetch(url: str, attempts: int = 5, pause: float = 2.0, timeout: float = 30.0, opener=urllib.request.urlopen) -> tuple:
    """One URL, tried again with a growing pause; a body shorter than it says counts as failed. Never raises.

    What has no status, as data in the URL itself, counts as 200.
    """
    error = ""
    for n in range(1, attempts + 1):
        try:
            with opener(url, timeout=timeout) as reply:
                body = reply.read()
                said = reply.headers.get("Content-Length")
                if said is not None and int(said) != len(body):
                    raise OSError(f"{len(body)} of {said} bytes")
                return (url, int(reply.status or 200), body.decode("utf-8", "ignore"), None, n)
        except Exception as e:  # noqa: BLE001  what fails becomes a row
            error = f"{type(e).__name__}: {e}"
            if n < attempts:
                time.sleep(pause * n)
    return (url, None, None, error, attempts)


def host_of(url: str) -> str:
    """The host that a URL asks, without its port; empty where it names none."""
    try:
        return urlsplit(url).hostname or ""
    except ValueError:
        return ""


#: Replies by which a server says that it does not answer questions for headers alone.
NO_HEAD = (403, 405, 501)
PROBED = "url string, reachable boolean, status int, type string, size long, error string"


def probe(url: str, timeout: float = 30.0, opener=urllib.request.urlopen) -> tuple:
    """Whether a URL could be fetched, by its headers alone, or by one byte where the server does not give those. Never raises.

    The size is that of the whole body, where the reply tells it.
    """

    def ask(method: str, headers: dict[str, str]) -> tuple:
        with opener(urllib.request.Request(url, headers=headers, method=method), timeout=timeout) as reply:
            whole = (reply.headers.get("Content-Range") or "").rpartition("/")[2] or reply.headers.get("Content-Length") or ""
            return (url, True, int(reply.status), reply.headers.get_content_type(), int(whole) if whole.isdigit() else None, None)

    failed = lambda e: (url, False, getattr(e, "code", None), None, None, f"{type(e).__name__}: {e}")
    try:
        return ask("HEAD", {})
    except urllib.error.HTTPError as e:
        if e.code not in NO_HEAD:
            return failed(e)
    except Exception as e:  # noqa: BLE001  what fails becomes a row
        return failed(e)
    try:
        return ask("GET", {"Range": "bytes=0-0"})
    except Exception as e:  # noqa: BLE001
        return failed(e)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.attempts, self.pause = int(options.get("attempts", 5)), float(options.get("pause", 2.0))
        self.per_host = int(options.get("per_host", 1))

    def partitions(self) -> list[InputPartition]:
        """URLs dealt by host, ``per_host`` partitions each at most, so that no host meets more tasks at once than that."""
        hosts = defaultdict(list)
        for u in self.urls:
            hosts[host_of(u)].append(u)
        return [InputPartition(of[i :: self.per_host]) for of in hosts.values() for i in range(min(self.per_host, len(of)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.value:
            yield fetch(url, self.attempts, self.pause)


class HttpSource(DataSource):
    """``spark.dataSource.register(HttpSource)``, then ``spark.read.format("http_pages").option("urls", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HttpReader:  # noqa: ANN001
        return HttpReader(dict(self.options))


def fetch_all(urls, column: str = "url", attempts: int = 5, pause: float = 2.0):
    """url, status, body, error, attempts of every URL of a DataFrame, a bounded number at a time: one in each task."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([fetch(u, attempts, pause) for u in batch[column]], columns=["url", "status", "body", "error", "attempts"])

    return urls.select(column).distinct().mapInPandas(run, SCHEMA)


def probe_all(urls, column: str = "url", timeout: float = 30.0):
    """url, reachable, status, type, size, error of every URL of a DataFrame, once each; none of the bodies is fetched."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            probed = pd.DataFrame([probe(u, timeout) for u in batch[column]], columns=["url", "reachable", "status", "type", "size", "error"])
            yield probed.astype({"status": "Int32", "size": "Int64"})

    return urls.filter(urls[column].isNotNull()).select(column).distinct().mapInPandas(run, PROBED)


def size_changed(known, remote):
    """Whether a remote size says that a file changed: unknown sizes say nothing."""
    from pyspark.sql import functions as F

    return F.when(known.isNotNull() & remote.isNotNull(), known != remote)
