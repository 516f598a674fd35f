"""Run a query over a catalog, or serve queries over HTTP.

    python -m tidemark --catalog catalog.json --archive DIR --org ORG --sql "SELECT ..." [--output FILE]
    python -m tidemark --catalog catalog.json --archive DIR --serve PORT [--max-rows N]
    python -m tidemark --url http://HOST:PORT --org ORG --sql "SELECT ..." [--proxy HOST:PORT] [--output FILE]

Rows are sent and written as they come, one partition of the result after the other.
"""

from __future__ import annotations

import argparse
import itertools
import json
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .catalog import Catalog
from .session import Engine
from .sources.archive import Archive
from .sources.nearline import Nearline


#: A client's attempts to connect, and the seconds between them (fixed values).
ATTEMPTS, PAUSE = 10, 5


def as_json(rows: Iterable[dict]) -> Iterator[str]:
    """A JSON array, row by row."""
    yield "["
    for i, row in enumerate(rows):
        yield (", " if i else "") + json.dumps(row, default=str)
    yield "]"


def post(url: str, org: str, sql: str, *, proxy: str | None = None, attempts: int = ATTEMPTS, pause: float = PAUSE) -> str:
    """A server's answer; a server that is not there yet is asked again."""
    opener = urllib.request.build_opener(*([urllib.request.ProxyHandler({"http": proxy, "https": proxy})] if proxy else []))
    request = urllib.request.Request(f"{url.rstrip('/')}/query", json.dumps({"sql": sql}).encode(), {"x-api-key": org})
    for k in itertools.count(1):
        try:
            with opener.open(request) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError:
            raise
        except urllib.error.URLError:
            if k >= attempts:
                raise
            time.sleep(pause)
    raise AssertionError


def handler(engine: Engine, max_rows: int | None = None) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self, status: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def stream(self, rows: Iterator[dict]) -> None:
            first = list(itertools.islice(rows, 1))  # what fails does so before the answer begins
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            for part in as_json(itertools.chain(first, rows)):
                data = part.encode()
                self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")
            self.wfile.write(b"0\r\n\r\n")

        def do_GET(self) -> None:
            alive = self.path in ("/", "/alive", "/alive/engine") and engine.spark.sql("SELECT 1").count() == 1
            self.answer(200 if alive else 404, "OK" if alive else "not found")

        def do_POST(self) -> None:
            org = self.headers.get("x-api-key")
            raw = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            try:
                sql = json.loads(raw).get("sql") if raw.startswith("{") else raw
                if self.path != "/query" or not org or not sql:
                    self.answer(400, {"error": "POST /query needs x-api-key and sql"})
                else:
                    self.stream(engine.session(org).rows(sql, max_rows=max_rows))
            except Exception as e:  # a client's query must not end the server
                self.answer(400, {"error": str(e)[:2000]})

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def main(argv: list[str]) -> int:
    options = argparse.ArgumentParser(prog="tidemark")
    for name in ("catalog", "archive", "format", "nearline", "errors", "org", "sql", "output", "url", "proxy"):
        options.add_argument(f"--{name}")
    options.add_argument("--serve", type=int)
    options.add_argument("--max-rows", type=int)
    given = options.parse_args(argv)
    if given.url:
        answer = post(given.url, given.org, given.sql, proxy=given.proxy)
        with open(given.output, "w") if given.output else sys.stdout as out:
            out.write(answer)
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with open(given.catalog) as file:
        catalog = Catalog.from_json(file.read())
    engine = Engine(spark, catalog, Nearline(given.nearline) if given.nearline else None, (Archive(given.archive, given.format or "parquet"),) if given.archive else (), given.errors)
    if given.serve:
        ThreadingHTTPServer(("", given.serve), handler(engine, given.max_rows)).serve_forever()
    rows = engine.session(given.org).rows(given.sql, max_rows=given.max_rows)
    with open(given.output, "w") if given.output else sys.stdout as out:
        out.writelines(as_json(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
