"""Messages over HTTP: a receiver that lands bodies in a spool folder, and a sink that posts them.

Streams and batch jobs read the spool with the source in files.py. The sink is off unless it is called.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.definition import TRACE
from tracefold.sources.files import file_name, store_file
from tracefold.wire import Codec, Options


def receiver(port: int, spool: str, options: Options = Options(), dead: str | None = None) -> ThreadingHTTPServer:
    """A server for POST on any path: 200 once a body is in the spool, 405 for other methods, 500 for no message.

    Bodies that can't be read land in `dead`, if that is given. Run serve_forever() on a thread.
    """
    codec = Codec(TRACE, options)

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, text: str = "") -> None:
            self.send_response(status)
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text.encode())

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                codec.decode(body)
            except ValueError as error:
                if dead:
                    store_file(dead, file_name("dict"), body)
                return self._reply(500, type(error).__name__)
            store_file(spool, file_name("dict"), body)
            return self._reply(200)

        def _refuse(self) -> None:
            self._reply(405)

        do_GET = do_PUT = do_DELETE = do_PATCH = do_HEAD = do_OPTIONS = _refuse

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("", port), Handler)


def post(bodies: DataFrame, url: str, column: str = "body", timeout: float = 30.0) -> DataFrame:
    """Posts each body and returns (batch_id, status, error). A status beyond 2xx is no error; nothing listening is.

    Lazy: the requests are made when the result is written, and again if a task is run again.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: dict[str, list] = {"batch_id": [], "status": [], "error": []}
            for held in batch.to_pylist():
                status, error = None, None
                try:
                    request = urllib.request.Request(url, held["body"], {"Content-Type": "*/*"}, method="POST")
                    with urllib.request.urlopen(request, timeout=timeout) as answer:
                        status = answer.status
                except urllib.error.HTTPError as answer:
                    status = answer.code
                except OSError as problem:
                    error = str(problem)
                out["batch_id"].append(held["batch_id"])
                out["status"].append(status)
                out["error"].append(error)
            yield pa.RecordBatch.from_pydict({"batch_id": pa.array(out["batch_id"], pa.int64()), "status": pa.array(out["status"], pa.int32()), "error": pa.array(out["error"], pa.string())})

    return bodies.select("batch_id", F.col(column).alias("body")).mapInArrow(run, "batch_id long, status int, error string")
