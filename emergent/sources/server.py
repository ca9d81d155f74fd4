"""The HTTP API: queries, tables, JSON ingest and OTLP over HTTP, served from threads of the driver."""

from __future__ import annotations

import gzip
import hmac
import json
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from socketserver import TCPServer
from typing import TYPE_CHECKING, Any
from urllib.parse import parse_qs, unquote, urlsplit

if TYPE_CHECKING:
    from emergent.plans.sqlfront import Engine
    from emergent.sources.store import Files

# The type names of the API, the longest body, and the parts of an OTLP response.
TYPE_NAMES = {
    "VARCHAR": "String", "BIGINT": "Int64", "INTEGER": "Int32", "DOUBLE": "Float64", "BOOLEAN": "Bool", "TIMESTAMP": "DateTime", "DATE": "Date", "JSON": "Json", "FLOAT": "Float32", "binary": "Bytes",
}
MAX_BODY = 256 << 20
UPLOAD = re.compile(r"[0-9a-f]{32}")
UPLOADED = re.compile(r"[0-9]+(-[0-9]+)*")
REJECTED = {"traces": "rejectedSpans", "logs": "rejectedLogRecords", "metrics": "rejectedDataPoints"}
ENVELOPES = {"resourceSpans": "otlp-traces", "resourceLogs": "otlp-logs", "resourceMetrics": "otlp-metrics"}


class ApiError(Exception):
    def __init__(self, status: int, message: str, hint: str = "") -> None:
        super().__init__(message)
        self.status, self.hint = status, hint


def _shown(value: Any) -> Any:
    """Numbers and truth values as they are, all else as text."""
    if value is None or isinstance(value, (bool, int, float)):
        return value
    return value if isinstance(value, str) else json.dumps(value, default=str) if isinstance(value, (list, dict)) else str(value)


class Api:
    """Routes, without the transport: (status, document or bytes)."""

    def __init__(self, engine: Engine, buffered: bool = False) -> None:
        self.engine, self.buffered = engine, buffered

    def query(self, sql: str) -> dict[str, Any]:
        from emergent.functions.lattice import type_name

        began = time.perf_counter()
        frame = self.engine.sql(sql)
        kinds = ["JSON" if f.metadata.get("lattice") == "JSON" else type_name(f.dataType) for f in frame.schema]
        data = [{c: _shown(v) for c, v in zip(frame.columns, row, strict=True)} for row in frame.collect()]
        meta = [{"name": c, "type": TYPE_NAMES.get(k, k)} for c, k in zip(frame.columns, kinds, strict=True)]
        statistics = {"elapsed": time.perf_counter() - began, "rows_read": len(data), "bytes_read": len(data) * len(meta) * 8}
        return {"meta": meta, "data": data, "rows": len(data), "statistics": statistics, "hints": []}

    def tables(self) -> list[dict[str, Any]]:
        return [self._listed(t, n) for _, t, n in self.engine.tables()]

    def _listed(self, name: str, rows: int) -> dict[str, Any]:
        return {"name": name, "created_at": "1970-01-01T00:00:00Z", "total_rows": rows, "total_bytes": rows * 64, "project": "default", "organization": "default"}

    def table(self, name: str) -> dict[str, Any]:
        table = self.engine.resolve(name)
        manifest = table.manifest()
        if manifest is None:
            raise ApiError(404, f"table {name} not found")
        return self._listed(name, manifest.rows) | {"columns": [{"name": c, "type": TYPE_NAMES.get(k, k)} for c, k in manifest.columns.items()]}

    def ingest(self, name: str, body: str, options: dict[str, str]) -> tuple[int, dict[str, Any]]:
        transform, explode = options.get("transform"), options.get("explode")
        if not transform and not explode:
            transform = next((t for key, t in ENVELOPES.items() if f'"{key}"' in body), None)
        skip = options.get("ignore_errors") == "true"
        if self.buffered:
            self.engine.enqueue(name, body, transform, explode, skip)
            return 202, {"table": name, "queued": True}
        return 200, {"inserted": self.engine.ingest(name, body, transform, explode, skip).rows}

    def upload(self, upload: str, part: str, packed: bytes) -> dict[str, Any]:
        """Keep one gzipped part of an upload beside the tables, unread; what commits the upload ingests it."""
        self._files().put(f"{self._folder(upload)}/{self._checked(UPLOADED, part)}.json.gz", packed)
        return {"part": part}

    def drop_upload(self, upload: str) -> dict[str, Any]:
        self._files().delete(self._folder(upload))
        return {"dropped": upload}

    def ingest_upload(self, name: str, upload: str, parts: list[str], payloads: int, options: dict[str, str]) -> dict[str, Any]:
        """Ingest the named parts of an upload as one, each line a document; other parts are of attempts that failed. The upload ends here."""
        from pyspark.sql import functions as F

        try:
            files = [f"{self._folder(upload)}/{self._checked(UPLOADED, p)}.json.gz" for p in parts]
            lines = self.engine.spark.read.text(files, lineSep="\n").where(F.length(F.trim("value")) > 0)
            transform, explode = options.get("transform"), options.get("explode")
            if not transform and not explode:
                seen = lines.agg(*(F.max(F.col("value").contains(f'"{key}"')).alias(key) for key in ENVELOPES)).first()
                transform = next((t for key, t in ENVELOPES.items() if seen[key]), None)
            if payloads > 1:  # as in any request of several lines, an array is one row
                lines = lines.select(F.when(F.ltrim("value").startswith("["), F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value")).alias("value"))
            return {"inserted": self.engine.ingest(name, lines, transform, explode, options.get("ignore_errors") == "true").rows}
        finally:
            self.drop_upload(upload)

    def _checked(self, form: re.Pattern, text: str) -> str:
        if not form.fullmatch(text):
            raise ApiError(400, f"not the name of an upload or a part: {text}")
        return text

    def _folder(self, upload: str) -> str:
        return f"{self.engine.stores[self.engine.current].path}/_uploads/{self._checked(UPLOAD, upload)}"

    def _files(self) -> Files:
        return self.engine.stores[self.engine.current].files

    def drop(self, name: str) -> dict[str, Any]:
        self.engine.resolve(name).drop()
        return {"dropped": name}

    def otlp(self, signal: str, body: bytes, binary: bool, table: str) -> None:
        from emergent.sources import otlp_pb

        text = json.dumps(otlp_pb.decode(signal, body)) if binary else body.decode()
        if self.buffered:
            self.engine.enqueue(table, text, f"otlp-{signal}")
        else:
            self.engine.ingest(table, text, f"otlp-{signal}")


class Server:
    def __init__(self, engine: Engine, host: str, port: int, token: str = "", buffered: bool = False) -> None:
        api = Api(engine, buffered)

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def log_message(self, *_: Any) -> None:
                pass

            def answer(self, status: int, body: bytes, kind: str = "application/json") -> None:
                if "gzip" in self.headers.get("Accept-Encoding", "") and len(body) > 1024:
                    body = gzip.compress(body)
                    packed = True
                else:
                    packed = False
                self.send_response(status)
                for name, value in (("Content-Type", kind), ("Content-Length", str(len(body))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "*"), ("Access-Control-Allow-Methods", "GET, POST, DELETE, OPTIONS")):
                    self.send_header(name, value)
                if packed:
                    self.send_header("Content-Encoding", "gzip")
                self.end_headers()
                self.wfile.write(body)

            def body(self, packed: bool = False) -> bytes:
                """The request's body, or with ``packed`` its gzipped form."""
                size = int(self.headers.get("Content-Length") or 0)
                if size > MAX_BODY:
                    raise ApiError(413, "body is too large")
                raw = self.rfile.read(size)
                if packed:
                    return raw if self.headers.get("Content-Encoding") == "gzip" else gzip.compress(raw)
                return gzip.decompress(raw) if self.headers.get("Content-Encoding") == "gzip" else raw

            def route(self) -> None:
                url = urlsplit(self.path)
                path = unquote(url.path).rstrip("/")
                options = {k: v[0] for k, v in parse_qs(url.query).items()}
                binary = "protobuf" in self.headers.get("Content-Type", "") and path.startswith("/otlp/")
                try:
                    body = self.body(path.startswith("/v1/uploads/"))
                    if path == "/health":
                        return self.answer(200, b'{"status":"ok"}')
                    if token and not hmac.compare_digest(self.headers.get("Authorization", "").encode(), f"Bearer {token}".encode()):
                        raise ApiError(401, "missing or wrong token", "send Authorization: Bearer <token>")
                    status, out = self.dispatch(self.command, path, options, body, binary)
                    if isinstance(out, bytes):
                        return self.answer(status, out, "application/x-protobuf")
                    return self.answer(status, json.dumps(out).encode())
                except ApiError as e:
                    return self.fail(e.status, str(e), e.hint, binary)
                except Exception as e:  # noqa: BLE001
                    return self.fail(400, str(e), "", binary)

            def fail(self, status: int, text: str, hint: str, binary: bool) -> None:
                if binary:
                    from emergent.sources import otlp_pb

                    return self.answer(status, otlp_pb.failed(3, text), "application/x-protobuf")
                return self.answer(status, json.dumps({"error": True, "message": text, "hint": hint}).encode())

            def dispatch(self, method: str, path: str, options: dict[str, str], body: bytes, binary: bool) -> tuple[int, Any]:
                if (method, path) == ("POST", "/v1/query"):
                    return 200, api.query(json.loads(body)["sql"])
                if (method, path) == ("GET", "/v1/tables"):
                    return 200, api.tables()
                if found := re.fullmatch(r"/v1/tables/([^/]+)", path):
                    if method == "GET":
                        return 200, api.table(found[1])
                    if method == "POST" and "upload" in options:
                        told = json.loads(body)
                        return 200, api.ingest_upload(found[1], options["upload"], told["parts"], told["payloads"], options)
                    if method == "POST":
                        return api.ingest(found[1], body.decode(), options)
                    if method == "DELETE":
                        return 200, api.drop(found[1])
                if method == "POST" and (found := re.fullmatch(r"/v1/uploads/([^/]+)/([^/]+)", path)):
                    return 200, api.upload(found[1], found[2], body)
                if method == "DELETE" and (found := re.fullmatch(r"/v1/uploads/([^/]+)", path)):
                    return 200, api.drop_upload(found[1])
                if method == "POST" and (found := re.fullmatch(r"/otlp/v1/(traces|logs|metrics)", path)):
                    signal = found[1]
                    api.otlp(signal, body, binary, self.table_for(signal))
                    if binary:
                        from emergent.sources import otlp_pb

                        return 200, otlp_pb.accepted()
                    return 200, {"partialSuccess": {REJECTED[signal]: 0}}
                raise ApiError(404, f"no route for {method} {path}")

            def table_for(self, signal: str) -> str:
                """The table that a header x-<word>-<signal>-table, else x-<word>-table, names."""
                for pattern in (rf"x-\w+-{signal}-table", r"x-\w+-table"):
                    for name, value in self.headers.items():
                        if re.fullmatch(pattern, name.lower()):
                            return value
                return f"otel_{signal}"

            def do_OPTIONS(self) -> None:  # noqa: N802
                self.answer(204, b"")

            do_GET = do_POST = do_DELETE = route

        class Listener(ThreadingHTTPServer):
            daemon_threads = True
            request_queue_size = 512
            disable_nagle_algorithm = True

            def server_bind(self) -> None:
                TCPServer.server_bind(self)  # without the look-up of a name for the address
                self.server_name, self.server_port = self.server_address[:2]

        self.http = Listener((host, port), Handler)
        self.port = self.http.server_address[1]
        self.thread = threading.Thread(target=self.http.serve_forever, daemon=True)
        self.thread.start()

    def close(self) -> None:
        self.http.shutdown()
        self.http.server_close()
