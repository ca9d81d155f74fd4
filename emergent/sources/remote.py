"""A store served by another engine's HTTP API: queries come back as DataFrames, payloads go as NDJSON.

A DataFrame's payloads go from the tasks that have them to the server, as the parts of an upload, and never through this driver. The server
keeps parts as files; its only jobs run when the upload is committed, so tasks that wait for it hold no cores that it needs.
"""

from __future__ import annotations

import gzip
import json
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emergent.session import ship
from emergent.sources.store import StoreError

#: Bytes of payloads that one request carries, about.
REQUEST_BYTES = 8 << 20
# How the API's type names read back.
READ_AS = {"Int64": "long", "Int32": "int", "Float64": "double", "Float32": "float", "Bool": "boolean"}


def _call(url: str, token: str, method: str, path: str, body: bytes | None = None) -> Any:
    headers = {"Content-Encoding": "gzip"} if body else {}
    if token:
        headers["Authorization"] = f"Bearer {token}"
    request = urllib.request.Request(url + path, gzip.compress(body, 6) if body else None, headers, method=method)
    try:
        with urllib.request.urlopen(request) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        raise StoreError(json.loads(e.read()).get("message", str(e))) from None


class RemoteStore:
    def __init__(self, spark: SparkSession, url: str, token: str = "") -> None:
        self.spark, self.url, self.token = spark, url.rstrip("/"), token

    def call(self, method: str, path: str, body: bytes | None = None) -> Any:
        return _call(self.url, self.token, method, path, body)

    def sql(self, statement: str) -> DataFrame:
        out = self.call("POST", "/v1/query", json.dumps({"sql": statement}).encode())
        schema = ", ".join(f"`{m['name']}` {READ_AS.get(m['type'], 'string')}" for m in out["meta"])
        return self.spark.createDataFrame([tuple(row[m["name"]] for m in out["meta"]) for row in out["data"]], schema)

    def tables(self) -> list[str]:
        return [t["name"] for t in self.call("GET", "/v1/tables")]

    def ingest(self, table: str, payloads: Iterable[str] | DataFrame, **options: str) -> int:
        """Send payloads, one document each, in requests of bounded size.

        A DataFrame's first column is sent by its tasks, which must reach the server's address, and ingested as one.
        """
        query = f"?{urllib.parse.urlencode(options)}" if options else ""
        path = f"/v1/tables/{urllib.parse.quote(table)}{query}"
        if isinstance(payloads, DataFrame):
            return self._upload(path, payloads)
        sent, held, size = 0, [], 0
        for payload in payloads:
            line = payload.replace("\n", " ")
            held.append(line)
            size += len(line)
            if size >= REQUEST_BYTES:
                sent += self.call("POST", path, "\n".join(held).encode()).get("inserted", 0)
                held, size = [], 0
        return sent + self.call("POST", path, "\n".join(held).encode()).get("inserted", 0) if held else sent

    def _upload(self, path: str, payloads: DataFrame) -> int:
        ship(payloads.sparkSession)
        url, token, upload = self.url, self.token, uuid.uuid4().hex

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task = TaskContext.get()
            own = f"{task.partitionId()}-{task.taskAttemptId()}"  # a task that is tried again sends parts of other names
            parts: list[str] = []
            held, size, count = [], 0, 0

            def flush() -> None:
                parts.append(f"{own}-{len(parts)}")
                _call(url, token, "POST", f"/v1/uploads/{upload}/{parts[-1]}", "\n".join(held).encode())

            for batch in batches:
                for text in batch.column(0).drop_null().to_pylist():
                    line = text.replace("\n", " ")
                    held.append(line)
                    size, count = size + len(line), count + 1
                    if size >= REQUEST_BYTES:
                        flush()
                        held, size = [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_pydict({"parts": pa.array([parts], pa.list_(pa.string())), "payloads": pa.array([count], pa.int64())})

        try:
            sent = payloads.select(F.col(f"`{payloads.columns[0]}`").cast("string")).mapInArrow(send, "parts array<string>, payloads long").collect()
            told = {"parts": [p for row in sent for p in row["parts"]], "payloads": sum(row["payloads"] for row in sent)}
            if not told["parts"]:
                return 0
            return self.call("POST", f"{path}{'&' if '?' in path else '?'}upload={upload}", json.dumps(told).encode())["inserted"]
        except BaseException:
            self.call("DELETE", f"/v1/uploads/{upload}")
            raise
