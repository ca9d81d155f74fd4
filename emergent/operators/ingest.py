"""Ingest: payloads into tables that appear, grow and widen with what comes."""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emergent.functions import lattice
from emergent.functions.jsonparse import loads
from emergent.operators.infer import Inferred, infer
from emergent.operators.shred import typed
from emergent.operators.transforms import Registry
from emergent.session import ship
from emergent.sources.store import Manifest, StoreError, Table

RETRIES = 5


@dataclass(frozen=True)
class Result:
    """What one ingest did."""

    table: str
    created: bool = False
    columns_added: int = 0
    columns_widened: int = 0
    rows: int = 0
    errors: int = 0
    batches: int | None = None


_locks: dict[str, threading.Lock] = {}
_guard = threading.Lock()


def lock_of(table: Table) -> threading.Lock:
    with _guard:
        return _locks.setdefault(table.root, threading.Lock())


def evolved(manifest: Manifest, found: Inferred) -> tuple[Manifest, list[lattice.Column], int, int]:
    """The manifest with found columns added and widened, and found columns under the table's names.

    A column of which only nulls were seen widens nothing. A path below an existing JSON column is part of that column.
    """
    columns, added, widened = dict(manifest.columns), 0, 0
    own: list[lattice.Column] = []
    done: set[str] = set()
    for c in found.columns:
        parent = next((p for k in range(1, len(c.path)) if (p := manifest.name_of(".".join(c.path[:k]))) and columns[p] == "JSON"), None)
        if parent:
            if parent not in done:
                done.add(parent)
                own.append(lattice.Column(parent, c.path[: len(parent.split("."))], "JSON"))
            continue
        name = next((n for n in columns if n.lower() == c.name.lower()), None)
        if name is None:
            columns[c.name] = c.type
            added += 1
            own.append(c)
            continue
        kind = columns[name] if c.unset or c.type == "VARCHAR[]" and columns[name].endswith("[]") and _only_empty(c) else lattice.join_column(columns[name], c.type)
        if kind != columns[name]:
            columns[name] = kind
            widened += 1
        own.append(replace(c, name=name, type=kind if kind in ("JSON",) or not c.unset else kind))
    return replace(manifest, columns=columns), own, added, widened


def _only_empty(column: lattice.Column) -> bool:
    return column.unset


def ingest(table: Table, payloads: DataFrame, registry: Registry, transform: str | None = None, explode: str | None = None, ignore_errors: bool = False, batch: tuple[str, int] | None = None) -> Result:
    """Ingest the payload texts in the first column of a DataFrame; either all rows arrive or none.

    ``batch`` (stream, number) makes a repeated delivery of the same stream batch change nothing.
    """
    path, otlp = registry.resolve(transform, explode)
    found = infer(payloads, path, otlp, ignore_errors)
    with lock_of(table):
        for attempt in range(RETRIES):
            manifest = table.manifest()
            created = manifest is None
            manifest = manifest or Manifest()
            if batch and manifest.batches.get(batch[0], -1) >= batch[1]:
                return Result(table.name)
            if not found.columns:
                if created:
                    raise lattice.PayloadError(f"cannot create table {table.name} from an empty payload")
                return Result(table.name, errors=found.errors)
            after, own, added, widened = evolved(manifest, found)
            part = table.write_part(typed(payloads, found, own, path, otlp, ignore_errors), {c.name: c.type for c in own}, manifest.version + 1)
            after = replace(after, parts=(*manifest.parts, part), batches={**manifest.batches, batch[0]: batch[1]} if batch else manifest.batches)
            try:
                table.commit(after)
            except StoreError:
                table.store.files.delete(part.path)
                if attempt + 1 == RETRIES:
                    raise
                continue
            return Result(table.name, created, added, widened, part.rows, found.errors)
    raise StoreError(f"table {table.name}: no attempt succeeded")


def ingest_file(table: Table, path: str, registry: Registry, transform: str | None = None, explode: str | None = None, ignore_errors: bool = False, batch_size: int = 30_000) -> Result:
    """Ingest NDJSON files (gzip by name): each line is a document; a file that is one document is given to ``ingest`` as such.

    A file of several lines can be one document only if neither its first nor its last filled line is JSON; such files, and those of one
    filled line, are read whole. Each file is judged by itself, in whatever folder it lies.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    spark = table.store.spark
    ship(spark)
    filled = spark.read.text(path, lineSep="\n").where(F.length(F.trim("value")) > 0)
    counts = filled.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    place = filled.select("value", *(F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_block_length", "file_size")))
    at_start, at_end = F.col("file_block_start") == 0, F.col("file_block_start") + F.col("file_block_length") >= F.col("file_size")
    ends = place.select(F.col("file_path").alias("file"), "value", at_start.alias("starts"), at_end.alias("ends")).where("starts or ends")
    lone = ends.mapInArrow(_ends, "file string, json boolean").groupBy("file").agg(F.max("json").alias("json"))
    files = counts.join(lone, "file", "left").select("file", "n", ((F.col("n") == 1) | ~F.coalesce("json", F.lit(True))).alias("whole")).collect()
    count, whole = sum(f["n"] for f in files), [f["file"] for f in files if f["whole"]]
    lines = [f["file"] for f in files if not f["whole"]]
    # A line of an NDJSON file that is an array is one row, so it is wrapped to survive as one.
    wrapped = F.when(F.ltrim("value").startswith("["), F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value")).alias("value")
    payloads = (_read(spark, lines).where(F.length(F.trim("value")) > 0) if whole and lines else filled).select(wrapped if lines else "value")
    if whole:
        texts = _read(spark, whole, wholetext=True)
        payloads = payloads.unionByName(texts) if lines else texts
    result = ingest(table, payloads, registry, transform, explode, ignore_errors)
    return replace(result, batches=max(1, -(-count // batch_size)))


def _read(spark: SparkSession, files: list[str], **options: bool) -> DataFrame:
    """The texts of files that Spark has listed; their names are written as URIs there and are patterns when read."""
    names = [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(f)) for f in sorted(files)]
    return spark.read.text(names, lineSep=None if options else "\n", **options)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, json): whether the first line of each first split and the last line of each last split are JSON; rows come in file order."""
    last: tuple[str, str] | None = None  # a file's last line so far
    before: tuple[str, bool] | None = None  # file and whether its split starts it
    out: list[tuple[str, bool]] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for file, value, starts, ends in zip(*columns, strict=True):
            if last and last[0] != file:
                out.append((last[0], _is_json(last[1])))
                last = None
            if starts and before != (file, True):
                out.append((file, _is_json(value)))
            before, last = (file, starts), (file, value) if ends else last
        yield _judged(out)
        out = []
    yield _judged(out + ([(last[0], _is_json(last[1]))] if last else []))


def _judged(rows: list[tuple[str, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["file", "json"])


def _is_json(line: str) -> bool:
    try:
        loads(line)
    except (ValueError, RecursionError):
        return False
    return True
