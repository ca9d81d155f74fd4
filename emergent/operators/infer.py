"""Schema inference over a DataFrame of payload texts.

Each task merges its documents into one tree; batches of plain documents and of envelopes are read by Arrow (``functions.native``). Those of
``ROUND`` tasks merge on an executor, and what reaches the driver is one tree for each such group. Trees merge in task order, which keeps
first-seen column order the same in every run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emergent.functions.jsonparse import check_uniform, split
from emergent.functions.lattice import Column, Node, PayloadError, compact, flatten
from emergent.functions.native import Reader, join_levels
from emergent.operators.transforms import apply
from emergent.session import ship


#: Tasks whose trees merge on an executor; row documents that a task holds at most, about, and those that are worth Arrow's reader.
ROUND, HELD, FEW = 1024, 4096, 16
_SCHEMA = "part int, root string, bare string, rows long, objects long, errors long, wrong string, plain boolean, levels string"
_PARTIAL = pa.schema([("part", pa.int32()), ("root", pa.string()), ("bare", pa.string()), ("rows", pa.int64()), ("objects", pa.int64()), ("errors", pa.int64()), ("wrong", pa.string()), ("plain", pa.bool_()), ("levels", pa.string())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group of tasks, whose rows come in their order."""
    held: dict | None = None
    for batch in batches:
        for row in batch.to_pylist():
            row |= {k: Node.load(json.loads(row[k])) for k in ("root", "bare")} | {"levels": json.loads(row["levels"])}
            if held is None or held["group"] != row["group"]:
                if held is not None:
                    yield _partial(held)
                held = row
                continue
            for k in ("root", "bare"):
                held[k].merge(row[k])
            for k in ("rows", "objects", "errors"):
                held[k] += row[k]
            held["wrong"], held["plain"] = held["wrong"] or row["wrong"], held["plain"] and row["plain"]
            held["levels"] = join_levels(held["levels"], row["levels"])
    if held is not None:
        yield _partial(held)


def _partial(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row | {k: json.dumps(row[k].dump()) for k in ("root", "bare")} | {"levels": json.dumps(row["levels"])}], schema=_PARTIAL)


@dataclass(frozen=True)
class Inferred:
    columns: list[Column]
    rows: int
    errors: int
    scalar: bool  # rows are bare values in one column named value
    plain: bool = False  # every payload is one object and so its own row document
    levels: dict | None = None  # what envelopes hold at each step of the path, if Arrow could read them all


def rows_of(payloads: DataFrame, path: list[str], otlp: bool, ignore_errors: bool = False) -> DataFrame:
    """Column ``value``: one row document as compact JSON text for each row of each payload; null payloads give none."""
    ship(payloads.sparkSession)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if text is not None:
                    documents, errors = split(text, ignore_errors)
                    out += [compact(row) for row in apply(documents, path, otlp)] + [None] * errors
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    name = payloads.columns[0]
    return payloads.select(F.col(f"`{name}`").cast("string")).mapInArrow(parsed, "value string")


def infer(payloads: DataFrame, path: list[str] | None = None, otlp: bool = False, ignore_errors: bool = False) -> Inferred:
    """The flattened columns of all rows of all payloads, with how many rows and broken lines there are."""
    ship(payloads.sparkSession)
    path = path or []

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        root, bare, rows, objects, errors, wrong, plain = Node(), Node(), 0, 0, 0, None, not path
        reader, made = Reader(), Reader()
        levels: dict | None = None if otlp or not path else {}
        held: list[Any] = []

        def seen(documents: list[Any]) -> int:
            """Add row documents to the trees; the number of objects among them."""
            own = [d for d in documents if isinstance(d, dict)]
            for value in documents if len(own) < len(documents) else ():
                if not isinstance(value, dict):
                    bare.add(value)
            try:
                tree = made.tree(pa.array([compact(d) for d in own], pa.string())) if len(own) >= FEW else None
            except UnicodeEncodeError:  # half of a surrogate pair
                tree = None
            if tree is not None:
                root.merge(tree)
            else:
                for document in own:
                    root.add(document)
            return len(own)

        for batch in batches:
            texts = batch.column(0).drop_null()
            tree, count = None if path else reader.tree(texts), len(texts)
            if levels is not None and len(texts):
                found = None if held else reader.exploded(texts, path, root.children)
                tree, count, own = found or (None, 0, None)
                levels = join_levels(levels, own)
            if tree is not None:
                if held:  # what came before is merged before
                    rows, objects, held = rows + len(held), objects + seen(held), []
                root.merge(tree)
                rows, objects = rows + count, objects + count
                continue
            for text in texts.to_pylist():
                try:
                    documents, broken = split(text, ignore_errors)
                except PayloadError as e:
                    wrong = wrong or str(e)
                    continue
                errors += broken
                plain = plain and len(documents) == 1 and isinstance(documents[0], dict) and text.lstrip().startswith("{") and not broken
                held += apply(documents, path, otlp)
                if len(held) >= HELD:
                    rows, objects = rows + len(held), objects + seen(held)
                    held = []
        rows, objects = rows + len(held), objects + seen(held)
        yield _partial({"part": TaskContext.get().partitionId(), "root": root, "bare": bare, "rows": rows, "objects": objects, "errors": errors, "wrong": wrong, "plain": plain, "levels": levels})

    name = payloads.columns[0]
    trees = payloads.select(F.col(f"`{name}`").cast("string")).mapInArrow(merged, _SCHEMA)
    group = F.expr(f"part div {ROUND}").cast("int").alias("group")
    partials = trees.select(group, "*").repartition("group").sortWithinPartitions("group", "part").mapInArrow(_joined, _SCHEMA).collect()
    root, bare, levels = Node(), Node(), {}
    for p in sorted(partials, key=lambda p: p["part"]):
        if p["wrong"]:
            raise PayloadError(p["wrong"])
        root.merge(Node.load(json.loads(p["root"])))
        bare.merge(Node.load(json.loads(p["bare"])))
        levels = join_levels(levels, json.loads(p["levels"]))
    rows, objects = sum(p["rows"] for p in partials), sum(p["objects"] for p in partials)
    scalar = check_uniform(objects, rows)
    if scalar:
        columns = [Column("value", (), bare.type(), not bare.seen())] if bare.seen() else []
    else:
        columns = flatten(root)
    return Inferred(columns, rows, sum(p["errors"] for p in partials), scalar, all(p["plain"] for p in partials), levels or None)


def documents_of(payloads: DataFrame, found: Inferred, path: list[str], otlp: bool, ignore_errors: bool = False) -> DataFrame:
    """Row documents of payloads that were inferred; texts that are row documents already skip the pass through Python."""
    if found.plain:
        return payloads.select(F.col(f"`{payloads.columns[0]}`").cast("string").alias("value"))
    return rows_of(payloads, path, otlp, ignore_errors)
