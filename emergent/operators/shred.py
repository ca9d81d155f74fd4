"""Shredding: row documents (JSON text) to typed columns.

``from_json`` with a schema built from the columns' paths does the work inside the JVM; dates and timestamps are extracted as strings and
parsed by expressions. Envelopes that Arrow could read are exploded there too. Only columns that hold JSON text, whose strings must keep their quotes, and names that differ in case alone go
through Arrow batches in Python, and only with the columns that need it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emergent.functions import temporal
from emergent.functions.jsonparse import loads
from emergent.functions.lattice import Column, compact, spark_type

if TYPE_CHECKING:
    from emergent.operators.infer import Inferred


def _base(kind: str) -> str:
    return kind.rstrip("[]")


def _raw_type(kind: str) -> T.DataType:
    """What from_json extracts: strings for what is parsed later."""
    if kind.endswith("[]"):
        return T.ArrayType(_raw_type(kind[:-2]))
    return T.StringType() if kind in ("DATE", "TIMESTAMP") else spark_type(kind)


def _finished(value: SparkColumn, kind: str) -> SparkColumn:
    if kind.endswith("[]"):
        return F.transform(value, lambda x: _finished(x, kind[:-2])) if _base(kind) in ("DATE", "TIMESTAMP") else value
    if kind == "DATE":
        return temporal.date_column(value)
    return temporal.timestamp_column(value) if kind == "TIMESTAMP" else value


def _slow(columns: list[Column]) -> set[str]:
    """Columns that from_json can't give: JSON text, and keys that Spark can't tell apart."""
    found = {c.name for c in columns if _base(c.type) in ("JSON", "HUGEINT")}
    seen: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for c in columns:
        for k in range(1, len(c.path) + 1):
            seen.setdefault(tuple(p.lower() for p in c.path[:k]), set()).add(c.path[:k])
    clash = {low for low, paths in seen.items() if len(paths) > 1}
    return found | {c.name for c in columns if any(tuple(p.lower() for p in c.path[:k]) in clash for k in range(1, len(c.path) + 1))}


def _struct(columns: list[Column], depth: int = 0) -> T.StructType:
    groups: dict[str, list[Column]] = {}
    for c in columns:
        groups.setdefault(c.path[depth], []).append(c)
    return T.StructType([T.StructField(key, _raw_type(g[0].type) if len(g) == 1 and len(g[0].path) == depth + 1 else _struct(g, depth + 1)) for key, g in groups.items()])


def get(document: Any, path: tuple[str, ...]) -> Any:
    for key in path:
        if not isinstance(document, dict):
            return None
        document = document.get(key)
    return document


def fill(value: Any, kind: str) -> Any:
    """A JSON value as a column of this type shows it; None where it doesn't fit."""
    if value is None:
        return None
    if kind.endswith("[]"):
        return [fill(v, kind[:-2]) for v in value] if isinstance(value, list) else None
    if kind == "JSON":
        return compact(value)
    if kind == "VARCHAR":
        return value if isinstance(value, str) else compact(value)
    if kind == "BOOLEAN":
        return value if isinstance(value, bool) else None
    if kind == "BIGINT":
        return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None
    if kind == "DOUBLE":
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if kind == "DATE":
        return temporal.parse_date(value) if isinstance(value, str) else None
    if kind == "TIMESTAMP":
        day = temporal.parse_date(value) if isinstance(value, str) else None
        return pd.Timestamp(day).to_pydatetime() if day else temporal.parse_timestamp(value) if isinstance(value, str) else None
    return None


def shred(rows: DataFrame, columns: list[Column], scalar: bool = False) -> DataFrame:
    """Typed columns from column ``value`` of row documents; broken rows (null) give none."""
    rows = rows.where("value is not null")
    if scalar:
        columns = [Column(columns[0].name, ("value",), columns[0].type)] if columns else []
        rows = rows.select(F.concat(F.lit('{"value":'), "value", F.lit("}")).alias("value"))
    slow_names = _slow(columns)
    fast = [c for c in columns if c.name not in slow_names]
    slow = [c for c in columns if c.name in slow_names]
    parts: list[SparkColumn] = []
    if fast:
        parts.append(F.from_json("value", _struct(fast), {"allowNonNumericNumbers": "true"}).alias("_fast"))
    if slow:
        names = [f"c{i}" for i in range(len(slow))]
        kinds = T.StructType([T.StructField(n, spark_type(c.type)) for n, c in zip(names, slow, strict=True)])

        @F.pandas_udf(kinds)
        def pick(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                documents = [loads(t) for t in texts]
                yield pd.DataFrame({n: pd.Series([fill(get(d, c.path), c.type) for d in documents], dtype=object) for n, c in zip(names, slow, strict=True)})

        parts.append(pick("value").alias("_slow"))
    if not parts:
        return rows.select()
    parsed = rows.select(*parts)
    out = []
    for c in columns:
        if c.name in slow_names:
            value = F.col("_slow")[f"c{slow.index(c)}"]
        else:
            value = F.col("_fast")
            for key in c.path:
                value = value.getItem(key)
            value = _finished(value, c.type)
        out.append(value.alias(c.name, metadata={"lattice": "JSON"}) if _base(c.type) == "JSON" else value.alias(c.name))
    return parsed.select(*out)


def _placed(found: Inferred, columns: list[Column], path: list[str]) -> list[list[Column]] | None:
    """Columns by the level of the envelope that from_json takes them from, or None where only rows that Python makes show the same."""
    levels = found.levels
    if not levels or _slow(columns) or any(_base(c.type) == "VARCHAR" and ".".join(c.path) in levels["numbers"] for c in columns):
        return None  # numbers in a column of texts are written anew
    placed: list[list[Column]] = [[] for _ in levels["names"]]
    for c in columns:
        at = [i for i, names in enumerate(levels["names"]) if c.path[0] in names]
        if not at or len(at) > 1 and c.path[0] not in levels["always"][at[-1]]:
            return None
        placed[at[-1]].append(c)
    if not placed[-1] or any(c.path[0].lower() == key.lower() for key, own in zip(path, placed, strict=False) for c in own):
        return None
    return placed


def _exploded(payloads: DataFrame, placed: list[list[Column]], path: list[str], lists: list[bool], order: list[Column]) -> DataFrame:
    """Typed rows of envelopes, read and exploded inside the JVM."""
    kind = _struct(placed[-1])
    for own, key, many in reversed(list(zip(placed, path, lists, strict=False))):
        kind = T.StructType([*(_struct(own) if own else []), T.StructField(key, T.ArrayType(kind) if many else kind)])
    rows, done = payloads.select(F.from_json(F.col(f"`{payloads.columns[0]}`").cast("string"), kind, {"allowNonNumericNumbers": "true"}).alias("_row")), []
    for i, own in enumerate(placed):
        taken = []
        for c in own:
            value = F.col("_row")
            for key in c.path:
                value = value.getItem(key)
            taken.append(_finished(value, c.type).alias(f"_{order.index(c)}"))
        rest = [F.col("_row").getItem(path[i]).alias("_row")] if i < len(path) else []
        rows = rows.select(*done, *taken, *rest)
        done += [f"_{order.index(c)}" for c in own]
        if rest:
            rows = rows.select(*done, F.explode("_row").alias("_row")) if lists[i] else rows
    return rows.select(*(F.col(f"_{i}").alias(c.name) for i, c in enumerate(order)))


def typed(payloads: DataFrame, found: Inferred, columns: list[Column], path: list[str], otlp: bool, ignore_errors: bool = False) -> DataFrame:
    """Payloads that were inferred as typed rows."""
    from emergent.operators.infer import documents_of

    placed = _placed(found, columns, path)
    if placed:
        return _exploded(payloads, placed, path, found.levels["lists"], columns)
    return shred(documents_of(payloads, found, path, otlp, ignore_errors), columns, found.scalar)


def records(payloads: DataFrame, path: list[str] | None = None, otlp: bool = False, ignore_errors: bool = False) -> DataFrame:
    """Typed rows of a DataFrame of payloads, with the columns that their documents have."""
    from emergent.operators.infer import infer

    found = infer(payloads, path, otlp, ignore_errors)
    if not found.columns:
        return payloads.sparkSession.createDataFrame([], T.StructType([T.StructField("value", T.StringType(), True, {"lattice": "JSON"})]))
    return typed(payloads, found, found.columns, path or [], otlp, ignore_errors)
