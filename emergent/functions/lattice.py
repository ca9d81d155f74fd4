"""The widening lattice of column types, and the tree of paths that inference merges documents into.

Types are written as SQL shows them: BOOLEAN, BIGINT, DOUBLE, DATE, TIMESTAMP, VARCHAR, JSON, and lists of them as ``BIGINT[]``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from emergent.functions.temporal import sniff

# Limits on the depth that is flattened, the depth that is followed at all, and the number of columns.
FLATTEN_DEPTH, NEST_DEPTH, MAX_COLUMNS = 16, 128, 10_000
INT64 = range(-(1 << 63), 1 << 63)


class PayloadError(ValueError):
    """A payload that cannot become rows."""


def scalar_kind(value: Any) -> str:
    """The type of one JSON scalar; null is UNSET."""
    if value is None:
        return "UNSET"
    if isinstance(value, bool):
        return "BOOLEAN"
    if isinstance(value, int):
        return "BIGINT" if value in INT64 else "DOUBLE"
    if isinstance(value, float):
        return "DOUBLE"
    return sniff(value)


def join_scalar(a: str, b: str) -> str:
    if a == b or b == "UNSET":
        return a
    if a == "UNSET":
        return b
    if {a, b} == {"BIGINT", "DOUBLE"}:
        return "DOUBLE"
    if {a, b} == {"DATE", "TIMESTAMP"}:
        return "TIMESTAMP"
    return "VARCHAR"


_INTEGERS = ("TINYINT", "SMALLINT", "INTEGER", "BIGINT")
_NUMBERS = (*_INTEGERS, "HUGEINT", "FLOAT", "DOUBLE")
_PLAIN = (*_NUMBERS, "BOOLEAN", "DATE", "TIMESTAMP", "VARCHAR")


def join_column(old: str, new: str) -> str:
    """The type of a column that held ``old`` and now also gets ``new``."""
    if old == new:
        return old
    if "JSON" in (old, new):
        return "JSON"
    if old.endswith("[]") and new.endswith("[]"):
        return join_column(old[:-2], new[:-2]) + "[]"
    if old.endswith("[]") or new.endswith("[]"):
        return "JSON" if old.endswith("[]") or old in _PLAIN else old
    if old not in _PLAIN:
        return old
    if old in _INTEGERS and new in _INTEGERS:
        return new
    if old in _NUMBERS and new in _NUMBERS:
        return "HUGEINT" if old == "HUGEINT" and new in _INTEGERS else "DOUBLE"
    if {old, new} == {"DATE", "TIMESTAMP"}:
        return "TIMESTAMP"
    return "VARCHAR"


@dataclass
class Node:
    """What is known about one path. shape is UNSET, SCALAR, OBJECT, ARRAY or JSON; children keep first-seen order."""

    shape: str = "UNSET"
    kind: str = "UNSET"
    children: dict[str, Node] = field(default_factory=dict)
    element: Node | None = None

    def demote(self) -> None:
        self.shape, self.kind, self.children, self.element = "JSON", "UNSET", {}, None

    def _becomes(self, shape: str) -> bool:
        """Whether the node has this shape now; two shapes at one path make it JSON."""
        if self.shape == "UNSET":
            self.shape = shape
        elif self.shape not in (shape, "JSON"):
            self.demote()
        return self.shape == shape

    def add(self, value: Any, depth: int = 0) -> None:
        """Merge one JSON value."""
        if value is None or self.shape == "JSON":
            return
        if depth > NEST_DEPTH:
            self.demote()
        elif isinstance(value, dict):
            if self._becomes("OBJECT"):
                for key, inner in value.items():
                    child = self.children.get(key)
                    if child is None:
                        child = self.children[key] = Node()
                    child.add(inner, depth + 1)
        elif isinstance(value, list):
            if self._becomes("ARRAY"):
                self.element = self.element or Node()
                for inner in value:
                    self.element.add(inner, depth + 1)
        elif self._becomes("SCALAR"):
            self.kind = join_scalar(self.kind, scalar_kind(value))

    def merge(self, other: Node) -> Node:
        """Merge what another part of the input has seen; order of children: own first."""
        if other.shape == "UNSET" or self.shape == "JSON":
            return self
        if other.shape == "JSON":
            self.demote()
        elif self._becomes(other.shape):
            if self.shape == "SCALAR":
                self.kind = join_scalar(self.kind, other.kind)
            elif self.shape == "ARRAY":
                self.element = (self.element or Node()).merge(other.element or Node())
            for key, child in other.children.items():
                self.children.setdefault(key, Node()).merge(child)
        return self

    def type(self) -> str:
        """The type of a column that holds this node whole."""
        if self.shape == "UNSET":
            return "VARCHAR"
        if self.shape == "SCALAR":
            return "VARCHAR" if self.kind == "UNSET" else self.kind
        if self.shape == "ARRAY" and self.element is not None and self.element.shape in ("UNSET", "SCALAR", "ARRAY"):
            return self.element.type() + "[]"
        return "VARCHAR[]" if self.shape == "ARRAY" and self.element is None else "JSON"

    def seen(self) -> bool:
        """Whether any value but null was seen."""
        return self.shape != "UNSET"

    def dump(self) -> list:
        return [self.shape, self.kind, [[k, c.dump()] for k, c in self.children.items()], self.element.dump() if self.element else None]

    @classmethod
    def load(cls, raw: list) -> Node:
        return cls(raw[0], raw[1], {k: cls.load(c) for k, c in raw[2]}, cls.load(raw[3]) if raw[3] else None)


@dataclass(frozen=True)
class Column:
    """A flattened column: its dotted name, the path of keys, its type, and whether only nulls were seen."""

    name: str
    path: tuple[str, ...]
    type: str
    unset: bool = False


def flatten(root: Node) -> list[Column]:
    """Columns depth first in first-seen order; names that collide without case get _1, _2 and so on."""
    out: list[Column] = []
    taken: set[str] = set()

    def visit(node: Node, path: tuple[str, ...]) -> None:
        if node.shape == "OBJECT" and node.children and len(path) < FLATTEN_DEPTH:
            for key, child in node.children.items():
                visit(child, (*path, key))
            return
        if not path:
            return
        name, n = ".".join(path), 0
        while (name if not n else f"{name}_{n}").lower() in taken:
            n += 1
        name = name if not n else f"{name}_{n}"
        taken.add(name.lower())
        out.append(Column(name, path, node.type(), not node.seen()))
        if len(out) > MAX_COLUMNS:
            raise PayloadError(f"payload has more than {MAX_COLUMNS} columns")

    visit(root, ())
    return out


_SPARK = {
    "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "VARCHAR": T.StringType(), "JSON": T.StringType(), "HUGEINT": T.DecimalType(38, 0),
}


def spark_type(name: str) -> T.DataType:
    return T.ArrayType(spark_type(name[:-2])) if name.endswith("[]") else _SPARK.get(name) or T._parse_datatype_string(name)


def type_name(kind: T.DataType) -> str:
    """The lattice name of a Spark type; types outside the lattice keep Spark's name."""
    if isinstance(kind, T.ArrayType):
        return type_name(kind.elementType) + "[]"
    if isinstance(kind, T.TimestampType):
        return "TIMESTAMP"
    return next((n for n, k in _SPARK.items() if k == kind and n != "JSON"), kind.simpleString())


_encode = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def compact(value: Any) -> str:
    """Compact JSON text."""
    return _encode(value)


def raw_type(text: str | None) -> str | None:
    """The JSON type of a text; a text that isn't JSON is a String."""
    from emergent.functions.jsonparse import loads

    if text is None:
        return None
    try:
        value = loads(text)
    except ValueError:
        return "String"
    if isinstance(value, bool):
        return "Bool"
    if isinstance(value, int):
        return "Int64" if value in INT64 else "UInt64" if 0 <= value < 1 << 64 else "Double"
    return {type(None): "Null", float: "Double", str: "String", list: "Array"}.get(type(value), "Object")


def raw_infer(text: str | None) -> str | None:
    """The inferred type of a text; objects list their flattened columns."""
    from emergent.functions.jsonparse import loads

    if text is None:
        return None
    try:
        value = loads(text)
    except ValueError:
        return "VARCHAR"
    root = Node()
    root.add(value)
    if root.shape == "OBJECT" and root.children:
        return "OBJECT(" + ", ".join(f"{c.name} {c.type}" for c in flatten(root)) + ")"
    return root.type()
