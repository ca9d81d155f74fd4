"""What a batch of row documents holds, read by Arrow's JSON reader instead of value by value.

The reader takes a batch whose texts are one object each, and gives up on anything unusual (mixed kinds at one path, repeated keys, NaN,
broken text): such batches are read value by value. The schema of one batch is the next one's expectation, so documents of a known shape
are read in one pass. Dates and timestamps are read as texts and sniffed once for each distinct value.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj

from emergent.functions.lattice import NEST_DEPTH, Node, flatten, join_scalar
from emergent.functions.temporal import sniff


_kind = lru_cache(maxsize=1 << 15)(sniff)  # days come again in every batch


class Reader:
    """Reads batches one after the other and remembers their shape."""

    def __init__(self) -> None:
        self.known: pa.Schema | None = None

    def tree(self, texts: pa.Array) -> Node | None:
        """The tree of a batch of documents (no nulls), or None if it must be read value by value."""
        table = self.table(texts)
        if table is None:
            return None
        root = Node("OBJECT")
        for name, column in zip(table.column_names, table.columns, strict=True):
            root.children[name] = _node(column.chunk(0), 1)
        return root

    def exploded(self, texts: pa.Array, path: list[str], seen: Collection[str]) -> tuple[Node, int, dict] | None:
        """The tree of the rows that a batch of envelopes explodes to, their number, and their ``levels``; None if they must be read value by value.

        Every envelope must give rows, and Arrow can't tell a null from a missing member: where one level has the other's name, the inner one
        must never be null, and the first row must have all inner members not ``seen`` before, so that columns keep first-seen order.
        """
        table = self.table(texts)
        if table is None:
            return None
        members = {name: column.chunk(0) for name, column in zip(table.column_names, table.columns, strict=True)}
        outer: list[dict[str, pa.Array]] = []
        lists = []
        for key in path:
            inner = members.pop(key, None)
            if inner is None or inner.null_count:
                return None
            lists.append(pa.types.is_list(inner.type))
            if lists[-1]:
                if not pc.all(pc.greater(pc.list_value_length(inner), 0)).as_py():
                    return None
                inner = inner.flatten()
            if not pa.types.is_struct(inner.type) or inner.null_count:
                return None
            outer.append(members)
            members = {f.name: part for f, part in zip(inner.type, inner.flatten(), strict=True)}
            if len(members) != inner.type.num_fields or any(name not in seen and not part[0].is_valid for name, part in members.items()):
                return None
        root, made = Node("OBJECT"), [*outer, members]
        for level in reversed(made):
            for name, part in level.items():
                if name not in root.children:
                    root.children[name] = _node(part, 1)
                elif next(own[name] for own in reversed(made) if name in own).null_count:
                    return None
        numbers = [c.name for c in flatten(root) if c.type.rstrip("[]") in ("BIGINT", "DOUBLE", "HUGEINT")]
        levels = {"lists": lists, "names": [list(own) for own in made], "always": [[n for n, part in own.items() if not part.null_count] for own in made], "numbers": numbers}
        return root, len(inner), levels

    def table(self, texts: pa.Array) -> pa.Table | None:
        whole = pc.and_(pc.starts_with(texts, "{"), pc.ends_with(texts, "}"))
        if not len(texts) or not pc.all(whole).as_py() or pc.any(pc.match_substring(texts, "\n")).as_py():
            return None  # so that no two texts can make one document, nor one text two
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.string())), "\n")[0].as_buffer()
        table = self._read(joined, self.known) if self.known is not None else None
        if table is None or table.schema != self.known:
            table = self._read(joined, None)
            if table is None:
                return None
            plain = pa.schema([pa.field(f.name, _as_text(f.type)) for f in table.schema])
            if plain != table.schema:
                table = self._read(joined, plain)
            if table is None or table.schema != plain:
                return None
            self.known = plain
        if table.num_rows != len(texts) or any(c.num_chunks != 1 for c in table.columns):
            return None
        return table

    def _read(self, text: pa.Buffer, schema: pa.Schema | None) -> pa.Table | None:
        try:
            found = pj.read_json(pa.BufferReader(text), pj.ReadOptions(use_threads=False, block_size=max(len(text) + 1, 1 << 10)), pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="infer"))
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, pa.ArrowKeyError, pa.ArrowTypeError):
            return None
        return found if len(set(found.column_names)) == len(found.column_names) else None


def join_levels(a: dict | None, b: dict | None) -> dict | None:
    """The levels of both of two sets of envelopes; {} are those of none, None those of envelopes that were read value by value."""
    if a is None or b is None or not a or not b:
        return None if a is None or b is None else a or b
    if a["lists"] != b["lists"]:
        return None
    names = [list(dict.fromkeys([*x, *y])) for x, y in zip(a["names"], b["names"], strict=True)]
    always = [[n for n in x if n in y] for x, y in zip(a["always"], b["always"], strict=True)]
    return {"lists": a["lists"], "names": names, "always": always, "numbers": list(dict.fromkeys([*a["numbers"], *b["numbers"]]))}


def _as_text(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _as_text(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(_as_text(kind.value_type))
    return pa.string() if pa.types.is_timestamp(kind) or pa.types.is_date(kind) or pa.types.is_time(kind) else kind


def _node(values: pa.Array, depth: int) -> Node:
    """The tree of one column, null where it has no value."""
    kind = values.type
    if values.null_count == len(values):
        return Node()
    if depth > NEST_DEPTH:
        return Node("JSON")
    if pa.types.is_struct(kind):
        some = values.filter(values.is_valid()) if values.null_count else values
        return Node("OBJECT", children={f.name: _node(part, depth + 1) for f, part in zip(kind, some.flatten(), strict=True)})
    if pa.types.is_list(kind):
        return Node("ARRAY", element=_node(values.flatten(), depth + 1))
    return Node("SCALAR", "BOOLEAN" if pa.types.is_boolean(kind) else "BIGINT" if pa.types.is_integer(kind) else "DOUBLE" if pa.types.is_floating(kind) else _sniffed(values))


def _sniffed(values: pa.Array) -> str:
    """The kind that all texts of a column have in common."""
    if not pc.all(pc.match_substring_regex(values, "^[0-9].{7,39}$")).as_py():
        return "VARCHAR"
    found = "UNSET"
    for text in values.unique().to_pylist():
        if text is not None:
            found = join_scalar(found, _kind(text))
            if found == "VARCHAR":
                break
    return found
