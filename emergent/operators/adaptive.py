"""Workload-adaptive layout: what queries filter and group by decides physical order and count summaries."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from emergent.sources.store import Manifest, Store, Table

STATS_TABLE = "__stats"


@dataclass
class Usage:
    """Counts by table (``store.table``, lower case): filters and groups of columns, and sets of columns grouped together."""

    filters: Counter = field(default_factory=Counter)
    groups: Counter = field(default_factory=Counter)
    sets: Counter = field(default_factory=Counter)

    def observe(self, table: str, filtered: set[str], grouped: tuple[str, ...]) -> None:
        self.filters.update((table, c) for c in filtered)
        self.groups.update((table, c) for c in grouped)
        if grouped:
            self.sets[table, tuple(sorted(grouped))] += 1

    def rows(self) -> list[tuple[str, str, int, int]]:
        return [(t, c, self.filters[t, c], self.groups[t, c]) for t, c in sorted({*self.filters, *self.groups})]

    def order(self, table: str) -> tuple[str, ...]:
        """The two columns that matter most: filters count twice, ties go by name."""
        columns = {c for t, c in {*self.filters, *self.groups} if t == table}
        return tuple(sorted(columns, key=lambda c: (-(2 * self.filters[table, c] + self.groups[table, c]), c))[:2])

    def hottest(self, table: str) -> tuple[str, ...]:
        own = [(n, s) for (t, s), n in self.sets.items() if t == table]
        return min(own, key=lambda x: (-x[0], x[1]))[1] if own else ()


def optimize(table: Table, key: str, usage: Usage) -> tuple[str, str, int, str]:
    """(table, order_by, rows, mode): rows are range-partitioned and sorted by the columns that matter most.

    full rewrites all parts, incremental only those added since the last time in the same order, noop none.
    """
    manifest = table.manifest()
    names = {c.lower(): c for c in manifest.columns}
    order = tuple(names[c.lower()] for c in usage.order(key) if c.lower() in names)
    shown = ", ".join(f'"{c}"' for c in order)
    if not order:
        return table.name, "", 0, "noop"
    settled = tuple(p for p in manifest.parts if p.order == order)
    tail = tuple(p for p in manifest.parts if p.order != order)
    if manifest.order == order and not tail:
        return table.name, shown, 0, "noop"
    incremental = manifest.order == order and bool(settled)
    if not incremental:
        settled, tail = (), manifest.parts
    rows = table.read_parts(manifest, tail)
    columns = [F.col(f"`{c}`") for c in order]
    part = table.write_part(rows.repartitionByRange(*columns).sortWithinPartitions(*columns), manifest.columns, manifest.version + 1, order)
    table.commit(replace(manifest, parts=(*settled, part), optimized=manifest.version + 1, order=order))
    return table.name, shown, part.rows, "incremental" if incremental else "full"


def project(table: Table, key: str, usage: Usage) -> tuple[str, str | None, str | None, int]:
    """(table, projection, group_columns, rows): counts of the hottest set of columns as table ``<t>__proj``."""
    columns = usage.hottest(key)
    manifest = table.manifest()
    names = {c.lower(): c for c in manifest.columns}
    if not columns or any(c.lower() not in names for c in columns):
        return table.name, None, None, 0
    columns = tuple(names[c.lower()] for c in columns)
    counted = table.read(manifest).groupBy(*(f"`{c}`" for c in columns)).agg(F.count(F.lit(1)).alias("count"))
    summary = table.store.table(f"{table.name}__proj")
    kinds = {c: manifest.columns[c] for c in columns} | {"count": "BIGINT"}
    base = summary.manifest() or Manifest()
    written = summary.replace_rows(counted, kinds, replace(base, batches={"base": manifest.version}))
    return table.name, summary.name, ", ".join(columns), written.rows


def fresh_projection(table: Table, grouped: tuple[str, ...]) -> Table | None:
    """The summary of exactly these columns, if it was made from the table as it is now."""
    summary = table.store.table(f"{table.name}__proj")
    made, manifest = summary.manifest(), table.manifest()
    if made is None or manifest is None or made.batches.get("base") != manifest.version:
        return None
    own = sorted(c.lower() for c in made.columns if c != "count")
    return summary if own == sorted(c.lower() for c in grouped) else None


def save(store: Store, name: str, usage: Usage) -> int:
    """Write the usage of a store's tables into the store; the number of entries."""
    rows = [("column", t, c, f, g) for t, c, f, g in usage.rows() if t.startswith(f"{name}.")]
    rows += [("set", t, "\x1f".join(s), 0, n) for (t, s), n in sorted(usage.sets.items()) if t.startswith(f"{name}.")]
    schema = T.StructType([T.StructField(n, k) for n, k in (("kind", T.StringType()), ("tbl", T.StringType()), ("item", T.StringType()), ("filters", T.LongType()), ("groups", T.LongType()))])
    store.table(STATS_TABLE).create(store.spark.createDataFrame(rows, schema))
    return len(rows)


def load(store: Store, usage: Usage) -> int:
    """Add what was saved to the live counts."""
    table = store.table(STATS_TABLE)
    if table.manifest() is None:
        return 0
    rows = table.read().collect()
    for r in rows:
        if r["kind"] == "set":
            usage.sets[r["tbl"], tuple(r["item"].split("\x1f"))] += r["groups"]
        else:
            usage.filters[r["tbl"], r["item"]] += r["filters"]
            usage.groups[r["tbl"], r["item"]] += r["groups"]
    return len(rows)
