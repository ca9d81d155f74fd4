"""SQL functions: raw_type, raw_infer, and the table function raw_records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emergent.functions import lattice
from emergent.functions.jsonparse import check_uniform, split
from emergent.operators.shred import fill, get
from emergent.operators.transforms import Registry, apply
from emergent.session import ship

VALUE = T.StructType([T.StructField("value", T.StringType(), True, {"lattice": "JSON"})])


def _mapped(function: Callable[[str], str | None]):
    """A text function over Arrow batches; the UDF is made in the driver only."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore").astype(object)

    return F.pandas_udf(run, T.StringType())


def _rows(payload: str, path: list[str], otlp: bool, ignore_errors: bool) -> tuple[list[Any], list[lattice.Column], bool]:
    documents, _ = split(payload, ignore_errors)
    rows = apply(documents, path, otlp)
    scalar = check_uniform(sum(isinstance(r, dict) for r in rows), len(rows))
    root = lattice.Node()
    for row in rows:
        root.add(row)
    if scalar:
        return rows, [lattice.Column("value", (), root.type())] if root.seen() else [], True
    return rows, lattice.flatten(root), False


def make_records(own: dict[str, str]) -> type:
    """The handler of raw_records with the user's transforms; its columns follow from the constant payload."""

    class Records:
        @staticmethod
        def _plan(payload: Any, transform: Any, explode: Any, ignore_errors: Any) -> tuple[list[Any], list[lattice.Column], bool]:
            registry = Registry()
            registry.own = dict(own)
            if payload is None:
                raise lattice.PayloadError("raw_records: payload may not be NULL")
            return _rows(payload, *registry.resolve(transform, explode), bool(ignore_errors))

        @staticmethod
        def analyze(payload, transform=None, explode=None, ignore_errors=None):
            from pyspark.sql.udtf import AnalyzeResult

            constant = [a.value if a is not None else None for a in (payload, transform, explode, ignore_errors)]
            _, columns, _ = Records._plan(*constant)
            if not columns:
                return AnalyzeResult(VALUE)
            return AnalyzeResult(T.StructType([T.StructField(c.name, lattice.spark_type(c.type)) for c in columns]))

        def eval(self, payload, transform=None, explode=None, ignore_errors=None) -> Iterator[tuple]:
            rows, columns, scalar = self._plan(payload, transform, explode, ignore_errors)
            for row in rows if columns else []:
                yield tuple(fill(row if scalar else get(row, c.path), c.type) for c in columns)

    return Records


def register(spark: SparkSession, registry: Registry | None = None) -> None:
    """Make the functions known to a session; again after transforms were defined, to make these known too."""
    ship(spark)
    spark.udf.register("raw_type", _mapped(lattice.raw_type))
    spark.udf.register("raw_infer", _mapped(lattice.raw_infer))
    spark.udtf.register("raw_records", F.udtf(make_records(dict(registry.own) if registry else {})))
