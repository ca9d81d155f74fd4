"""Ingest into tables of a Spark catalog, whose files other engines own.

Columns are added, and widened where the catalog can change a column's type; elsewhere values are cast to the type that there is, and one
that it can't hold is an error: the whole ingest fails and no row arrives.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException, UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emergent.functions import lattice
from emergent.operators.infer import infer
from emergent.operators.ingest import Result
from emergent.operators.shred import typed
from emergent.operators.transforms import Registry


def ingest_catalog(spark: SparkSession, table: str, payloads: DataFrame, registry: Registry, transform: str | None = None, explode: str | None = None, ignore_errors: bool = False) -> Result:
    """Append the payloads' rows; what this did, as for the engine's own tables."""
    path, otlp = registry.resolve(transform, explode)
    found = infer(payloads, path, otlp, ignore_errors)
    if not found.columns:
        if not spark.catalog.tableExists(table):
            raise lattice.PayloadError(f"cannot create table {table} from an empty payload")
        return Result(table, errors=found.errors)
    rows = typed(payloads, found, found.columns, path, otlp, ignore_errors)
    if not spark.catalog.tableExists(table):
        rows.write.format("parquet").saveAsTable(table)
        return Result(table, True, len(found.columns), 0, found.rows, found.errors)
    own = {f.name.lower(): f for f in spark.table(table).schema}
    missing = [c for c in found.columns if c.name.lower() not in own]
    if missing:
        added = ", ".join(f"`{c.name}` {lattice.spark_type(c.type).simpleString()}" for c in missing)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({added})")
    widened = 0
    for c in found.columns:
        field = own.get(c.name.lower())
        wider = lattice.join_column(lattice.type_name(field.dataType), c.type) if field and not c.unset else ""
        if wider and wider != lattice.type_name(field.dataType) and _altered(spark, table, field.name, wider):
            widened += 1
    names = {c.name.lower(): c for c in found.columns}
    fitted = [_fitted(names[f.name.lower()].name, f) if f.name.lower() in names else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.table(table).schema]
    rows.select(*fitted).write.insertInto(table)
    return Result(table, False, len(missing), widened, found.rows, found.errors)


def _altered(spark: SparkSession, table: str, column: str, kind: str) -> bool:
    """Whether the catalog has changed the column's type."""
    try:
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{column}` TYPE {lattice.spark_type(kind).simpleString()}")
    except (AnalysisException, ParseException, UnsupportedOperationException):
        return False
    return True


def _fitted(name: str, field: T.StructField) -> Column:
    """A column as the table's type; a value that doesn't fit raises, whatever the session's cast mode is."""
    value = F.col(f"`{name}`")
    cast = value.try_cast(field.dataType)
    wrong = F.raise_error(F.concat(F.lit(f"column {field.name} of type {field.dataType.simpleString()} can't hold "), value.cast("string")))
    return F.when(value.isNotNull() & cast.isNull(), wrong.cast(field.dataType)).otherwise(cast).alias(field.name)
