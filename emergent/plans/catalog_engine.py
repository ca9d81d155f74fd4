"""More registered queries: the engine's statements, transforms, settings and lanes, each with SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emergent.operators.shred import records
from emergent.operators.transforms import Registry
from emergent.plans.catalog import ORACLE, QUERIES, _shared, documents, engine, query, table
from emergent.plans.sqlfront import Engine
from emergent.session import shared_dir
from emergent.streaming import sink

# OpenTelemetry and cloud envelopes; an envelope holds at most 256 records, however large the table is


def _word(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))


def _whole(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("intValue")).alias("value"))


def _enveloped(spark: SparkSession, sf_dir: str, record: Column, names: tuple[str, str, str]) -> DataFrame:
    """Events as OTLP documents; names: the resource's, the scope's and the record's list."""
    service = F.concat(F.lit("svc_"), (F.col("user_id") % 4).cast("string")).alias("service")
    groups = table(spark, sf_dir, "events").groupBy(service, F.expr("event_id div 256")).agg(F.collect_list(record).alias(names[2]))
    resource = F.struct(F.array(_word("service.name", F.col("service"))).alias("attributes"))
    return documents(groups, F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.col(names[2]))).alias(names[1]))).alias(names[0]))


@query("SELECT 'svc_' || (user_id % 4) AS service, event_type AS body, event_id AS at, user_id AS who FROM events")
def otlp_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(F.col("event_id").cast("string").alias("timeUnixNano"), F.struct(F.col("event_type").alias("stringValue")).alias("body"), F.array(_whole("who", F.col("user_id"))).alias("attributes"))
    rows = records(_enveloped(spark, sf_dir, record, ("resourceLogs", "scopeLogs", "logRecords")), *Registry().resolve("otlp-logs"))
    return rows.select(F.col("`resource.service.name`").alias("service"), "body", F.col("timeUnixNano").alias("at"), "who")


@query("SELECT event_type AS name, 'ms' AS unit, event_id % 2 = 0 AS monotonic, count(*) AS n FROM events GROUP BY ALL")
def otlp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(F.col("event_type").alias("name"), F.lit("ms").alias("unit"), F.struct((F.col("event_id") % 2 == 0).alias("isMonotonic")).alias("sum"))
    rows = records(_enveloped(spark, sf_dir, record, ("resourceMetrics", "scopeMetrics", "metrics")), *Registry().resolve("otlp-metrics"))
    return rows.groupBy("name", "unit", F.col("`sum.isMonotonic`").alias("monotonic")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, 'x' || event_id AS a, event_id AS b, event_type || '!' AS c FROM events")
def otlp_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped arrays, lists of key and value, and attributes without a value, which are skipped.

    Documents are made and read in Python by as many tasks as there are cores, a few each, however few row groups the table's files have.
    """
    events = table(spark, sf_dir, "events").select("event_id", "event_type").repartition(3 * spark.sparkContext.defaultParallelism, "event_id")
    inner = F.struct(F.array(F.struct(F.lit("k").alias("key"), F.struct(F.col("event_id").cast("string").alias("intValue")).alias("value"))).alias("values"))
    values = F.struct(F.array(F.struct(F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("stringValue"))).alias("values"))
    attributes = F.concat(F.lit('[{"key":"list","value":{"arrayValue":'), F.to_json(values), F.lit('}},{"key":"map","value":{"kvlistValue":'), F.to_json(inner), F.lit('}},{"key":"none"},{"key":"c","value":{"stringValue":"'), "event_type", F.lit('!"}}]'))
    docs = events.select(F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":[{"id":'), F.col("event_id").cast("string"), F.lit(',"attributes":'), attributes, F.lit("}]}]}]}")).alias("value"))
    rows = records(docs, *Registry().resolve("otlp-traces"))
    return rows.select("id", F.col("list")[0].alias("a"), F.col("`map.k`").alias("b"), "c")


@query("SELECT event_id AS id, event_type AS name, 'eu' AS region FROM events")
def cloud_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    groups = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 256")).agg(F.collect_list(record).alias("Records"))
    return records(documents(groups, F.lit("eu").alias("region"), F.col("Records")), *Registry().resolve("cloudtrail")).select("id", "name", "region")


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The JSON of each row's binary request, which has a span for each of its ids."""
    from emergent.sources import otlp_pb

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            request = otlp_pb.message("ExportTrace")
            one = request.resource_spans.add()
            attribute = one.resource.attributes.add()
            attribute.key, attribute.value.string_value = "service.name", f"svc_{row['g']}"
            spans = one.scope_spans.add().spans
            for i in row["ids"]:
                span = spans.add()
                span.span_id, span.start_time_unix_nano = (i + 1048576).to_bytes(8, "big"), i + 1  # zero is what protobuf leaves out
            out.append(json.dumps(otlp_pb.decode("traces", request.SerializeToString())))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


@query("SELECT event_id AS id, lower(to_hex(event_id + 1048576)) AS tail, 'svc_' || (user_id % 4) AS service FROM events")
def otlp_protobuf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary OTLP requests of at most 500 spans, as collectors send them; tasks make, decode and stage them, and none is on the driver."""
    e = engine(spark)
    groups = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("g"), F.expr("event_id div 2000")).agg(F.collect_list("event_id").alias("ids"))
    e.enqueue("otel", groups.select("g", "ids").mapInArrow(_requests, "value string"), "otlp-traces")
    e.buffers.close()
    if e.buffers.errors:
        raise RuntimeError("; ".join(e.buffers.errors))
    return e.frame("otel").select((F.col("startTimeUnixNano") - 1).alias("id"), F.ltrim("spanId", F.lit("0")).alias("tail"), F.col("`resource.service.name`").alias("service"))


# Statements over stored tables


def _nested(spark: SparkSession, sf_dir: str) -> Engine:
    """Table events: id, kind, user.id, user.cell."""
    e = engine(spark)
    user = F.struct(F.col("user_id").alias("id"), (F.col("user_id") % 8).alias("cell")).alias("user")
    e.ingest("events", documents(table(spark, sf_dir, "events"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), user))
    return e


@query("SELECT event_id AS id, user_id % 8 AS cell FROM events WHERE user_id % 8 IN (1, 2) AND event_type IS NOT NULL")
def sql_quoted_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).sql("""SELECT id, "user.cell" AS cell FROM events WHERE "user.cell" IN (1, 2) AND kind IS NOT NULL""")


@query("SELECT event_type AS events, count(*) AS n, 'all events here' AS note FROM events WHERE event_id > 10 GROUP BY 1")
def sql_names_and_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).sql("SELECT events.kind AS events, count(*) AS n, 'all events here' AS note FROM main.events WHERE events.id > 10 GROUP BY events.kind")


@query("SELECT * FROM (VALUES ('id', 'BIGINT'), ('kind', 'VARCHAR'), ('user.id', 'BIGINT'), ('user.cell', 'BIGINT')) t(column_name, column_type)")
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).sql("SELECT column_name, column_type FROM (DESCRIBE events)")


@query("SELECT * FROM (VALUES ('id', 'BIGINT'), ('kind', 'VARCHAR'), ('user.id', 'BIGINT'), ('user.cell', 'BIGINT')) t(name, type)")
def table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).sql("SELECT name, type FROM pragma_table_info('events')")


@query("SELECT 'BIGINT' AS a, 'VARCHAR' AS b, 'BIGINT' AS c, count(*) AS n FROM events")
def typeof_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).sql("""SELECT typeof(id) AS a, typeof(kind) AS b, typeof("user.id") AS c, count(*) AS n FROM events GROUP BY ALL""")


@query("SELECT 'main' AS store, 'events' AS name, count(*) AS n FROM events")
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nested(spark, sf_dir)
    return spark.createDataFrame(e.tables(), "store string, name string, n long")


@query("SELECT user_id % 8 AS cell, count(*) AS n FROM events GROUP BY 1")
def ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nested(spark, sf_dir)
    e.sql("""CREATE TABLE cells AS SELECT "user.cell" AS cell, count(*) AS n FROM events GROUP BY "user.cell" """)
    return e.sql("SELECT cell, n FROM cells")


@query("SELECT event_id AS id, event_type AS kind FROM events UNION ALL SELECT -1, 'made' UNION ALL SELECT -2, NULL")
def typed_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nested(spark, sf_dir)
    e.sql("CREATE TABLE plain (id BIGINT, kind VARCHAR)")
    e.sql("INSERT INTO plain SELECT id, kind FROM events")
    e.sql("INSERT INTO plain VALUES (-1, 'made'), (-2, NULL)")
    return e.sql("SELECT id, kind FROM plain")


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE event_type END AS kind FROM events WHERE event_id % 3 <> 0")
def update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nested(spark, sf_dir)
    e.sql("UPDATE events SET kind = 'even' WHERE id % 2 = 0")
    e.sql("DELETE FROM events WHERE id % 3 = 0")
    return e.sql("SELECT id, kind FROM events")


@query("SELECT 0 AS n, 4 AS columns")
def delete_all_keeps_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nested(spark, sf_dir)
    e.sql("DELETE FROM events")
    return spark.createDataFrame([(e.frame("events").count(), len(e.resolve("events").describe()))], "n int, columns int")


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE event_id % 5 = 0")
def drop_and_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nested(spark, sf_dir)
    e.sql("CREATE TABLE kept AS SELECT id, kind FROM events WHERE id % 5 = 0")
    e.sql("DROP TABLE events")
    e.sql("DROP TABLE IF EXISTS events")
    return e.sql("SELECT id, kind FROM kept")


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_id % 2 = 0 OR event_id % 4 = 1")
def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables written in one transaction that another engine then reads."""
    e, rows = engine(spark), table(spark, sf_dir, "events")
    e.ingest("a", documents(rows.where("event_id % 4 = 0"), F.col("event_id").alias("id")))
    e.sql("BEGIN")
    e.ingest("a", documents(rows.where("event_id % 4 = 2"), F.col("event_id").alias("id")))
    e.ingest("b", documents(rows.where("event_id % 4 = 1"), F.col("event_id").alias("id")))
    e.sql("COMMIT")
    other = Engine(spark, e.stores["main"].path)
    return other.sql("SELECT count(*) AS n, sum(id) AS total FROM (SELECT id FROM a UNION ALL SELECT id FROM b)")


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_id % 2 = 0")
def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, rows = engine(spark), table(spark, sf_dir, "events")
    e.ingest("a", documents(rows.where("event_id % 2 = 0"), F.col("event_id").alias("id")))
    e.sql("BEGIN")
    e.ingest("a", documents(rows.where("event_id % 2 = 1"), F.col("event_id").alias("id"), F.lit("x").alias("more")))
    e.sql("ROLLBACK")
    return e.sql("SELECT count(*) AS n, sum(id) AS total FROM a")


@query("SELECT count(*) AS n, 'conflict' AS outcome FROM events")
def txn_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction whose table another engine wrote meanwhile is rolled back whole, and no row is lost."""
    from emergent.sources.store import StoreError

    e, rows = engine(spark), table(spark, sf_dir, "events")
    e.ingest("a", documents(rows.where("event_id % 2 = 0"), F.col("event_id").alias("id")))
    e.sql("BEGIN")
    e.ingest("a", '{"id":-1}')
    Engine(spark, e.stores["main"].path).ingest("a", documents(rows.where("event_id % 2 = 1"), F.col("event_id").alias("id")))
    try:
        e.sql("COMMIT")
        outcome = "committed"
    except StoreError:
        outcome = "conflict"
    return e.sql(f"SELECT count(*) AS n, '{outcome}' AS outcome FROM a")


@query("SELECT event_id AS id, user_id AS u FROM events WHERE event_id % 2 = 0")
def attach_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nested(spark, sf_dir)
    path = f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"
    e.sql(f"ATTACH '{path}' AS side")
    e.sql('CREATE TABLE side.evens AS SELECT id, "user.id" AS u FROM main.events WHERE id % 2 = 0')
    e.sql("DETACH side")
    e.sql(f"ATTACH '{path}' AS again")
    return e.sql("SELECT evens.id, evens.u FROM again.evens JOIN main.events AS m ON m.id = evens.id")


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE event_id % 7 = 0")
def copy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to gzipped NDJSON and back."""
    e = _nested(spark, sf_dir)
    path = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}.json.gz"
    e.sql(f"COPY (SELECT id, kind FROM events WHERE id % 7 = 0) TO '{path}' (FORMAT JSON, COMPRESSION GZIP)")
    e.raw_ingest_file("back", path)
    return e.sql("SELECT id, kind FROM back")


@query("SELECT event_id AS id FROM events WHERE event_id % 11 = 0")
def read_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDJSON files as text, each line of which the INSERT lane takes as a payload."""
    e = engine(spark)
    folder = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
    documents(table(spark, sf_dir, "events").where("event_id % 11 = 0"), F.col("event_id").alias("id")).write.text(folder)
    e.sql(f"INSERT INTO main.ingest.t SELECT value FROM text.`{folder}`")
    return e.sql("SELECT id FROM t")


@query("SELECT event_id AS id, event_id % 3 AS part FROM events")
def insert_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's insert transform explodes what the INSERT lane takes."""
    e = engine(spark)
    items = F.array(F.struct(F.col("event_id").alias("id")))
    docs = documents(table(spark, sf_dir, "events"), (F.col("event_id") % 3).alias("part"), items.alias("items"))
    before = spark.conf.get("emergent.insert.transform", "")
    spark.conf.set("emergent.insert.transform", "items")
    try:
        e.insert_payloads("t", docs)
    finally:
        spark.conf.set("emergent.insert.transform", before)
    return e.sql("SELECT id, part FROM t")


# JSON, VARIANT and widening


@query("SELECT event_id AS id, user_id AS who, event_type AS kind, '\"' || event_type || '\"' AS quoted FROM events")
def json_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark)
    odd = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"d":'), F.when(F.col("event_id") < 0, F.lit("[1]")).otherwise(F.concat(F.lit('{"who":{"no":'), F.col("user_id").cast("string"), F.lit('},"a kind":"'), "event_type", F.lit('"}'))), F.lit("}"))
    e.ingest("t", spark.sql("""SELECT '{"id":-1,"d":[1]}' AS value""").union(table(spark, sf_dir, "events").select(odd.alias("value"))))
    return e.sql("SELECT id, CAST(d -> 'who' ->> 'no' AS BIGINT) AS who, d ->> 'a kind' AS kind, d -> 'a kind' AS quoted FROM t WHERE id >= 0")


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VARIANT through Parquet and back."""
    folder = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.parse_json("props").alias("v")).write.parquet(folder)
    return spark.read.parquet(folder).select("id", F.variant_get("v", "$.k", "bigint").alias("k"))


@query("SELECT event_id AS id, user_id AS who FROM events")
def lookup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value looked up by key in a list of keys and values."""
    pairs = F.array(F.struct(F.lit("kind").alias("key"), F.col("event_type").alias("value")), F.struct(F.lit("who").alias("key"), F.col("user_id").cast("string").alias("value")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), pairs.alias("pairs"))
    return rows.select("id", F.filter("pairs", lambda x: x["key"] == "who")[0]["value"].cast("long").alias("who"))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '[' || user_id || ']' END AS v FROM events")
def widen_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored BIGINT column becomes JSON when lists arrive; what was stored is shown as JSON."""
    e, rows = engine(spark), table(spark, sf_dir, "events")
    e.ingest("t", documents(rows.where("event_id % 2 = 0"), F.col("event_id").alias("id"), F.col("user_id").alias("v")))
    e.ingest("t", documents(rows.where("event_id % 2 = 1"), F.col("event_id").alias("id"), F.array("user_id").alias("v")))
    return e.sql("SELECT id, v FROM t")


@query("SELECT CAST(user_id % 3 AS DOUBLE) AS v, count(*) AS n FROM events GROUP BY 1")
def numbers_in_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 and 1.0 are one value of a column that holds both."""
    v = F.when(F.col("event_id") % 2 == 0, (F.col("user_id") % 3).cast("string")).otherwise(F.concat((F.col("user_id") % 3).cast("string"), F.lit(".0")))
    docs = table(spark, sf_dir, "events").select(F.concat(F.lit('{"v":'), v, F.lit("}")).alias("value"))
    return records(docs).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS kind, true AS close FROM events GROUP BY 1")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over distinct pairs, where both counts are plain aggregates: beside count(DISTINCT) every distinct id would carry a sketch of its own."""
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "event_id").distinct()
    rows = pairs.groupBy("kind").agg(F.approx_count_distinct("event_id", 0.02).alias("a"), F.count("event_id").alias("b"))
    return rows.select("kind", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("close"))


@query("SELECT * FROM (VALUES ('OBJECT(a BIGINT, b.c VARCHAR, d BIGINT[])', 'Object')) t(inferred, kind)")
def infer_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine(spark)
    return spark.sql("""SELECT raw_infer(v) AS inferred, raw_type(v) AS kind FROM VALUES ('{"a":1,"b":{"c":"x"},"d":[1,2]}') AS t(v)""")


@query("SELECT * FROM (VALUES (1, 'depot'), (2, 'depot')) t(no, origin)")
def records_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_records in FROM: its columns follow from the constant payload."""
    rows = engine(spark).sql("""SELECT * FROM raw_records('{"origin":"depot","box":[{"no":1},{"no":2}]}', explode => 'box')""")
    return rows.select(F.col("no").cast("int").alias("no"), "origin")


# What the engine observes and keeps


@query("SELECT * FROM (VALUES ('main.events', 'id', 1, 0), ('main.events', 'kind', 1, 2)) t(\"table\", \"column\", filter_count, group_count)")
def stats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nested(spark, sf_dir)
    e.sql("SELECT kind, count(*) AS n FROM events WHERE id > 5 GROUP BY kind")
    e.sql("SELECT kind, max(id) AS m FROM events WHERE kind <> 'view' GROUP BY kind")
    return e.raw_stats().select("table", "column", F.col("filter_count").cast("int").alias("filter_count"), F.col("group_count").cast("int").alias("group_count"))


@query("SELECT * FROM (VALUES ('main.events', 'kind', 2, 'events__proj')) t(\"table\", group_columns, observed, projection)")
def projections_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nested(spark, sf_dir)
    for _ in range(2):
        e.sql("SELECT kind, count(*) AS n FROM events GROUP BY kind")
    e.raw_project("events")
    return e.sql("SELECT * FROM raw_projections()").select("table", "group_columns", F.col("observed").cast("int").alias("observed"), "projection")


@query("SELECT 'kind' AS \"column\", 2 AS group_count")
def stats_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one engine observed and saved counts for the next; loading adds up."""
    e = _nested(spark, sf_dir)
    e.sql("SELECT kind, count(*) AS n FROM events GROUP BY kind")
    e.raw_stats_save()
    other = Engine(spark, e.stores["main"].path)
    other.raw_stats_load()
    other.raw_stats_load()
    return other.raw_stats().where("group_count > 0").select("column", F.col("group_count").cast("int").alias("group_count"))


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, 'noop' AS mode FROM events")
def optimize_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full, then incremental over what came later, then nothing to do; rows stay."""
    e, rows = engine(spark), table(spark, sf_dir, "events")
    e.ingest("t", documents(rows.where("event_id % 2 = 0"), F.col("event_id").alias("id"), F.col("user_id").alias("u")))
    e.sql("SELECT u FROM t WHERE id > 3")
    modes = [e.raw_optimize("t").first()["mode"]]
    e.ingest("t", documents(rows.where("event_id % 2 = 1"), F.col("event_id").alias("id"), F.col("user_id").alias("u")))
    modes += [e.raw_optimize("t").first()["mode"], e.raw_optimize("t").first()["mode"]]
    assert modes[:2] == ["full", "incremental"], modes
    return e.sql(f"SELECT count(*) AS n, sum(id) AS total, '{modes[2]}' AS mode FROM t")


@query("SELECT event_id AS id, 'depot' AS origin FROM events")
def user_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark)
    e.sql("SELECT raw_transform_define('boxes', 'box.parts')")
    box = F.struct(F.array(F.struct(F.col("event_id").alias("id"))).alias("parts")).alias("box")
    e.ingest("t", documents(table(spark, sf_dir, "events"), F.lit("depot").alias("origin"), box), transform="boxes")
    return e.sql("SELECT id, origin FROM t")


@query("SELECT * FROM (VALUES ('boxes', 'box.parts', false)) t(name, explode, builtin)")
def transforms_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark)
    e.sql("SELECT raw_transform_define('boxes', 'box.parts')")
    return e.sql("SELECT * FROM raw_transforms() WHERE NOT builtin")


# Lanes


@query("SELECT 2 AS targets, count(*) AS n FROM events")
def flush_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_flush tells how many tables and rows it ingested; a payload is a thousand lines, staged by the task that has it."""
    e = engine(spark)
    e.buffers.max_age, e.buffers.max_size = 3600, 1 << 40
    docs = documents(table(spark, sf_dir, "events"), F.col("event_id").alias("id"))
    key = F.get_json_object("value", "$.id").cast("long")
    bodies = docs.groupBy(F.floor(key / 1000).alias("k")).agg(F.array_join(F.collect_list("value"), "\n").alias("body"))
    e.enqueue("even", bodies.where("k % 2 = 0").select("body"))
    e.enqueue("odd", bodies.where("k % 2 <> 0").select("body"))
    e.enqueue("odd", "[]")
    e.enqueue("even", "[]")
    done = e.raw_flush().first()
    e.buffers.close()
    if e.buffers.errors and done["rows"] == 0:
        raise RuntimeError("; ".join(e.buffers.errors))
    return spark.createDataFrame([(2, done["rows"])], "targets int, n long")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def http_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest and query through the HTTP server, by a client that attaches it as a remote store and whose tasks send their rows to it."""
    from emergent.sources.remote import RemoteStore

    e, token = engine(spark), uuid.uuid4().hex
    host = spark.conf.get("spark.driver.host", "127.0.0.1")  # where executors reach this driver
    e.raw_serve(spark.conf.get("spark.driver.bindAddress", host), port=0, token=token)
    try:
        remote = RemoteStore(spark, f"http://{host}:{e.server.port}", token)
        remote.ingest("t", documents(table(spark, sf_dir, "events"), F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
        found = remote.sql("SELECT kind, count(*) AS n FROM t GROUP BY kind").collect()
        return spark.createDataFrame([tuple(r) for r in found], "kind string, n long")
    finally:
        e.raw_serve_stop()


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 1 THEN event_type END AS more FROM events")
def catalog_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest into a table of Spark's catalog, which gets a new column."""
    from emergent.sources.foreign import ingest_catalog

    e, rows, name = engine(spark), table(spark, sf_dir, "events"), f"t_{uuid.uuid4().hex}"
    ingest_catalog(spark, name, documents(rows.where("event_id % 2 = 0"), F.col("event_id").alias("id")), e.registry)
    ingest_catalog(spark, name, documents(rows.where("event_id % 2 = 1"), F.col("event_id").alias("id"), F.col("event_type").alias("more")), e.registry)
    return spark.table(name).select("id", "more")


# Streams and event time


@query(
    "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(o * 30), '%Y-%m-%d %H:%M:%S') AS start, event_type AS kind, count(*) AS n "
    "FROM events, (VALUES (0), (1)) s(o) GROUP BY 1, 2"
)
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sink.windowed_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind"), "ts", ["kind"], "1 hour", "30 minutes")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "kind", "n")


@query("SELECT DISTINCT user_id, event_type AS kind FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, one row kept for each user and kind within a watermark that spans the table."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    once = sink.deduplicated(source.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("kind")), "ts", ["user_id", "kind"], "36500 days")
    once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", "kind")


# Relational operators that the first catalog has no row for; the same text runs in both engines unless said otherwise

_MORE = {
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "window_range_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW), 2) AS near FROM orders",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_right": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "join_anti_some": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    "join_lateral": "SELECT c_custkey, x.big FROM customer, LATERAL (SELECT max(o_totalprice) AS big FROM orders WHERE o_custkey = c_custkey) x",
    "values_list": "SELECT k, v FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS t(k, v)",
    "agg_distinct_filter": "SELECT event_type, count(DISTINCT user_id) FILTER (WHERE event_id % 2 = 0) AS evens, min(ts) AS first_at FROM events GROUP BY event_type",
    "order_desc_nulls_first": "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END DESC NULLS FIRST, o_orderkey LIMIT 30",
    "scalar_regex": "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS p FROM part",
}
_MORE_SQL = {"scalar_regex": _MORE["scalar_regex"].replace("'_')", "'_', 'g')")}
for _name, _text in _MORE.items():
    QUERIES[_name] = _shared(_name, _text)
    ORACLE[_name] = _MORE_SQL.get(_name, _text)


@query("SELECT c_custkey AS k, c_name AS name, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL BY NAME SELECT s_acctbal AS balance, s_suppkey AS k FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("k")), allowMissingColumns=True)


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2")
def qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _shared("qualify", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 2")
    return own(spark, sf_dir)


@query("SELECT CAST(range AS BIGINT) AS id, range % 3 AS m FROM range(100)")
def range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark).sql("SELECT id, id % 3 AS m FROM range(100)")


@query("SELECT o_custkey, count(*) AS n, list_sort(list({'k': o_orderkey, 's': o_orderstatus})) [1].k AS first_key FROM orders GROUP BY o_custkey")
def nested_struct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))).alias("l"))
    return rows.select("o_custkey", F.size("l").cast("long").alias("n"), F.col("l")[0]["k"].alias("first_key"))
