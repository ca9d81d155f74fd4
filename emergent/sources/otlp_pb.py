"""OTLP protobuf messages, from field numbers to JSON documents; descriptors are built at run time."""

from __future__ import annotations

from functools import lru_cache
from typing import Any

from google.protobuf import descriptor_pb2, descriptor_pool, json_format, message_factory

# Message, then its fields as name, number and type; * marks repeated fields, ? members of the oneof.
MESSAGES = """
AnyValue string_value 1 string?, bool_value 2 bool?, int_value 3 int64?, double_value 4 double?, array_value 5 ArrayValue?, kvlist_value 6 KeyValueList?, bytes_value 7 bytes?
ArrayValue values 1 AnyValue*
KeyValueList values 1 KeyValue*
KeyValue key 1 string, value 2 AnyValue
InstrumentationScope name 1 string, version 2 string, attributes 3 KeyValue*, dropped_attributes_count 4 uint32
Resource attributes 1 KeyValue*, dropped_attributes_count 2 uint32
Event time_unix_nano 1 fixed64, name 2 string, attributes 3 KeyValue*, dropped_attributes_count 4 uint32
Link trace_id 1 bytes, span_id 2 bytes, trace_state 3 string, attributes 4 KeyValue*, dropped_attributes_count 5 uint32, flags 6 fixed32
Status message 2 string, code 3 int32
Span trace_id 1 bytes, span_id 2 bytes, trace_state 3 string, parent_span_id 4 bytes, name 5 string, kind 6 int32, start_time_unix_nano 7 fixed64, end_time_unix_nano 8 fixed64, attributes 9 KeyValue*, dropped_attributes_count 10 uint32, events 11 Event*, dropped_events_count 12 uint32, links 13 Link*, dropped_links_count 14 uint32, status 15 Status, flags 16 fixed32
ScopeSpans scope 1 InstrumentationScope, spans 2 Span*, schema_url 3 string
ResourceSpans resource 1 Resource, scope_spans 2 ScopeSpans*, schema_url 3 string
ExportTrace resource_spans 1 ResourceSpans*
LogRecord time_unix_nano 1 fixed64, severity_number 2 int32, severity_text 3 string, body 5 AnyValue, attributes 6 KeyValue*, dropped_attributes_count 7 uint32, flags 8 fixed32, trace_id 9 bytes, span_id 10 bytes, observed_time_unix_nano 11 fixed64
ScopeLogs scope 1 InstrumentationScope, log_records 2 LogRecord*, schema_url 3 string
ResourceLogs resource 1 Resource, scope_logs 2 ScopeLogs*, schema_url 3 string
ExportLogs resource_logs 1 ResourceLogs*
NumberDataPoint start_time_unix_nano 2 fixed64, time_unix_nano 3 fixed64, as_double 4 double?, as_int 6 sfixed64?, attributes 7 KeyValue*, flags 8 uint32
HistogramDataPoint start_time_unix_nano 2 fixed64, time_unix_nano 3 fixed64, count 4 fixed64, sum 5 double, bucket_counts 6 fixed64*, explicit_bounds 7 double*, attributes 9 KeyValue*, flags 10 uint32, min 11 double, max 12 double
SummaryDataPoint start_time_unix_nano 2 fixed64, time_unix_nano 3 fixed64, count 4 fixed64, sum 5 double, attributes 7 KeyValue*, flags 8 uint32
Gauge data_points 1 NumberDataPoint*
Sum data_points 1 NumberDataPoint*, aggregation_temporality 2 int32, is_monotonic 3 bool
Histogram data_points 1 HistogramDataPoint*, aggregation_temporality 2 int32
Summary data_points 1 SummaryDataPoint*
Metric name 1 string, description 2 string, unit 3 string, gauge 5 Gauge?, sum 7 Sum?, histogram 9 Histogram?, summary 11 Summary?, metadata 12 KeyValue*
ScopeMetrics scope 1 InstrumentationScope, metrics 2 Metric*, schema_url 3 string
ResourceMetrics resource 1 Resource, scope_metrics 2 ScopeMetrics*, schema_url 3 string
ExportMetrics resource_metrics 1 ResourceMetrics*
PartialSuccess rejected 1 int64, error_message 2 string
Response partial_success 1 PartialSuccess
RpcStatus code 1 int32, message 2 string
"""
REQUESTS = {"traces": "ExportTrace", "logs": "ExportLogs", "metrics": "ExportMetrics"}


@lru_cache(maxsize=1)
def _pool() -> descriptor_pool.DescriptorPool:
    file = descriptor_pb2.FileDescriptorProto(name="otlp.proto", package="otlp", syntax="proto3")
    field = descriptor_pb2.FieldDescriptorProto
    for line in MESSAGES.strip().splitlines():
        name, _, rest = line.partition(" ")
        message = file.message_type.add(name=name)
        for item in rest.split(", "):
            label, number, kind = item.split(" ")
            one = message.field.add(name=label, number=int(number), label=field.LABEL_REPEATED if kind.endswith("*") else field.LABEL_OPTIONAL)
            if kind.endswith("?"):
                if not message.oneof_decl:
                    message.oneof_decl.add(name="value_of")
                one.oneof_index = 0
            kind = kind.rstrip("*?")
            if kind[0].isupper():
                one.type, one.type_name = field.TYPE_MESSAGE, f".otlp.{kind}"
            else:
                one.type = getattr(field, f"TYPE_{kind.upper()}")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return pool


def message(name: str) -> Any:
    return message_factory.GetMessageClass(_pool().FindMessageTypeByName(f"otlp.{name}"))()


def decode(signal: str, body: bytes) -> dict[str, Any]:
    """The JSON document of an export request."""
    one = message(REQUESTS[signal])
    one.ParseFromString(body)
    return json_format.MessageToDict(one, use_integers_for_enums=True)


def accepted() -> bytes:
    """The response to a request of which nothing was rejected."""
    one = message("Response")
    one.partial_success.SetInParent()
    return one.SerializeToString()


def failed(code: int, text: str) -> bytes:
    one = message("RpcStatus")
    one.code, one.message = code, text
    return one.SerializeToString()
