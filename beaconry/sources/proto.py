"""Protobuf payloads to the same document struct the JSON path yields.

Message classes of the ``protobuf`` package (optional extra) are built from the public OTLP field table
below, inside the worker, and payloads are decoded batch-wise with ``mapInArrow``: one narrow pass per
partition, no shuffle. Payloads of the usual form are read field by field over a whole piece (``wire``),
all others by the package, whose results the former's equal.
"""

from __future__ import annotations

import json
from base64 import b64encode
from functools import lru_cache
from itertools import accumulate
from math import isfinite, isnan
from operator import attrgetter
from typing import Any, Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.constants import LOGS, METRICS, PROTOBUF, TRACES
from beaconry.schemas import HEADER_COLUMNS, document

# OTLP v1 messages as "number name type"; * repeated, ? optional, | member of a oneof.
MESSAGES = """
AnyValue: 1 string_value string|; 2 bool_value bool|; 3 int_value int64|; 4 double_value double|; 5 array_value ArrayValue|; 6 kvlist_value KeyValueList|; 7 bytes_value bytes|
ArrayValue: 1 values AnyValue*
KeyValueList: 1 values KeyValue*
KeyValue: 1 key string; 2 value AnyValue
InstrumentationScope: 1 name string; 2 version string; 3 attributes KeyValue*; 4 dropped_attributes_count uint32
Resource: 1 attributes KeyValue*; 2 dropped_attributes_count uint32
TracesData: 1 resource_spans ResourceSpans*
ResourceSpans: 1 resource Resource; 2 scope_spans ScopeSpans*; 3 schema_url string
ScopeSpans: 1 scope InstrumentationScope; 2 spans Span*; 3 schema_url string
Span: 1 trace_id bytes; 2 span_id bytes; 3 trace_state string; 4 parent_span_id bytes; 5 name string; 6 kind int32; 7 start_time_unix_nano fixed64; 8 end_time_unix_nano fixed64; 9 attributes KeyValue*; 10 dropped_attributes_count uint32; 11 events Event*; 12 dropped_events_count uint32; 13 links Link*; 14 dropped_links_count uint32; 15 status Status; 16 flags fixed32
Event: 1 time_unix_nano fixed64; 2 name string; 3 attributes KeyValue*; 4 dropped_attributes_count uint32
Link: 1 trace_id bytes; 2 span_id bytes; 3 trace_state string; 4 attributes KeyValue*; 5 dropped_attributes_count uint32; 6 flags fixed32
Status: 2 message string; 3 code int32
MetricsData: 1 resource_metrics ResourceMetrics*
ResourceMetrics: 1 resource Resource; 2 scope_metrics ScopeMetrics*; 3 schema_url string
ScopeMetrics: 1 scope InstrumentationScope; 2 metrics Metric*; 3 schema_url string
Metric: 1 name string; 2 description string; 3 unit string; 5 gauge Gauge|; 7 sum Sum|; 9 histogram Histogram|; 10 exponential_histogram ExponentialHistogram|; 11 summary Summary|; 12 metadata KeyValue*
Gauge: 1 data_points NumberDataPoint*
Sum: 1 data_points NumberDataPoint*; 2 aggregation_temporality int32; 3 is_monotonic bool
Histogram: 1 data_points HistogramDataPoint*; 2 aggregation_temporality int32
ExponentialHistogram: 1 data_points ExponentialHistogramDataPoint*; 2 aggregation_temporality int32
Summary: 1 data_points SummaryDataPoint*
NumberDataPoint: 2 start_time_unix_nano fixed64; 3 time_unix_nano fixed64; 4 as_double double|; 5 exemplars Exemplar*; 6 as_int sfixed64|; 7 attributes KeyValue*; 8 flags uint32
HistogramDataPoint: 2 start_time_unix_nano fixed64; 3 time_unix_nano fixed64; 4 count fixed64; 5 sum double?; 6 bucket_counts fixed64*; 7 explicit_bounds double*; 8 exemplars Exemplar*; 9 attributes KeyValue*; 10 flags uint32; 11 min double?; 12 max double?
ExponentialHistogramDataPoint: 1 attributes KeyValue*; 2 start_time_unix_nano fixed64; 3 time_unix_nano fixed64; 4 count fixed64; 5 sum double?; 6 scale sint32; 7 zero_count fixed64; 8 positive Buckets; 9 negative Buckets; 10 flags uint32; 11 exemplars Exemplar*; 12 min double?; 13 max double?; 14 zero_threshold double
Buckets: 1 offset sint32; 2 bucket_counts uint64*
SummaryDataPoint: 2 start_time_unix_nano fixed64; 3 time_unix_nano fixed64; 4 count fixed64; 5 sum double; 6 quantile_values ValueAtQuantile*; 7 attributes KeyValue*; 8 flags uint32
ValueAtQuantile: 1 quantile double; 2 value double
Exemplar: 2 time_unix_nano fixed64; 3 as_double double|; 4 span_id bytes; 5 trace_id bytes; 6 as_int sfixed64|; 7 filtered_attributes KeyValue*
LogsData: 1 resource_logs ResourceLogs*
ResourceLogs: 1 resource Resource; 2 scope_logs ScopeLogs*; 3 schema_url string
ScopeLogs: 1 scope InstrumentationScope; 2 log_records LogRecord*; 3 schema_url string
LogRecord: 1 time_unix_nano fixed64; 2 severity_number int32; 3 severity_text string; 5 body AnyValue; 6 attributes KeyValue*; 7 dropped_attributes_count uint32; 8 flags fixed32; 9 trace_id bytes; 10 span_id bytes; 11 observed_time_unix_nano fixed64
"""
ROOT = {TRACES: "TracesData", METRICS: "MetricsData", LOGS: "LogsData"}
_PACKAGE = "otlp"


def protobuf_available() -> bool:
    try:
        import google.protobuf  # noqa: F401
    except ImportError:
        return False
    return True


def _fields(name: str) -> list[tuple[int, str, str, str]]:
    """(number, field name, type, flag) of a message in the table above."""
    for line in MESSAGES.strip().splitlines():
        if line.startswith(f"{name}: "):
            out = []
            for text in line.split(": ", 1)[1].split("; "):
                number, field_name, kind = text.split(" ")
                flag = kind[-1] if kind[-1] in "*?|" else ""
                out.append((int(number), field_name, kind.rstrip("*?|"), flag))
            return out
    raise KeyError(name)


def _struct_of(kind: T.DataType | None) -> T.StructType | None:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind if isinstance(kind, T.StructType) else None


class _Messages:
    """Descriptors of the messages that a reader needs, and in them only the fields that it wants.

    Fields left out are unknown to the parser, which steps over them by their length: a count of items parses no item.
    """

    def __init__(self) -> None:
        from google.protobuf import descriptor_pb2

        self.kinds = descriptor_pb2.FieldDescriptorProto
        self.spec = descriptor_pb2.FileDescriptorProto(name="otlp.proto", package=_PACKAGE, syntax="proto3")
        self.made: dict[tuple[str, str], str] = {}

    def add(self, name: str, wanted: T.StructType | None) -> str:
        """The generated name of message ``name`` with the fields of ``wanted``, all fields if that is None."""
        key = (name, "" if wanted is None else wanted.json())
        if key in self.made:
            return self.made[key]
        self.made[key] = own = name if wanted is None else f"{name}{len(self.made)}"
        members = None if wanted is None else {_snake(f.name): f.dataType for f in wanted.fields}
        message = self.spec.message_type.add(name=own)
        optional = []
        for number, field_name, kind, flag in _fields(name):
            if members is not None and field_name not in members:
                continue
            f = message.field.add(
                name=field_name, number=number,
                label=self.kinds.LABEL_REPEATED if flag == "*" else self.kinds.LABEL_OPTIONAL)
            if kind[0].isupper():
                inner = None if members is None else _struct_of(members[field_name])
                f.type, f.type_name = self.kinds.TYPE_MESSAGE, f".{_PACKAGE}.{self.add(kind, inner)}"
            else:
                f.type = getattr(self.kinds, f"TYPE_{kind.upper()}")
            if flag == "|":
                if not message.oneof_decl:
                    message.oneof_decl.add(name="one")
                f.oneof_index = 0
            elif flag == "?":
                optional.append(f)
        for f in optional:
            f.proto3_optional = True
            f.oneof_index = len(message.oneof_decl)
            message.oneof_decl.add(name=f"_{f.name}")
        return own


@lru_cache(maxsize=64)
def message_class(root: str, wanted: str | None = None) -> Any:
    """The class of message ``root``, once per Python worker; ``wanted``: JSON of the struct to parse, None for all of it."""
    from google.protobuf import descriptor_pool, message_factory

    messages = _Messages()
    name = messages.add(root, None if wanted is None else T.StructType.fromJson(json.loads(wanted)))
    pool = descriptor_pool.DescriptorPool()
    pool.Add(messages.spec)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"{_PACKAGE}.{name}"))


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _column(kind: T.DataType, field: Any = None, message: Any = None) -> Callable[[list], Any]:
    """Function from the decoded values of one field (None: not set) to their Arrow array of ``kind``.

    Values are read field by field over all messages of a piece, so no Python object is made per message.
    ``message``: the descriptor of the root, which is no field.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    if isinstance(kind, T.ArrayType):
        inner = _column(kind.elementType, field)

        def lists(values: list) -> Any:
            held = [() if v is None else v for v in values]
            ends = pa.array(accumulate(map(len, held), initial=0), pa.int32())
            return pa.ListArray.from_arrays(ends, inner([x for v in held for x in v]), type=arrow)

        return lists
    if isinstance(kind, T.StructType):
        return _struct_column(kind, message or field.message_type, arrow)
    if field.name.endswith(("trace_id", "span_id")):
        return lambda values: pa.array([v.hex() or None if v is not None else None for v in values], arrow)
    if field.name == "bytes_value":
        return lambda values: pa.array([None if v is None else b64encode(v).decode() for v in values], arrow)
    if field.message_type is not None:  # a message wanted as text
        plain = _plain(field.message_type, {})
        return lambda values: pa.array([None if v is None else _JSON.encode(plain(v)) for v in values], arrow)
    if isinstance(kind, T.StringType) and field.cpp_type != field.CPPTYPE_STRING:
        own = {field.CPPTYPE_INT64: pa.int64(), field.CPPTYPE_UINT64: pa.uint64()}[field.cpp_type]
        return lambda values: pa.array(values, own).cast(arrow)
    return lambda values: pa.array(values, arrow)


def _struct_column(kind: T.StructType, descriptor: Any, arrow: Any) -> Callable[[list], Any]:
    import pyarrow as pa
    from google.protobuf import message_factory

    empty = message_factory.GetMessageClass(descriptor)()
    members = []
    for f in kind.fields:
        d = descriptor.fields_by_name.get(_snake(f.name))  # None: a field of another point kind
        one = d.containing_oneof.name if d is not None and d.containing_oneof is not None else None
        members.append((None, None, None, None) if d is None else (
            d.name, one or (d.has_presence and d.name), attrgetter(d.name), _column(f.dataType, d)))
    groups = {one for _, one, _, _ in members if one in descriptor.oneofs_by_name}

    def structs(values: list) -> Any:
        absent = [v is None for v in values]
        some = [empty if v is None else v for v in values] if any(absent) else values
        which = {g: [m.WhichOneof(g) for m in some] for g in groups}
        arrays = []
        for (name, one, get, read), type_ in zip(members, arrow):
            if name is None:
                arrays.append(pa.nulls(len(some), type_.type))
            elif one in which:
                found = which[one]
                arrays.append(read([get(m) if w == name else None for m, w in zip(some, found)]) if name in found
                              else pa.nulls(len(some), type_.type))
            elif one:
                arrays.append(read([get(m) if m.HasField(name) else None for m in some]))
            else:
                arrays.append(read(list(map(get, some))))
        return pa.StructArray.from_arrays(arrays, fields=list(arrow), mask=pa.array(absent, pa.bool_()))

    return structs


_JSON = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), check_circular=False)


def _plain(descriptor: Any, made: dict[str, Any]) -> Callable[[Any], dict]:
    """Function from a message to what JSON holds for it: members set, 64-bit integers as text, bytes as base64."""
    if descriptor.full_name in made:
        return made[descriptor.full_name]
    members: dict[int, tuple[str, Callable | None]] = {}
    set_one: dict[str, tuple[str, Callable, Callable | None]] = {}
    group: str | None = None  # the oneof that holds every field

    def read(message: Any) -> dict:
        if group is not None:
            which = message.WhichOneof(group)
            if which is None:
                return {}
            name, get, one = set_one[which]
            return {name: get(message) if one is None else one(get(message))}
        out = {}
        for d, value in message.ListFields():
            name, one = members[d.number]
            out[name] = value if one is None else one(value)
        return out

    made[descriptor.full_name] = read
    for d in descriptor.fields:
        one: Callable | None = None
        if d.message_type is not None:
            one = _plain(d.message_type, made)
        elif d.type == d.TYPE_BYTES:
            one = lambda v: b64encode(v).decode()
        elif d.cpp_type in (d.CPPTYPE_INT64, d.CPPTYPE_UINT64):
            one = str
        elif d.cpp_type == d.CPPTYPE_DOUBLE:
            one = _double
        each = one if one is None or not d.is_repeated else lambda values, one=one: [one(v) for v in values]
        members[d.number], set_one[d.name] = (d.json_name, each), (d.json_name, attrgetter(d.name), each)
    if len(descriptor.oneofs) == 1 and len(descriptor.oneofs[0].fields) == len(descriptor.fields):
        group = descriptor.oneofs[0].name
    return read


def _double(value: float) -> Any:
    return value if isfinite(value) else "NaN" if isnan(value) else "Infinity" if value > 0 else "-Infinity"


def pieces(batch: Any, column: str, rows: int = 1024, size: int = 4 << 20) -> Iterator[Any]:
    """Slices of an Arrow batch whose payloads fit a bound, so that a worker's memory doesn't grow with its batches."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and (i - start == rows or held + (n or 0) > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if batch.num_rows:
        yield batch.slice(start)


def decode_documents(envelopes: DataFrame, signal: str, carry: Sequence[str] = (), item: str | None = None,
                     resources: bool = True) -> DataFrame:
    """Decode protobuf payloads; an undecodable one keeps its row with a null ``doc``.

    ``carry`` names further columns to pass through, ``payload`` among them if it is still wanted. ``item`` is the
    struct type of what is wanted of an item, None for all of it; without ``resources`` their attributes are left out. What
    is not wanted is not parsed, nor checked.
    """
    keep = [c for c in HEADER_COLUMNS if c in envelopes.columns] + ["payload_bytes", *carry]
    read_only = [] if "payload" in carry else ["payload"]
    narrow = envelopes.withColumn("payload_bytes", F.octet_length("payload")).select(*keep, *read_only)
    doc_type = T.DataType.fromDDL(document(signal, item, resources))
    wanted = doc_type.json()
    out = T.StructType([narrow.schema[c] for c in keep] + [T.StructField("doc", doc_type)])
    root = ROOT[signal]

    def decode(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from google.protobuf.message import DecodeError

        from beaconry.sources import wire

        message = message_class(root, wanted)
        plain = wire.reader(doc_type, message.DESCRIPTOR)
        any_form = _column(doc_type, message=message.DESCRIPTOR)

        def one(payload: bytes | None) -> Any:
            if not payload:
                return None
            try:
                return message.FromString(payload)
            except (DecodeError, UnicodeDecodeError):
                return None

        for batch in batches:
            for piece in pieces(batch, "payload"):
                docs = wire.documents(piece.column("payload"), plain, lambda payloads: any_form([one(p) for p in payloads]))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + [docs], names=keep + ["doc"])

    return narrow.mapInArrow(decode, out).withColumn("source_format", F.lit(PROTOBUF)).select(
        *keep, "source_format", "doc")
