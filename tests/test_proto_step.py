"""The protobuf step: only kept payloads are encoded, and they are read in pieces of a bounded size, to what the messages hold."""

import json

import pyarrow as pa
from google.protobuf.json_format import MessageToDict
from google.protobuf.message import DecodeError
from pyspark.sql import types as T

from beaconry.constants import LOGS, METRICS, TRACES
from beaconry.plans import fixtures as fx
from beaconry.plans.proto_columns import messages
from beaconry.schemas import WHOLE_ITEM, document
from beaconry.sources import proto, wire

SF = "/root/testdata/sf0.001"


def test_only_kept_batches_are_encoded(spark):
    plan = fx.mixed(spark, SF, LOGS)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "MapInArrow" in line)
    assert not any("Filter (" in line for line in plan[at - 2:at])


def test_a_piece_is_bounded():
    batch = pa.record_batch({"payload": pa.array([b"x" * n for n in (3, 3, 9, 1, 1, 1)] + [None, b""])})
    sizes = [p.column(0).to_pylist() for p in proto.pieces(batch, "payload", 3, 6)]
    assert [len(s) for s in sizes] == [2, 1, 3, 2] and sum(sizes, []) == batch.column(0).to_pylist()
    assert list(proto.pieces(batch.slice(0, 0), "payload")) == []


def test_columns_hold_what_messages_hold(spark):
    kind = T.DataType.fromDDL(document(LOGS, WHOLE_ITEM[LOGS]))
    cls = proto.message_class(proto.ROOT[LOGS], kind.json())
    values = [{"stringValue": ""}, {"boolValue": False}, {"intValue": -(2 ** 63)}, {"doubleValue": 0.0}, {}, None,
              {"arrayValue": {"values": [{"doubleValue": float("nan")}, {"doubleValue": float("-inf")}, {}, {"intValue": 7}]}},
              {"kvlistValue": {"values": [{"key": "", "value": {"bytesValue": "AP8="}}, {"key": "é\"", "value": {"arrayValue": {}}}]}},
              {"bytesValue": ""}]
    text = {"resourceLogs": [{}, {"scopeLogs": [{"scope": {"name": "s"}, "logRecords": [
        {"timeUnixNano": 2 ** 64 - 1, "traceId": "", "attributes": [
            {"key": str(i)} | ({} if v is None else {"value": v}) for i, v in enumerate(values)]}, {"spanId": "00ff"}]}]}]}
    full = proto.message_class(proto.ROOT[LOGS])
    message = full(**fx._members(full.DESCRIPTOR, {})(text))
    docs = proto._column(kind, message=cls.DESCRIPTOR)([None, cls.FromString(message.SerializeToString()), cls()]).to_pylist()
    assert docs[0] is None and docs[2]["resourceLogs"] == []
    empty, resource = docs[1]["resourceLogs"]
    assert empty == {"resource": None, "scopeLogs": []}
    first, second = resource["scopeLogs"][0]["logRecords"]
    assert first["timeUnixNano"] == str(2 ** 64 - 1) and first["traceId"] is None and first["severityNumber"] == 0
    assert second["spanId"] == "00ff" and second["attributes"] == [] and second["body"] is None
    got = [a["value"] for a in first["attributes"]]
    assert got[5] is None and set(got[4].values()) == {None}
    assert [got[0]["stringValue"], got[1]["boolValue"], got[2]["intValue"], got[3]["doubleValue"], got[8]["bytesValue"]] == [
        "", False, str(-(2 ** 63)), 0.0, ""]
    whole = message.resource_logs[1].scope_logs[0].log_records[0].attributes
    for i, name in ((6, "arrayValue"), (7, "kvlistValue")):
        assert got[i][name] == json.dumps(MessageToDict(whole[i].value)[name], separators=(",", ":"), ensure_ascii=False)


def test_columns_are_encoded_as_the_runtime_does(spark):
    for signal in (LOGS, TRACES, METRICS):
        text = fx.as_proto(fx.envelopes(spark, SF, signal), signal)
        columns = fx._encoded(fx._documents(spark, SF, signal), signal)
        assert columns.columns == text.columns
        assert text.exceptAll(columns).isEmpty() and columns.exceptAll(text).isEmpty()


def test_values_at_their_borders_are_encoded():
    value = pa.struct([("doubleValue", pa.float64()), ("stringValue", pa.string()), ("boolValue", pa.bool_()), ("intValue", pa.string())])
    record = pa.struct([("spanId", pa.string()), ("severityNumber", pa.int32()), ("timeUnixNano", pa.string()),
                        ("severityText", pa.string()), ("body", value), ("attributes", pa.list_(pa.struct([("key", pa.string()), ("value", value)])))])
    values = [{"stringValue": ""}, {"stringValue": "é" * 70}, {"boolValue": False}, {"intValue": str(-(2 ** 63))}, {"intValue": "127"},
              {"intValue": "BARE:128"}, {"doubleValue": 0.0}, {"doubleValue": -0.5}, None]
    rows = [
        {"timeUnixNano": str(2 ** 64 - 1), "severityNumber": -1, "spanId": "00ff", "severityText": "x" * 20_000,
         "attributes": [{"key": str(i), "value": v} for i, v in enumerate(values)]},
        {"severityNumber": 0, "severityText": "", "attributes": []}, {"body": {"intValue": "0"}}]
    cls = proto.message_class("LogRecord")
    members = fx._members(cls.DESCRIPTOR, {})
    got = messages(record, cls.DESCRIPTOR)(pa.array([rows[0], *rows], record).slice(1)).to_pylist()
    for body, row in zip(got, rows, strict=True):
        plain = json.loads(json.dumps(row).replace("BARE:", ""), object_pairs_hook=lambda kv: {k: v for k, v in kv if v is not None})
        assert body == cls(**members(plain)).SerializeToString()


def test_metrics_are_dealt_over_tasks_whatever_their_size(spark):
    tree = fx.document_tree(spark, SF, METRICS)[0]
    assert "REPARTITION_BY_NUM" in tree._jdf.queryExecution().executedPlan().toString()


def _readers(signal, item):
    kind = T.DataType.fromDDL(document(signal, item))
    cls = proto.message_class(proto.ROOT[signal], kind.json())
    package, left = proto._column(kind, message=cls.DESCRIPTOR), []

    def one(payload):
        try:
            return cls.FromString(payload) if payload else None
        except (DecodeError, UnicodeDecodeError):
            return None

    def by_package(payloads):
        left.extend(payloads)
        return package([one(p) for p in payloads])

    read = wire.reader(kind, cls.DESCRIPTOR)
    return lambda payloads: wire.documents(pa.array([b"-", *payloads], pa.binary()).slice(1), read, by_package), by_package, left


def test_usual_payloads_are_read_without_the_package(spark):
    for signal in (LOGS, TRACES, METRICS):
        payloads = [r.payload for r in fx.as_proto(fx.nested(spark, SF, signal), signal).select("payload").collect()]
        payloads += [r.payload for r in fx.proto_envelopes(spark, SF, signal).select("payload").collect()]
        for item in (WHOLE_ITEM[signal], None):
            fast, by_package, left = _readers(signal, item)
            got = fast(payloads)
            assert left == [] and repr(got.to_pylist()) == repr(by_package(payloads).to_pylist())


def test_unusual_payloads_hold_what_the_package_reads(spark):
    fast, by_package, left = _readers(LOGS, WHOLE_ITEM[LOGS])
    usual = fx.proto_envelopes(spark, SF, LOGS).select("payload").first().payload

    def logs(record):  # a document of one record; all lengths below 16,384
        for tag in (b"\x12", b"\x12", b"\x0a"):
            n = len(record)
            record = tag + (bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])) + record
        return record

    odd = [
        usual[:-1], usual + usual[:9], b"{ not protobuf", b"\x00", b"\x0b\x0c", b"\x80" * 12,  # broken off, group, endless number
        logs(b"\x10\x01\x10\x02"), logs(b"\x15\x01\x02\x03\x04"),  # a number twice, in another form
        logs(b"\x2a\x02\x10\x01\x2a\x03\x0a\x01a"), logs(b"\x2a\x05\x0a\x01a\x10\x01"),  # a body twice, two kinds in it
        logs(b"\x1a\x02\xff\xfe"), logs(b"\x32\x00" * 300),  # not UTF-8, very many fields
        logs(b"\x2a\x84\x01\x2a\x81\x01" + b"\x0a\x7f\x0a\x7d" + b"x" * 125)]  # a long list
    usual_too = [
        logs(b"\x10\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01"), logs(b"\x10\xff\xff\xff\xff\x1f"), logs(b"\xa0\x06\x01\xaa\x06\x01a"),
        logs(b"\x2a\x02\x10\x00"), logs(b"\x2a\x09\x21" + b"\x00" * 6 + b"\xf8\x7f"), logs(b""), b"\xfa\x7f\x00"]
    rows = [None, usual, *odd, b"", *usual_too, usual]
    got = fast(rows)
    assert sorted(left) == sorted(odd)
    got.validate(full=True)
    assert repr(got.to_pylist()) == repr(by_package(rows).to_pylist()) and fast([None]).to_pylist() == [None] and len(fast([])) == 0
