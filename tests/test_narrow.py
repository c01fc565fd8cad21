"""Decoders that parse only what the wanted columns need yield what the whole decoders do."""

import os

import pytest

from beaconry.constants import LOGS, METRICS, TRACES
from beaconry.plans import fixtures as fx
from beaconry.sources import otlp

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

CASES = [
    (TRACES, otlp.decode_spans, otlp.decode_spans_proto, ["span_id", "start_ts", "status_code"], ["links", "events", "doubleValue:double>>>>>"]),
    (TRACES, otlp.decode_spans, otlp.decode_spans_proto, [], ["traceId"]),
    (LOGS, otlp.decode_logs, otlp.decode_logs_proto, ["ts", "severity_number", "body"], ["traceId", "observedTimeUnixNano"]),
    (METRICS, otlp.decode_points, otlp.decode_points_proto, ["as_int", "sum", "positive_counts"], ["exemplars", "quantileValues", "negative"]),
]


@pytest.mark.parametrize("signal, read, read_proto, columns, absent", CASES)
def test_narrow_equals_whole(spark, signal, read, read_proto, columns, absent):
    for decode, env in ((read, fx.envelopes(spark, SF, signal)), (read_proto, fx.proto_envelopes(spark, SF, signal))):
        keep = ["batch_id", "service_name", "resource_pos", "item_pos", *(["point_pos", "ts"] if signal == METRICS else []), *columns]
        narrow, whole = decode(env, columns), decode(env)
        assert set(columns) <= set(narrow.columns) < set(whole.columns)
        assert sorted(map(str, narrow.select(*keep).collect())) == sorted(map(str, whole.select(*keep).collect()))
    schema = read(fx.envelopes(spark, SF, signal), columns)._jdf.queryExecution().optimizedPlan().toString()
    parsed = schema[schema.index("from_json"):] if "from_json" in schema else schema
    item = parsed.split("StructField(scope,")[1].split("StructField(resource,")[0] if "StructField(scope," in parsed else parsed
    assert not [a for a in absent if f"StructField({a}," in item]
