"""Names and types of analytics requests and error reports, held against a plain Python reading."""

import json
import re
from datetime import datetime

import pytest

from beaconry.constants import ANALYTICS, ERRORS
from beaconry.plans.process import process_analytics
from beaconry.sources.requests import EVENT_TEXTS, REPORT_TEXTS, classify_rejects, read_analytics, read_error_reports

JSON = "application/json"
BAD, NONE, INVALID = "Invalid JSON format", "No events provided", "Invalid request"


def event(**more):
    return {"eventName": "e", **more}


def request(*events, **more):
    return json.dumps({"events": list(events), **more})


ANALYTICS_CASES = [
    (request(event()), None), (request(event(eventName=None)), None), (request({"EVENTNAME": "x", "UserID": "u"}), None),
    (json.dumps({"EVENTS": [event()], "SourceService": "s"}), None), (request(event(unknown=[1, {"a": 2}])), None),
    (request(event(properties={})), None), (request(event(properties=None, timestamp=None)), None),
    (request(event(timestamp="2026-02-03T04:05:06.1234567+01:00")), None), (request(event(timestamp="2026-02-03")), None),
    ('{"events":[{"eventName":"a"}],"events":[{"eventName":"b"}]}', None),
    ("", BAD), ("null", NONE), (" null\n", NONE), ("[]", BAD), ("5", BAD), ('"x"', BAD), ("{}", NONE), ('{"events":{}}', BAD),
    ('{"events":null,"sourceService":7}', BAD), ("{'events':[]}", BAD), ('{"events":[],"x":NaN}', BAD), (request(), NONE),
    (request({}), BAD), (request(event(), {"name": "n"}), BAD), (request(None), BAD), (request(event(), 3), BAD),
    (request(event(timestamp="2026-02-30")), BAD), (request(event(timestamp="02/03/2026")), BAD),
    (request(event(timestamp=" 2026-02-03")), BAD), (request(event(timestamp={"at": 1})), BAD),
    (request(event(properties="p")), BAD), (request(event(), event(), event(nodeId=1.5)), BAD),
    ('{"events":[{"eventName":"a","EventName":1}]}', BAD), ('{"sourceNodeId":1,"SourceNodeId":"n","events":[]}', BAD),
    *[(request(event(**{n: v})), BAD) for n in EVENT_TEXTS for v in (True, 0, [], {})],
]
REPORT_CASES = [
    ("{}", None), ('{"MESSAGE":"m","Severity":0}', None), ('{"tags":{"a":null},"extra":{"b":[1]}}', None),
    ('{"severity":7}', None), ('{"severity":null,"tags":null,"extra":null}', None),
    ("null", INVALID), ("", BAD), ("[null]", BAD), ('{"severity":"2"}', BAD), ('{"severity":2.5}', BAD),
    ('{"severity":4294967296}', BAD), ('{"tags":{"a":1}}', BAD), ('{"tags":"t"}', BAD), ('{"extra":[1]}', BAD),
    *[(json.dumps({n: v}), BAD) for n in REPORT_TEXTS for v in (False, 3, [], {})],
]


@pytest.mark.parametrize("signal, cases", [(ANALYTICS, ANALYTICS_CASES), (ERRORS, REPORT_CASES)])
def test_one_wrong_field_refuses_the_request(envelope, signal, cases):
    env = envelope(*[(str(i), signal, text, JSON) for i, (text, _) in enumerate(cases)], ("null", signal, None, JSON))
    want = {str(i): reason for i, (_, reason) in enumerate(cases) if reason} | {"null": BAD}
    assert {r.batch_id: r.reason for r in classify_rejects(env).collect()} == want
    read = read_analytics if signal == ANALYTICS else read_error_reports
    rows, rejects = read(env)
    assert {r.batch_id for r in rows.collect()} == {str(i) for i, (_, reason) in enumerate(cases) if not reason}
    assert rejects.count() == len(want)


def test_names_match_in_any_case(envelope):
    text = json.dumps({"SOURCESERVICE": "shop", "Events": [
        {"eventname": "a", "TimeStamp": "2026-02-03T04:05:06.1234567Z", "PROPERTIES": {"Key": 1, "key": 2}, "userid": "u"},
        {"EventName": "b", "eventName": "c", "tenantID": "t"}]})
    env = envelope(("x", ANALYTICS, text, JSON))
    a, b = sorted(read_analytics(env)[0].collect(), key=lambda r: r.pos)
    assert (a.event_name, a.user_id, a.source_name, sorted(a.properties)) == ("a", "u", "shop", ["Key", "key"])
    assert a.ts == datetime(2026, 2, 3, 4, 5, 6, 123456)
    assert (b.event_name, b.tenant_id, b.ts) == ("c", "t", b.received_at)
    stats = process_analytics(env).stats.collect()
    assert [(s.item_count, s.batch_tenant, s.source_name) for s in stats] == [(2, "t", "shop")]


def test_long_requests_stay_whole(envelope):
    events = [event(userId=f"u{i}", properties={f"p{j}": "x" * 50 for j in range(30)}) for i in range(3000)]
    rows = read_analytics(envelope(("x", ANALYTICS, request(*events), JSON)))[0]
    got = rows.selectExpr("pos", "user_id", "size(properties) AS n").collect()
    assert {(r.pos, r.user_id, r.n) for r in got} == {(i, f"u{i}", 30) for i in range(3000)}


def test_a_request_is_parsed_once(envelope):
    env = envelope(("x", ANALYTICS, request(event()), JSON), ("y", ERRORS, "{}", JSON))
    plans = [read_analytics(env)[0], read_error_reports(env)[0], process_analytics(env).stats]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"from_json\(", plan)) == 1 and "Exchange" not in plan


def test_no_requests(envelope, spark):
    empty = envelope(("x", ANALYTICS, "{}", JSON)).limit(0)
    assert read_analytics(empty)[0].collect() == read_error_reports(empty)[0].collect() == classify_rejects(empty).collect() == []
