from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logspark.functions import parse, render
from logspark.functions.labels import facility_label, severity_code, severity_label
from logspark.plans.messages import lines_of, messages
from logspark.schema import RAW_LINE
from tests.conftest import SF_DIR

RA = datetime(2021, 9, 8, 7, 6, 5)
#: The sample structured data of the standard, and the line it stands in.
SDATA = '[exampleSDID@32473 iut="3" eventSource="Application" eventID="1011"]'
STANDARD = f"<165>1 2003-10-11T22:14:15.003Z mymachine.example.com evntslog - ID47 {SDATA} An application event log entry..."
H = "<46>1 2022-03-04T05:06:07Z node-7 svc 4711 M1 "
D = {"version": 0, "hostname": "", "app_name": "", "proc_id": "", "msg_id": "", "structured_data": "", "timestamp": RA}
FALLBACK = {**D, "severity": 5, "facility": 1}
NEW = {**D, "version": 1}
CASES = [
    (STANDARD, {"facility": 20, "severity": 5, "severity_label": "Notice", "facility_label": "local4", "version": 1, "hostname": "mymachine.example.com", "app_name": "evntslog", "proc_id": "", "msg_id": "ID47", "structured_data": SDATA, "message": "An application event log entry...", "timestamp": datetime(2003, 10, 11, 22, 14, 15, 3000)}),
    ('<82>1 2022-03-04T05:06:07Z pump ctl 9 T-1 [flow@7 rate="1.5"][valve@7 open="no" id="b"] pressure low', {"facility": 10, "severity": 2, "proc_id": "9", "structured_data": '[flow@7 rate="1.5"][valve@7 open="no" id="b"]', "message": "pressure low"}),
    ("<29>1 - - - - - - nothing but words", {**NEW, "facility": 3, "severity": 5, "message": "nothing but words"}),
    (H + "-", {"version": 1, "structured_data": "", "message": ""}),
    (H + "- \ufeffmarked text", {"message": "marked text"}),
    ("<46>1 2022-03-04T05:06:07.987654321+02:00 node-7 svc - - - x", {"timestamp": datetime(2022, 3, 4, 3, 6, 7, 987654)}),
    ("<46>1 2022-03-04T05:06:07,25Z node-7 svc - - - x", {"timestamp": datetime(2022, 3, 4, 5, 6, 7, 250000)}),
    ("<80>Jul 20 02:56:15 eagle guidance[1202]: program alarm", {"version": 0, "facility": 10, "severity": 0, "hostname": "eagle", "app_name": "guidance", "proc_id": "1202", "message": "program alarm", "timestamp": datetime(2021, 7, 20, 2, 56, 15)}),
    ("<15>Jul 20 02:56:15 eagle radar: locked on", {"app_name": "radar", "proc_id": "", "message": "locked on"}),
    ("<15>Dec  5 02:56:15 eagle radar: x", {"hostname": "eagle", "timestamp": datetime(2021, 12, 5, 2, 56, 15)}),
    ("<15>Jul 20 02:56:15 eagle", {"hostname": "eagle", "message": ""}),
    ("<102>Feb  3 04:05:06 mirror rsyncd: sent 12 files, 0 errors", {"severity": 6, "facility": 12, "hostname": "mirror", "app_name": "rsyncd", "message": "sent 12 files, 0 errors"}),
    ("", {**FALLBACK, "message": ""}),
    *[(x, {**FALLBACK, "message": x}) for x in ("plain words, no number", "<x7>y", "<200>y", "<-7>y", "\x05\x06\x07", "<29 never closed", "<98765>y", "<29.5>y", "< 29 >y", "<256>y", "<+123>y")],
    ("<15>Jul 20 02:56:15 eagle radar: x\n\n\0\r", {"raw_message": "<15>Jul 20 02:56:15 eagle radar: x", "message": "x"}),
    (H + "- " + "long " * 30_000, {"message": "long " * 30_000}),
    (H + "- quotes \"'` angles <> slashes /\\ and\ttabs & more", {"message": "quotes \"'` angles <> slashes /\\ and\ttabs & more"}),
    *[(f"<{p}>1 - - - - - - y", {"facility": p // 8, "severity": p % 8}) for p in (0, 5, 8, 77, 190, 191)],
    ("<29>", {**D, "severity": 5, "facility": 3, "message": ""}),
    (H + "[a][b", {"structured_data": "", "message": "[a][b"}),
    (H + "[a[b]c] z", {"structured_data": "[a[b]c]", "message": "z"}),
    (H + '[a[b "]"]c] z', {"structured_data": '[a[b "]"]c]', "message": "z"}),
    (H + r'[q v="say \"]\" twice"] z', {"structured_data": r'[q v="say \"]\" twice"]', "message": "z"}),
    (H + "[a]xhello", {"structured_data": "[a]", "message": "hello"}),
    (H + "-x", {"structured_data": "", "message": ""}),
    ("<29>1 not enough of it", {"version": 0, "message": "1 not enough of it"}),
    ("<29>3 - - - - - - m", {"version": 1, "message": "m"}),
    ("<+29>y", {"facility": 3, "severity": 5, "message": "y"}),
    ("<029>y", {"facility": 3, "severity": 5, "message": "y"}),
    ("<15>Dec 5 02:56:15 h a: m", {"hostname": "h", "app_name": "a", "message": "m", "timestamp": datetime(2021, 12, 5, 2, 56, 15)}),
    ("<15>Feb 29 10:00:00 h a: m", {"timestamp": datetime(2021, 3, 1, 10, 0, 0)}),
    ("<15>Jun 31 10:00:00 h a: m", {"timestamp": RA, "hostname": ""}),
    ("<15>[12]: m", {"proc_id": "12", "app_name": "", "message": "[12]: m"}),
    ("<15>two words[9]: m", {"app_name": "two words", "proc_id": "9", "message": "m"}),
    ("<46>1 2022-03-04 h a p m - x", {"timestamp": RA, "message": "x"}),
    ("<15>" + "t" * 49 + ": tag too long", {"app_name": "", "message": "t" * 49 + ": tag too long"}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, raw, "10.0.0.1", "UDP", RA) for i, (raw, _) in enumerate(CASES)]
    return {r.seq: r for r in parse.parse(spark.createDataFrame(rows, RAW_LINE)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_line(parsed, i):
    got = parsed[i].asDict()
    assert {k: got[k] for k in CASES[i][1]} == CASES[i][1]


def test_null_line_and_replayed_id(spark):
    rows = [(1, None, "h", "TCP", RA), (2, "<13>x", "h", "TCP", RA)]
    first = parse.parse(spark.createDataFrame(rows, RAW_LINE)).orderBy("seq").collect()
    again = parse.parse(spark.createDataFrame(rows, RAW_LINE)).orderBy("seq").collect()
    assert [r.id for r in first] == [r.id for r in again] and first[0].message == ""


def test_labels(spark):
    d = spark.range(1).select(severity_label(F.lit(99)), facility_label(F.lit(99)), severity_label(F.lit(0)), facility_label(F.lit(23)), severity_code(F.lit("Debug")), severity_code(F.lit("x")))
    assert tuple(d.first()) == ("Unknown", "unknown", "Emergency", "local7", 7, -1)


def test_round_trip_of_rfc5424(spark):
    m = messages(spark, SF_DIR).where("version = 1")
    back = parse.parse(lines_of(m))
    assert back.exceptAll(m).count() == 0


def test_no_python_in_parse(spark):
    plan = parse.parse(lines_of(messages(spark, SF_DIR)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rfc3164_day_is_padded(spark):
    line = messages(spark, SF_DIR).where("version = 0 and hostname <> ''").select(render.rfc3164().alias("x")).first().x
    assert line.split(">")[1].startswith("Jan  1 ") or line.split(">")[1][4] in " 123"


YEARS = [
    ("Dec 31 23:59:58", datetime(2022, 1, 1, 0, 0, 1), datetime(2021, 12, 31, 23, 59, 58)),
    ("Dec  5 02:56:15", datetime(2022, 1, 31, 12), datetime(2021, 12, 5, 2, 56, 15)),
    ("Dec 5 02:56:15", datetime(2022, 1, 31, 12), datetime(2021, 12, 5, 2, 56, 15)),
    ("Dec 31 23:59:58", datetime(2022, 2, 1), datetime(2022, 12, 31, 23, 59, 58)),
    ("Nov 30 23:59:58", datetime(2022, 1, 1), datetime(2022, 11, 30, 23, 59, 58)),
    ("Jan  1 00:00:01", datetime(2021, 12, 31, 23, 59, 59), datetime(2022, 1, 1, 0, 0, 1)),
    ("Jan  2 00:00:01", datetime(2021, 12, 31, 23, 59, 59), datetime(2021, 1, 2, 0, 0, 1)),
    ("Jan  1 00:00:01", datetime(2021, 12, 30, 23, 59, 59), datetime(2021, 1, 1, 0, 0, 1)),
    ("Jan  1 00:00:01", datetime(2022, 1, 1, 0, 0, 1), datetime(2022, 1, 1, 0, 0, 1)),
    ("Dec 31 23:59:58", datetime(2021, 12, 31, 23, 59, 59), datetime(2021, 12, 31, 23, 59, 58)),
    ("Feb 29 10:00:00", datetime(2024, 3, 1), datetime(2024, 2, 29, 10)),
]


def test_year_of_rfc3164(spark):
    rows = [(i, f"<15>{stamp} eagle radar: x", "h", "UDP", received) for i, (stamp, received, _) in enumerate(YEARS)]
    found = {r.seq: (r.timestamp, r.hostname, r.app_name, r.message) for r in parse.parse(spark.createDataFrame(rows, RAW_LINE)).collect()}
    assert found == {i: (want, "eagle", "radar", "x") for i, (_, _, want) in enumerate(YEARS)}
