"""Splitter, parsers and segmenters on literal rows."""

import json
import random
import re
from datetime import datetime

import hmac

import pytest
from pyspark.sql import functions as F

from sparklog.functions import clock, privacy, text
from sparklog.operators.bronze import check_pattern, entries_of
from sparklog.operators.gold import segment_exceptions
from sparklog.operators.parsers import get_parser, known_log_types, register
from sparklog.operators.silver import parse_entries
from sparklog.sources.config import ConfigError, SourceConfig

BRISBANE = SourceConfig("w", "windows_service", timezone="Australia/Brisbane")
WEB = SourceConfig("a", "apache_access", timezone="Australia/Brisbane")
HEADER = r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} (?:AM|PM)"


def parse(spark, entries, config, policy=None):
    rows = parse_entries(spark.createDataFrame([(i, e) for i, e in enumerate(entries)], "n int, raw_entry string"), config, policy).orderBy("n").collect()
    return [r.asDict() | {"extra": json.loads(r.extra_fields)} for r in rows]


def split(spark, raw, pattern=None):
    df = spark.createDataFrame([(raw,)], "text string").withColumn("text", text.newlines(F.col("text")))
    return [(r.header_excerpt, r.raw_entry) for r in entries_of(df, pattern or get_parser("windows_service").header_pattern).orderBy("position").collect()]


@pytest.mark.parametrize(
    "raw",
    [
        "", "no header here\nat all", "5/1/2026 4:42:10 AM Error: a\n  b\n\n5/1/2026 4:42:11 AM Info: c", "preamble\n5/1/2026 4:42:10 AM x\n\n", "5/1/2026 4:42:10 AM a\r\n  b\r\n5/2/2026 4:42:10 PM c\r\n",
        "5/1/2026 4:42:10 AM a\x0b5/1/2026 4:42:10 AM b\x855/1/2026 4:42:10 AM c 5/1/2026 4:42:10 AM d", " 5/1/2026 4:42:10 AM not a header\n12/31/2026 12:00:00 PM yes 5/1/2026 4:42:10 AM no",
    ],
)
def test_split_entries(spark, raw):
    want, head, lines = [], None, []
    for line in raw.splitlines():
        if re.match(HEADER, line):
            if head is not None:
                want.append((head.strip(), "\n".join(lines)))
            head, lines = line, [line]
        elif head is not None:
            lines.append(line)
    if head is not None:
        want.append((head.strip(), "\n".join(lines)))
    assert split(spark, raw) == want


def test_split_rendered_entries_round_trip(spark):
    r = random.Random(1)
    entries = [f"{r.randint(1, 12)}/{r.randint(1, 28)}/2026 {r.randint(1, 12)}:{r.randint(10, 59)}:{r.randint(10, 59)} AM Error: x" + "".join(f"\n{r.choice(['  k : v', '', 'text', '   at A.B()'])}" for _ in range(r.randrange(6))) for _ in range(200)]
    assert [e for _, e in split(spark, "\n".join(entries) + "\n")] == entries


def test_user_pattern(spark):
    assert [e for _, e in split(spark, "A 1\nx\nB 2\nc", r"^[A-Z] |^never")] == ["A 1\nx", "B 2\nc"]
    with pytest.raises(ConfigError):
        check_pattern(spark, "(unclosed")


def test_preamble_count(spark):
    df = spark.createDataFrame([("a\nb\n5/1/2026 4:42:10 AM x\n",), ("5/1/2026 4:42:10 AM x",), ("a\nb",), ("",)], "text string")
    assert [r[0] for r in df.select(text.preamble_lines(F.col("text"), HEADER)).collect()] == [2, 0, 2, 0]


def test_bytes_to_text(spark):
    raw = b"ok \xff\xfe bad \xe2\x82 end"
    df = spark.createDataFrame([(bytearray(raw),)], "c binary")
    assert df.select(text.decode_utf8(F.col("c"))).first()[0] == raw.decode("utf-8", errors="replace")


ERROR = """5/1/2026 4:42:10 AM Error: Acme.Jobs.Sync.Task Job failed: code 7
   Time Taken : 00:01:02
   Exception Type : Acme.DbException
   Message    : outer said
   Stack Trace :
Acme.DbException: outer said ---> Acme.NetException: inner: why
   at Acme.Run() in Run.cs:line 1
   --- End of inner exception stack trace ---
Acme.DbException: outer said
   User       : svc_1
      more of it
   Status : Failed: twice"""


def test_windows_error(spark):
    (r,) = parse(spark, [ERROR], BRISBANE)
    assert (r["severity"], r["severity_raw"], r["logger"], r["message"]) == ("ERROR", "Error", "Acme.Jobs.Sync.Task", "Job failed: code 7")
    assert r["event_time_local"] == datetime(2026, 5, 1, 4, 42, 10) and r["event_time_utc"].replace(tzinfo=None) == datetime(2026, 4, 30, 18, 42, 10)
    assert r["is_exception"] and r["exception_text"].startswith("Exception Type : Acme.DbException\n   Message    : outer said") and "User" not in r["exception_text"]
    assert r["extra"] == {"Time Taken": "00:01:02", "User": "svc_1\nmore of it", "Status": "Failed: twice"}


@pytest.mark.parametrize(
    "head,severity,logger,message",
    [
        ("5/1/2026 4:42:10 AM Information: plain words", "INFO", None, "plain words"), ("5/1/2026 4:42:10 AM Critical: A.b", "FATAL", "A.b", None), ("5/1/2026 4:42:10 AM error: x", "UNKNOWN", None, "x"),
        ("nothing known", "UNKNOWN", None, "nothing known"), ("   ", "UNKNOWN", None, None), ("5/1/2026 4:42:10 AM Verbose:", "DEBUG", None, None), ("5/1/2026 4:42:10 AM Warning: ns.x:y", "WARN", "ns.x", ":y"),
    ],
)
def test_windows_heads(spark, head, severity, logger, message):
    (r,) = parse(spark, [head], BRISBANE)
    assert (r["severity"], r["logger"], r["message"], r["is_exception"], r["extra"]) == (severity, logger, message, False, {})


def test_windows_times(spark):
    got = parse(spark, ["13/4/2026 1:00:00 PM Error: day first", "4/13/2026 1:00:00 PM Error: month first", "13/13/2026 1:00:00 PM Error: neither", None, ""], BRISBANE)
    assert [r["event_time_local"] for r in got] == [datetime(2026, 4, 13, 13), datetime(2026, 4, 13, 13), None, None, None]
    sydney = SourceConfig("w", "windows_service", timezone="Australia/Sydney")
    got = parse(spark, ["10/4/2026 2:30:00 AM Error: gap", "4/5/2026 2:30:00 AM Error: overlap"], sydney)
    assert [r["event_time_utc"].replace(tzinfo=None) for r in got] == [datetime(2026, 10, 3, 16, 30), datetime(2026, 4, 4, 15, 30)]


def plain_body(lines, ends):
    """The body's rules, line by line."""
    trailing = set(get_module().TRAILING_KEYS)
    extra, block, inside, last = {}, [], False, None
    for line in lines:
        m = re.match(r"^\s{2,}([^:]+?)\s*:\s*(.*)$", line)
        key = m[1].strip() if m else None
        if inside and not (m and (key.lower() in trailing or key in ends)):
            block.append(line.rstrip())
        elif not inside and key in ("Exception", "Exception Type", "Stack Trace"):
            inside, last = True, key
            block.append(line.rstrip())
        elif m:
            inside, last = False, key
            extra[key] = m[2].strip()
        elif last is not None and last in extra:
            extra[last] += "\n" + line.strip()
    return extra, "\n".join(block).strip() if block else None


def get_module():
    from sparklog.operators.parsers import windows_service

    return windows_service


def test_windows_body_against_plain_rules(spark):
    r = random.Random(4)
    pool = ["   User : a", "   user: b:c", "  Exception : x", "   Stack Trace :", "   Exception Type : T", "\tStatus\t:  ok ", "   Other Key : v", "   Other Key : w", " one space : no", "continued", "", "   at X.Y()", "   Detail : d", "   Token : t", "     : odd", "   é : ü"]
    bodies = [[r.choice(pool) for _ in range(r.randrange(12))] for _ in range(300)]
    entries = ["\n".join(["5/1/2026 4:42:10 AM Error: x", *b]) for b in bodies]
    for ends, policy in (((), None), (("Token",), privacy.Policy({"Token": "redact"}))):
        for b, got in zip(entries, parse(spark, entries, BRISBANE, policy)):
            extra, block = plain_body(b.splitlines()[1:], ends)
            extra = {k: "[REDACTED]" if k in ends else v for k, v in extra.items()}
            assert got["extra"] == extra and got["exception_text"] == block and got["is_exception"] == (block is not None), b


def segs(spark, kind, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, exception_text string")
    out = [[] for _ in texts]
    for r in segment_exceptions(df, kind).orderBy("n", "segment_index").collect():
        out[r.n].append((r.segment_index, r.segment_type, r.segment_text))
    return out


def test_segments(spark):
    got = segs(spark, "windows_service", [ERROR, "Exception: bare", "Foo.Bar: no suffix", "A.Error: x\nA.Error: x\nB.Exception : y ---> C.Error:z", "", None])
    assert got[0] == [(0, "signature", "Acme.DbException: outer said"), (1, "inner_signature", "Acme.NetException: inner: why")]
    assert got[1] == got[2] == got[4] == got[5] == []
    assert [t for _, _, t in got[3]] == ["A.Error: x", "B.Exception: y", "C.Error: z"]
    assert segs(spark, "apache_access", [" HTTP 500 GET /x ", "", None]) == [[(0, "signature", "HTTP 500 GET /x")], [], []]


def test_apache(spark):
    rows = [
        '10.1.2.3 - - [03/May/2026:14:23:01 +1000] "GET /api/orders HTTP/1.1" 500 0 "-" "curl"', '10.1.2.3 - bob [03/May/2026:14:23:01 +1000] "GET / HTTP/1.1" 200 55', 'h - - [bad] "PURGE" 404 - "r" "u" trailing',
        '::1 - - [03/May/2026:14:23:01 +1000] "" 301 1', 'h - - [03/May/2026:14:23:01 +1000] "a b c d" 600 1', 'h - - [03/May/2026:14:23:01 +1000] "GET /x" 503 1', "free " * 200, None,
    ]
    got = parse(spark, rows, WEB)
    assert [r["severity"] for r in got] == ["ERROR", "INFO", "WARN", "INFO", "ERROR", "ERROR", "UNKNOWN", "UNKNOWN"]
    assert got[0]["message"] == "GET /api/orders -> 500" and got[0]["exception_text"] == "HTTP 500 GET /api/orders"
    assert got[0]["event_time_utc"].replace(tzinfo=None) == datetime(2026, 5, 3, 4, 23, 1) and got[0]["event_time_local"] == datetime(2026, 5, 3, 14, 23, 1)
    assert got[0]["extra"] == {"client_ip": "10.1.2.3", "remote_user": "-", "method": "GET", "path": "/api/orders", "protocol": "HTTP/1.1", "status": 500, "bytes": "0", "referer": "-", "user_agent": "curl"}
    assert got[1]["extra"]["referer"] is None and got[1]["extra"]["user_agent"] is None and not got[1]["is_exception"]
    assert got[2]["event_time_utc"] is None and got[2]["extra"]["bytes"] is None and got[2]["message"] == "PURGE  -> 404" and got[2]["extra"]["user_agent"] == "u"
    assert (got[3]["message"], got[4]["message"], got[4]["extra"]["path"], got[4]["exception_text"]) == ("-> 301", "a b c d -> 600", "a b c d", "HTTP 600  a b c d")
    assert got[5]["message"] == "GET /x -> 503" and len(got[6]["message"]) == 500 and got[6]["extra"] == {"unparsed": ("free " * 200).strip()} and got[6]["logger"] == "apache.access"


def test_registry():
    assert known_log_types() == ["apache_access", "windows_service"]
    with pytest.raises(KeyError, match="apache_access, windows_service"):
        get_parser("nope")
    with pytest.raises(ValueError):
        register(type("Empty", (), {"log_type": ""}))
    with pytest.raises(ValueError):
        register(type("Twice", (), {"log_type": "apache_access"}))


def test_policy(spark, monkeypatch):
    monkeypatch.delenv(privacy.KEY_VARIABLE, raising=False)
    for bad in ({"User": "hmac"}, {"User": "shred"}, {"User": "encrypt"}):
        with pytest.raises(privacy.PolicyError):
            privacy.Policy(bad)
    monkeypatch.setenv(privacy.KEY_VARIABLE, "very secret key")
    fields = {"User": "svc", "Country": None, "Account Id": "ACC", "Other": "keep"}
    plain = fields | {"User": hmac.new(b"very secret key", b"svc", "sha256").hexdigest(), "Account Id": "[REDACTED]"}
    policy = privacy.Policy({"User": "hmac", "Country": "redact", "Account Id": "redact"})
    df = spark.createDataFrame([(fields,), ({},)], "f map<string,string>").select(policy.fields(F.col("f")).alias("f"))
    assert [r.f for r in df.collect()] == [plain, {}]
    shown = df._jdf.queryExecution().toString()
    assert "very secret" not in shown and "".join(f"{b:02x}" for b in b"very secret key") not in shown.lower()
    value = spark.createDataFrame([("svc",), ("é",), (None,)], "v string")
    key = b"k" * 80
    a = [r[0] for r in value.select(privacy.hmac_expression(F.col("v"), key)).collect()]
    assert a == [r[0] for r in value.select(privacy.hmac_udf(key)("v")).collect()] and a[2] is None


def test_clock():
    assert clock.parse_bound("2026-05-01").isoformat() == "2026-05-01T00:00:00+00:00" and clock.parse_bound(None) is None
    with pytest.raises(ValueError):
        clock.check_zone("Mars/Base")
