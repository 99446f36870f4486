"""Grammar, patterns, time and line functions: tables of cases, no data."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions import filters, globs, lines, regex, timeexpr
from spindrift.operators.search import Selector, clamp

LINE = '{"svc":"checkout","sev":"Warn","took":1731,"note":"Basket 77 not found, retry in 3 min","ok":false}'
CASES = {
    "basket": True,
    "RETRY Found": True,
    "basket missing": False,
    "!basket": False,
    "!missing retry": True,
    '"not found, retry"': True,
    '"found not"': False,
    "sev=warn": True,
    "sev=warning": False,
    "!sev=error svc=CHECKOUT": True,
    "took=1731": True,
    "took=173": False,
    "ok=false": True,
    "gone=": False,
    "!gone=1": True,
    r"/basket \d{2} not/": True,
    r"/retry in \d+ h/": False,
    "/[broken": True,
    "/svc/checkout": True,
    "/svc/basket2": False,
    "": True,
    '""': True,
    "!": True,
    "%": False,
    "?": False,
    "basket !gone sev=warn took=1731 /min/": True,
}


def test_filter_cases(spark):
    df = spark.createDataFrame([(LINE,)], "msg string")
    for exact in (False, True):
        got = df.select(*[filters.matches("msg", q, exact).alias(f"c{i}") for i, q in enumerate(CASES)]).first()
        assert dict(zip(CASES, got)) == CASES


def test_filter_on_other_lines(spark):
    rows = [("no json here, plain text",), ("not json level=error",), ("ÜBER alles",), (None,), ('{"a":null,"b":"x"}',), ('{"a":1.10,"b":"X","b":"y"}',), ('{"a":1} tail',), ("end\n",), ('{"a":{"b": 1},"c":[1e3]}',)]
    df = spark.createDataFrame(rows, "msg string")
    at = lambda q, exact=False: [r[0] for r in df.select(filters.matches("msg", q, exact)).collect()]
    f, t = False, True
    assert at("plain") == [t, f, f, f, f, f, f, f, f]
    assert at("level=error") == [f] * 9
    assert at("über") == [f, f, t, f, f, f, f, f, f]
    assert at("/über/") == [f, f, t, f, f, f, f, f, f]
    assert at("!b=x") == [t, t, t, t, f, t, t, t, t]
    assert at("a=") == [f, f, f, f, t, f, f, f, f]
    for exact in (False, True):  # a value as it is written, whichever way it is read
        assert at("a=1.10", exact) == [f, f, f, f, f, t, f, f, f]
        assert at("a=1.1", exact) == at("a=1", exact) == at('a={"b":1}', exact) == at("c=[1000.0]", exact) == [f] * 9
        assert at("c=[1e3]", exact) == [f, f, f, f, f, f, f, f, t]
        assert at("b=y", exact) == [f, f, f, f, f, t, f, f, f]
    assert at("/end$/") == [f] * 9  # $ is the end of the text, not before its last line break
    assert at("") == [t] * 9


def test_tokens():
    p = lambda q: [(t.kind, t.value, t.key, t.negated) for t in filters.parse(q)]
    assert p('!"a b"') == [("word", '"a', "", True), ("word", 'b"', "", False)]
    assert p("/abc") == [] and p("!/re/") == [] and p('"abc') == [("word", '"abc', "", False)]
    assert [t[0] for t in p("/charges error /x")] == ["regex", "word"]
    assert p('msg="a b"')[0] == ("pair", '"a', "msg", False)
    assert p("9a=b") == [("word", "9a=b", "", False)] and p("=x") == [("word", "=x", "", False)]
    assert filters.literals('error "two words" !no /re/ k=v') == ["error", "two words"]


@pytest.mark.parametrize("bad", ["(", ")", "a**", "*a", "a++", "(?=x)", "(?!x)", "(?<=x)", r"\1", "[", "[[:nope:]]", "[z-a]", "a{2,1}", "a{2000}", "\\", "(?>a)", r"\K"])
def test_refused_patterns(bad):
    with pytest.raises(regex.Unsupported):
        regex.translate(bad)


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("^get$", "GET", "GET\n"), ("[[:digit:]]+x", "12X", "x"), (r"a{2}", "aa", "a"), (r"\Qa.b\E", "a.b", "axb"), ("(?P<n>x)y", "XY", "x"), ("a{,2}", "a{,2}", "aa"), ("[]a]", "]", "b"),
        ("x+?y", "xxy", "y"), ("é", "É", "e"), (r"\x41", "a", "b"), ("[^[:space:]]", "a", " "), ("(?i:b)c", "BC", "b"), (r"\bfoo\b", "a foo b", "afoob"), ("[a&&b]", "&", "c"),
    ],
)
def test_translated_patterns(spark, pattern, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(regex.translate(pattern))).collect()] == [True, False]


def test_globs(spark):
    df = spark.createDataFrame([("api-1",), ("API_2",), ("a%c",), ("",)], "t string")
    at = lambda c: [r[0] for r in df.select(c).collect()]
    assert at(globs.selects(F.col("t"), "api-*")) == [True, False, False, False]
    assert at(globs.selects(F.col("t"), "api_*")) == [False, True, False, False]
    assert at(globs.selects(F.col("t"), "a%c")) == [False, False, True, False]
    assert at(globs.selects(F.col("t"), "*")) == [True] * 4
    assert at(globs.allows(F.col("t"), "API*")) == [False, True, False, False]
    assert at(globs.allows(F.col("t"), "a*-*1")) == [True, False, False, False]
    assert at(globs.allows_any(F.col("t"), [])) == [True] * 4


def test_times():
    now, s = 1_700_000_000 * 10**9, 10**9
    want = {
        "-15m": now - 900 * s, "-1h": now - 3600 * s, "-7d": now - 7 * 86400 * s, "-1.5d": now - 36 * 3600 * s, "-2w": now - 14 * 86400 * s, "now": now, " now ": now,
        "1700000000": now, "1700000000123": 1700000000123 * 10**6, "1700000000123456789": 1700000000123456789, "2026-10-04T10:00:00Z": 1791108000 * s,
        "2026-10-04T10:00:00.25-01:30": 1791108000 * s + 5400 * s + s // 4, "-5": -5 * s, "-100ms": now - s // 10,
    }
    assert {k: timeexpr.parse_time(k, -1, now) for k in want} == want
    for bad in ("", "-7x", "-d", "yesterday", "--1h", "2026-13-04T10:00:00Z", "1e9", "-nand"):
        assert timeexpr.parse_time(bad, -1, now) == -1
    assert timeexpr.query_range("", "", now) == (now - 3600 * s, now + 60 * s)


def test_rfc3339_and_truncation(spark):
    df = spark.createDataFrame([(0,), (1,), (-1,), (1475712557669794202,), (500000000,)], "t long")
    assert [r[0] for r in df.select(lines.rfc3339(F.col("t"))).collect()] == [
        "1970-01-01T00:00:00Z", "1970-01-01T00:00:00.000000001Z", "1969-12-31T23:59:59.999999999Z", "2016-10-06T00:09:17.669794202Z", "1970-01-01T00:00:00.5Z",
    ]
    t = spark.createDataFrame([("abcdef",), ("abc",), ("aéé",), (None,)], "m string")
    assert [r[0] for r in t.select(lines.truncated(F.col("m"), 4)).collect()] == ["abcd…[truncated]", "abc", "aé�…[truncated]", None]


def test_heartbeats(spark):
    df = spark.createDataFrame([("files=3;lag_bytes=10;rss=12345;junk;files=4",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(lines.heartbeat_stats(F.col("s"))).collect()]
    assert got == [{"files": "4", "lag_bytes": "10", "rss": "12345"}, {}, None]


def test_selectors():
    assert Selector(labels=["app:api", "team=pay", "app=b", ":x", 'a"b=c']).label_pairs() == {"app": "b", "team": "pay", "ab": "c"}
    assert [clamp(x) for x in (10, "7", 0, -1, 5001, "x", None, 5000)] == [10, 7, 500, 500, 500, 500, 500, 5000]


def test_exact_pairs_against_json():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    import json

    value = st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=5), st.lists(st.integers(), max_size=2), st.dictionaries(st.text(max_size=2), st.integers(), max_size=2))

    @settings(max_examples=200, deadline=None)
    @given(st.dictionaries(st.text(max_size=4), value, max_size=4), st.sampled_from([None, 1]))
    def check(obj, indent):
        text = json.dumps(obj, indent=indent)
        raw = filters.raw_fields(text)
        assert raw.keys() == obj.keys()
        for k, v in obj.items():
            assert raw[k] == v if isinstance(v, str) else raw[k] == "" if v is None else json.loads(raw[k]) == v
        assert filters.raw_fields(text + "x") is None

    check()
    assert re.match(filters.KEY, "a.b_9") and filters.exact_pair('{"n":1e3}', "n", "1e3")
