"""Strict nested reading: what is refused, with which code and where."""

from __future__ import annotations

import json

from runloom.sources import records


def faults(spark, schema, *texts):
    rows = spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(texts)], "path long, value string")
    good, refused = records.parse_records(rows, schema)
    found = {r.path: (r.reject_code, r.reject_path) for r in refused.collect()}
    kept = {r.path for r in good.collect()}
    assert kept | set(found) == set(range(len(texts))) and not kept & set(found)
    return [found.get(i) for i in range(len(texts))]


def test_every_kind_of_value(spark):
    schema = spark.createDataFrame([], "i int, l long, d double, b boolean, s string, a array<struct<n:bigint,o:map<string,array<boolean>>>>").schema
    ok = {"i": 1, "l": 1 << 40, "d": 1, "b": True, "s": "x", "a": []}
    change = lambda **more: ok | more
    got = faults(
        spark, schema, ok, dict.fromkeys(ok), change(d=1.5e300), change(a=[None, {"n": None, "o": {"k": [True, None]}}]), change(i=1 << 31), change(l=1 << 63), change(l=1.5), change(d="1"), change(d=True), change(b=1), change(s=1), change(s={}),
        change(a={}), change(a=[{"n": True, "o": {}}]), change(a=[{"n": 1, "o": {}}, {"n": 1}]), change(a=[{"n": 1, "o": {}, "p": 1}]), change(a=[{"n": 1, "o": {"k": [], "j": [True, 0]}}]), change(a=[{"n": 1, "o": []}]), change(a=[3]), change(extra=1),
        {k: v for k, v in ok.items() if k != "d"}, [ok], 5, "{", None, '{"i":1,"i":1}', '{"i":NaN,"l":1,"d":1,"b":true,"s":"","a":[]}',
    )
    t, f = "RECORD_TYPE", "RECORD_FIELDS"
    assert got == [
        None, None, None, None, (t, "$.i"), (t, "$.l"), (t, "$.l"), (t, "$.d"), (t, "$.d"), (t, "$.b"), (t, "$.s"), (t, "$.s"),
        (t, "$.a"), (t, "$.a[0].n"), (f, "$.a[1].o"), (f, "$.a[0].p"), (t, "$.a[0].o.j[1]"), (t, "$.a[0].o"), (t, "$.a[0]"), (f, "$.extra"),
        (f, "$.d"), (f, "$"), (f, "$"), ("RECORD_JSON", None), ("RECORD_JSON", None), ("RECORD_JSON", None), ("RECORD_JSON", None),
    ]


def test_empty_and_long_inputs(spark):
    schema = spark.createDataFrame([], "a array<bigint>, m map<string,bigint>").schema
    long = {"a": list(range(50_000)) + [True], "m": {}}
    assert faults(spark, schema, {"a": list(range(50_000)), "m": {f"k{i}": i for i in range(5_000)}}, long) == [None, ("RECORD_TYPE", "$.a[50000]")]
    assert faults(spark, schema) == []
