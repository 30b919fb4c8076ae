import json
from datetime import datetime

from lakelens.operators import nested_flatten as N

T = [datetime(2024, 1, d) for d in range(1, 9)]
SCHEMA = "request_id long, sarif string, received_at timestamp"


def report():
    rules = [{"id": "A", "defaultConfiguration": {"level": "error"}}, {"id": "B"}, None, {"id": "A", "defaultConfiguration": {"level": "note"}}]
    places = [{"physicalLocation": {"artifactLocation": {"uri": "x.py"}, "region": {"startLine": 3}}}, {"physicalLocation": {"artifactLocation": {"index": 0}}}, None]
    results = [
        {"ruleId": "A", "locations": places}, {"rule": {"id": "B"}, "level": "", "locations": []}, {"ruleIndex": 0, "level": "none"}, {"ruleIndex": 9}, {"level": None}, None,
        {"ruleId": "", "ruleIndex": True, "relatedLocations": places},
    ]
    return {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t", "rules": rules}}, "artifacts": [{"location": {"uri": "art.py"}}], "results": results}, None]}


def rows(spark, bodies):
    df = spark.createDataFrame([(i, b, t) for i, b, t in bodies], SCHEMA)
    return sorted(map(tuple, N.result_locations(N.write_tables(df)).collect()))


def test_levels_rules_and_places(spark):
    assert rows(spark, [(1, json.dumps(report()), T[0])]) == [
        (1, 0, 0, 0, "A", "note", "x.py"), (1, 0, 0, 1, "A", "note", "art.py"), (1, 0, 0, 2, "A", "note", ""), (1, 0, 1, -1, "B", "warning", ""),
        (1, 0, 2, -1, "A", "none", ""), (1, 0, 3, -1, "", "warning", ""), (1, 0, 4, -1, "", "warning", ""), (1, 0, 5, -1, "", "warning", ""), (1, 0, 6, -1, "", "warning", ""),
    ]


def test_last_body_counts_and_bad_bodies_give_nothing(spark):
    body = json.dumps(report())
    assert rows(spark, [(1, body, T[0]), (1, body[:50], T[1])]) == []
    assert rows(spark, [(1, body, T[0]), (1, None, T[1])]) == []
    assert len(rows(spark, [(1, None, T[0]), (1, json.dumps(body), T[1]), (1, json.dumps(body), T[1])])) == 9
    for bad in ("", "[]", "3", "null", '"x"', '{"runs": 5}', '{"runs": [{"results": {}}]}', '{"a": NaN}', "[" * 5000):
        assert rows(spark, [(1, bad, T[0])]) == [], bad
    assert rows(spark, [(None, body, T[0])]) == []
    assert rows(spark, []) == []


def test_every_row_points_to_its_parent(spark, tmp_path):
    df = spark.createDataFrame([(i, json.dumps(report()), T[0], "x", 1) for i in range(5)], SCHEMA + ", tag string, pk int")
    N.write_tables(df, str(tmp_path / "t"))
    tables = {tag: N.read_table(spark, str(tmp_path / "t"), tag) for tag in N.TABLES}
    counts = {k: v.count() for k, v in tables.items()}
    assert counts == {"report": 5, "run": 10, "rule": 20, "artifact": 5, "result": 35, "location": 15}
    for child, parent in (("run", "report"), ("rule", "run"), ("artifact", "run"), ("result", "run"), ("location", "result")):
        keys = {r.pk for r in tables[parent].collect()}
        assert len(keys) == counts[parent]
        assert {r.parent_pk for r in tables[child].collect()} <= keys


def test_a_very_large_report(spark):
    big = {"runs": [{"results": [{"ruleId": "R" * 50, "level": "error", "locations": [{}]} for _ in range(25_000)]}]}
    df = spark.createDataFrame([(1, json.dumps(big), T[0])], SCHEMA)
    assert N.result_locations(N.write_tables(df)).count() == 25_000


def test_long_reports_leave_in_bounded_batches():
    import pandas as pd

    big = {"runs": [{"results": [{"level": "error", "locations": [{}]} for _ in range(25_000)]}]}
    sizes = [len(x) for x in N._emit(iter([pd.DataFrame({"request_id": [1, 2], "sarif": [json.dumps(big), json.dumps(big)]})]))]
    assert max(sizes) == 20_000 and sum(sizes) == 2 * 50_002


def test_repeated_requests_with_and_without_broadcast(spark):
    body = json.dumps(report())
    df = spark.createDataFrame([(1, body, T[0]), (1, None, T[1]), (2, body, T[0]), (3, None, T[1]), (3, body, T[1]), (3, body, T[1]), (None, body, T[0])], SCHEMA)
    want = [(1, None), (2, body), (3, body)]
    for most in (0, 10):
        assert sorted((tuple(r) for r in N.latest_bodies(df, most).collect()), key=repr) == sorted(want, key=repr)
