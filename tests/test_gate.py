import json

import pytest

from lakelens.operators import gate


def sarif(*levels, rules=()):
    return json.dumps({"runs": [{"tool": {"driver": {"rules": list(rules)}}, "results": [{"level": x} if isinstance(x, str) else x for x in levels]}]})


def decide(spark, body, policy=None, own=None):
    df = spark.createDataFrame([(1, body, own)], "request_id int, sarif string, policy string")
    rows = gate.decide(df, policy).collect()
    return rows[0] if rows else None


def test_decisions(spark):
    d = decide(spark, sarif("error", "warning"))
    assert (d.state, d.blocking, d.warnings, d.total, d.reasons) == ("failed", 1, 1, 2, ["1 finding(s) at blocking level ['error']"])
    assert decide(spark, sarif("warning", "warning")).state == "success"
    d = decide(spark, sarif(*["note"] * 5), gate.Policy(max_findings=3))
    assert d.state == "failed" and d.reasons == ["5 findings exceeds max_findings=3"]
    d = decide(spark, sarif("warning"), gate.Policy(block_on=("warning",)))
    assert (d.blocking, d.warnings, d.state) == (1, 1, "failed")
    d = decide(spark, sarif("critical"), own='{"block_on": ["critical"]}')
    assert d.state == "failed"


def test_rule_defaults_last_of_equal_ids_and_empty_levels(spark):
    rules = [{"id": "R", "defaultConfiguration": {"level": "note"}}, {"id": "R", "defaultConfiguration": {"level": "error"}}, {"id": "S"}]
    d = decide(spark, sarif({"ruleId": "R"}, {"ruleId": "R", "level": ""}, {"ruleId": "S"}, {}, {"level": "Error"}, rules=rules))
    assert (d.blocking, d.warnings, d.total) == (2, 2, 5)


def test_odd_bodies(spark):
    assert decide(spark, None) is None and decide(spark, sarif("error")[:20]) is None and decide(spark, '"text"') is None
    assert decide(spark, json.dumps(sarif("error"))).blocking == 1
    for empty in ("{}", '{"runs": []}', '{"runs": [{}]}', '{"runs": null}'):
        d = decide(spark, empty)
        assert (d.state, d.total) == ("success", 0)
    assert gate.decide(spark.createDataFrame([], "request_id int, sarif string")).count() == 0


def test_policies():
    p = gate.Policy.from_yaml("block_on: [error, warning]\nmax_findings: 10\n")
    assert p == gate.Policy(("error", "warning"), ("warning",), 10)
    assert gate.Policy.from_yaml("") == gate.Policy()
    for bad in ({"block_on": "error"}, {"unknown": 1}, {"max_findings": "3"}):
        with pytest.raises(ValueError):
            gate.Policy.from_dict(bad)


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    assert gate.recent(gate.read_log(spark, path)).count() == 0
    df = spark.createDataFrame([(n, f"p{n}", "s", sarif("error")) for n in range(5)], "request_id int, project_id string, sha string, sarif string").repartition(3)
    gate.append_decisions(gate.decide(df), path)
    gate.append_decisions(gate.decide(df), path)
    log = gate.read_log(spark, path)
    assert sorted(r.id for r in log.collect()) == list(range(1, 11))
    newest = gate.recent(log, 4).collect()
    assert [r.id for r in newest] == [10, 9, 8, 7] and newest[0].ts.endswith("+00:00")
    t = gate.totals(gate.recent(log, 4)).first()
    assert (t.runs, t.failed, t.blocking, t.warnings) == (4, 4, 4, 0)
    assert tuple(gate.totals(gate.recent(log.limit(0))).first()) == (0, 0, 0, 0)
