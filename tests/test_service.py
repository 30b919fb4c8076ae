import json
from datetime import datetime, timedelta

import pytest

from lakelens import cli
from lakelens.config import Settings
from lakelens.engine import SearchEngine
from lakelens.operators import gate
from lakelens.service import Service
from lakelens.streaming import gate_stream as G

SARIF = {"runs": [{"results": [{"level": "error"}, {"level": "warning"}]}]}


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "lock.py").write_text("def acquire_lock(name):\n    return name\n")
    (root / "saga.py").write_text("class Saga:\n    def compensate(self):\n        return 1\n")
    return root


def test_requests(spark, project, tmp_path):
    engine = SearchEngine(spark, Settings(embedder="hash", embed_dim=8, catalog_path=str(tmp_path / "c"), api_key="k"))
    s = Service(engine, str(tmp_path / "log"))
    assert s.handle("GET", "/healthz") == (200, {"status": "ok"})
    assert s.handle("GET", f"/status?project_id={project}")[0] == 401
    assert s.handle("POST", "/index", json.dumps({"project_id": str(project)}).encode(), "k")[1]["chunks"] == 2
    status, found = s.handle("POST", "/search", json.dumps({"project_id": str(project), "query": "acquire_lock", "mode": "lexical"}).encode(), "k")
    assert status == 200 and found["results"][0]["path"].endswith("lock.py") and "lock.py:1-2" in found["text"]
    assert s.handle("GET", f"/status?project_id={project}", b"", "k")[1]["indexed"]
    for bad in ({"project_id": str(project), "query": ""}, {"project_id": str(project), "query": "q", "max_results": 51}, {"query": "q"}, {"project_id": "p", "query": "q", "odd": 1}):
        assert s.handle("POST", "/search", json.dumps(bad).encode(), "k")[0] == 400
    assert s.handle("POST", "/search", b"[1]", "k")[0] == 400 and s.handle("POST", "/search", b"{", "k")[0] == 400
    assert s.handle("GET", "/nowhere", b"", "k")[0] == 404
    assert s.handle("GET", "/dashboard/data", b"", "k")[1] == {"decisions": [], "count": 0}
    status, d = s.handle("POST", "/gate", json.dumps({"sarif": SARIF, "project_id": "p", "sha": "s"}).encode(), "k")
    assert status == 200 and not d["passed"] and d["blocking"] == 1
    assert s.handle("POST", "/gate", json.dumps({"sarif": SARIF, "policy": {"block_on": "error"}}).encode(), "k")[0] == 400
    seen = s.handle("GET", "/dashboard/data?limit=5", b"", "k")[1]
    assert seen["count"] == 1 and seen["decisions"][0]["state"] == "failed"
    assert "lock.py" in s.tools()["get_symbol"](str(project), "acquire_lock") and s.tools()["status"](str(project))["chunks"] == 2


def test_pages_and_answers_over_http(spark, tmp_path):
    import socket
    import threading
    import time
    import urllib.error
    import urllib.request

    with socket.socket() as probe:
        probe.bind(("127.0.0.1", 0))
        port = probe.getsockname()[1]
    engine = SearchEngine(spark, Settings(embedder="hash", embed_dim=8, catalog_path=str(tmp_path / "c"), api_key="k", host="127.0.0.1", port=port))
    threading.Thread(target=Service(engine, str(tmp_path / "log")).serve, daemon=True).start()

    def get(path, key="k"):
        for _ in range(50):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", headers={"X-API-Key": key})) as r:
                    return r.status, r.headers["Content-Type"], r.read().decode()
            except urllib.error.HTTPError as problem:
                return problem.code, problem.headers["Content-Type"], problem.read().decode()
            except OSError:
                time.sleep(0.1)
        raise AssertionError("no server")

    assert get("/dashboard")[:2] == (200, "text/html; charset=utf-8") and "Findings Dashboard" in get("/dashboard")[2]
    assert get("/dashboard", "wrong")[0] == 401 and get("/static/dashboard.html")[0] == 200
    assert get("/static/../service.py")[0] == 404 and get("/static/")[0] == 404 and get("/healthz", "")[2] == '{"status": "ok"}'


def test_tools_for_agents(spark, project, tmp_path):
    import io

    from lakelens.agent import AgentServer

    engine = SearchEngine(spark, Settings(embedder="hash", embed_dim=8, catalog_path=str(tmp_path / "c")))
    server = AgentServer(Service(engine, str(tmp_path / "log")).tools())

    def call(method, n=1, **params):
        return server.answer({"jsonrpc": "2.0", "id": n, "method": method, "params": params})

    assert call("initialize")["result"]["capabilities"] == {"tools": {}} and server.answer({"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    tools = {t["name"]: t["inputSchema"] for t in call("tools/list")["result"]["tools"]}
    assert tools.keys() == {"semantic_code_search", "get_symbol", "index", "status"} and tools["semantic_code_search"]["required"] == ["project_id", "query"]
    assert tools["index"]["properties"]["force"] == {"type": "boolean"} and tools["semantic_code_search"]["properties"]["max_results"] == {"type": "integer"}
    assert json.loads(call("tools/call", name="index", arguments={"project_id": str(project)})["result"]["content"][0]["text"])["files"] == 2
    found = call("tools/call", name="get_symbol", arguments={"project_id": str(project), "symbol": "acquire_lock"})["result"]
    assert "lock.py" in found["content"][0]["text"] and not found["isError"]
    assert call("tools/call", name="status", arguments={"odd": 1})["result"]["isError"] and call("tools/call", name="none")["error"]["code"] == -32602
    assert call("odd")["error"]["code"] == -32601 and server.answer([])["error"]["code"] == -32600
    out = io.StringIO()
    server.serve(io.StringIO('{"jsonrpc": "2.0", "id": 7, "method": "ping"}\n\n{\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [7, None]


def test_a_batch_that_comes_again_is_not_logged_again(spark, tmp_path):
    rows = spark.createDataFrame([("p", "s", "failed", 1, 0, 1, ["r"])], "project_id string, sha string, state string, blocking int, warnings int, total int, reasons array<string>")
    for batch in ("a-0", "a-0", "a-1", None, None):
        gate.append_decisions(rows, str(tmp_path / "log"), batch)
    got = sorted((r.id, r.batch) for r in gate.read_log(spark, str(tmp_path / "log")).collect())
    assert got == [(1, "a-0"), (2, "a-1"), (3, None), (4, None)]


def test_command_line(spark, project, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("LAKELENS_EMBEDDER", "hash")
    monkeypatch.setenv("LAKELENS_EMBED_DIM", "8")
    monkeypatch.setenv("LAKELENS_CATALOG_PATH", str(tmp_path / "c"))
    report, policy, items = tmp_path / "r.sarif", tmp_path / "p.yml", tmp_path / "q.json"
    report.write_text(json.dumps(SARIF))
    policy.write_text("block_on: [critical]\n")
    items.write_text(json.dumps([{"query": "acquire_lock", "expect": "lock.py"}, {"query": "compensate", "expect": "saga.py", "mode": "lexical", "relevant": {"saga.py": 2.0}}]))
    assert cli.main(["gate", str(report)], spark) == 1 and cli.main(["gate", str(report), "--policy", str(policy)], spark) == 0
    assert cli.main(["index", str(project)], spark) == 0 and cli.main(["search", str(project), "Saga", "--mode", "lexical"], spark) == 0
    assert cli.main(["bench", str(project), "--fixtures", str(items)], spark) == 0
    out = capsys.readouterr().out
    assert "failed: 2 findings, 1 blocking, 1 warnings" in out and "success: 2 findings, 0 blocking" in out
    assert "indexed 2 files, 2 chunks" in out and "saga.py" in out and '"found@5": 1.0' in out


def test_streamed_reports_become_decisions_once(spark, tmp_path):
    rows = [(n, "p", "s", json.dumps(SARIF), None, datetime(2024, 1, 1) + timedelta(hours=n)) for n in range(6)]
    spark.createDataFrame(rows, G.REPORTS).repartition(2).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = G.decision_stream(G.report_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "check"))
        q.awaitTermination(60)
    log = gate.read_log(spark, str(tmp_path / "log"))
    assert sorted(r.id for r in log.collect()) == [1, 2, 3, 4, 5, 6]
    t = G.trends(log, "1 day").collect()
    assert sum(r.runs for r in t) == 6 and sum(r.failed for r in t) == 6
    streamed = G.trends(spark.readStream.schema(gate.LOG).parquet(str(tmp_path / "log")), "1 day")
    q = streamed.writeStream.outputMode("complete").format("memory").queryName("trends").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("trends").agg({"runs": "sum"}).first()[0] == 6
