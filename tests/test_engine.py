import json
import subprocess
import threading

import pytest

from lakelens.config import Settings
from lakelens.engine import SearchEngine
from lakelens.operators import catalog
from lakelens.operators.embedding import HashEmbedder
from lakelens.render import format_results, safe_fence
from lakelens.sources import directory, fetch, status


class Counting(HashEmbedder):
    seen: list = []


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "lock.py").write_text("def acquire_lock(name):\n    return name\n")
    (root / "pkg" / "saga.py").write_text("class Saga:\n    def compensate(self):\n        return 1\n")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.py").write_text("def hidden(): pass\n")
    (root / "notes.md").write_text("not indexed")
    (root / "bad.py").write_bytes(b"def odd():\r\n    return '\xff'\r\n")
    return root


def engine(spark, tmp_path, dim=8, **more):
    return SearchEngine(spark, Settings(embedder="hash", embed_dim=dim, catalog_path=str(tmp_path / "catalog"), embed_concurrency=2, **more))


def test_index_search_and_incremental(spark, project, tmp_path):
    e = engine(spark, tmp_path)
    stats = e.index(str(project))
    assert (stats.files, stats.chunks, stats.errors) == (3, 3, [])
    assert e.search(str(project), "acquire_lock", mode="lexical")[0]["path"] == "pkg/lock.py"
    assert e.search(str(project), "acquire_lock")[0]["path"] == "pkg/lock.py"
    assert len(e.search(str(project), "compensate the saga in this code", mode="semantic", max_results=2)) == 2
    (project / "pkg" / "lock.py").write_text("def release_lock(name):\n    return name\n")
    (project / "pkg" / "saga.py").unlink()
    again = e.index(str(project))
    assert (again.files, again.chunks) == (2, 1)
    assert e.search(str(project), "Saga", mode="lexical") == []
    assert e.search(str(project), "release_lock", mode="lexical")[0]["path"] == "pkg/lock.py"
    assert e.index(str(project)).chunks == 0
    assert e.status(str(project))["chunks"] == 2
    assert e.catalog.manifest(str(project), "HEAD").generation == 3


def test_indexes_do_not_answer_for_each_other(spark, tmp_path):
    for name, text in (("one", "zebra stripes zebra"), ("two", "harbour quay")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.py").write_text(f"def f():\n    return '{text}'\n")
    e = engine(spark, tmp_path)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for project, ref in ((one, "HEAD"), (two, "HEAD"), (two, "dev")):
        assert e.index(project, ref).chunks == 1
    assert e.search(two, "zebra", mode="lexical") == [] and e.search(two, "zebra", ref="dev", mode="lexical") == []
    (hit,) = e.search(one, "zebra", mode="lexical")
    assert "zebra" in hit["text"]
    # statistics are over all three indexes: one of three chunks holds the word twice, among its seven tokens, symbol included
    n, mean = e.catalog.totals()
    assert (n, mean) == (3, 6 + 1 / 3)
    import math

    assert hit["score"] == pytest.approx(math.log((3 - 1 + 0.5) / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 7 / mean)))


def test_readers_keep_the_generation_they_began_with(spark, project, tmp_path):
    e = engine(spark, tmp_path)
    e.index(str(project))
    begun = e.catalog.read("chunks", str(project), "HEAD")
    e.index(str(project), force=True)
    assert begun.count() == 3
    e.index(str(project), force=True)
    key = catalog.index_key(str(project), "HEAD")
    assert e.catalog.files.names(e.catalog.files.at(key)) == ["gen=2", "gen=3"]


def test_a_failed_rebuild_leaves_the_index(spark, project, tmp_path):
    e = engine(spark, tmp_path)
    e.index(str(project))

    class Broken(HashEmbedder):
        def embed_documents(self, texts):
            raise RuntimeError("no model")

    broken = SearchEngine(spark, e.settings, embedder=Broken(8))
    with pytest.raises(Exception, match="no model"):
        broken.index(str(project), force=True)
    assert e.status(str(project))["chunks"] == 3 and e.search(str(project), "acquire_lock", mode="lexical")


def test_builds_of_one_index_are_serialised(spark, project, tmp_path):
    e = engine(spark, tmp_path)
    threads = [threading.Thread(target=e.index, args=(str(project),), kwargs={"force": True}) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert e.catalog.manifest(str(project), "HEAD").generation == 3 and e.status(str(project))["chunks"] == 3


def test_another_embedder_rebuilds_and_auto_index_can_be_off(spark, project, tmp_path):
    engine(spark, tmp_path).index(str(project))
    other = engine(spark, tmp_path, dim=16)
    assert other._needs_index(str(project), "HEAD")
    assert len(other.search(str(project), "acquire_lock", mode="semantic")) == 3
    closed = engine(spark, tmp_path, dim=4, allow_auto_index=False)
    with pytest.raises(ValueError, match="not indexed"):
        closed.search(str(project), "anything")


def test_unchanged_commit_returns_at_once(spark, project, tmp_path):
    for cmd in (["init", "-q"], ["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@example.org", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(project), *cmd], check=True)
    e = engine(spark, tmp_path)
    e.index(str(project))
    assert e.status(str(project))["commit"]
    assert e.index(str(project)).files == 0
    assert e.index(str(project), force=True).chunks == 3


def test_one_build_for_concurrent_searches(spark, project, tmp_path):
    e, built = engine(spark, tmp_path), []
    real = e.index
    e.index = lambda *a, **k: (built.append(1), real(*a, **k))[1]
    threads = [threading.Thread(target=e.search, args=(str(project), "acquire_lock")) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert built == [1]


def test_validation_and_rerank(spark, project, tmp_path):
    e = engine(spark, tmp_path)
    for bad in ("", "  ", "x" * 2001, "a\x00", "b\x07"):
        with pytest.raises(ValueError):
            e.search(str(project), bad)
    for bad in ("", "x" * 513, "a\nb"):
        with pytest.raises(ValueError):
            e.search(bad, "q")
    with pytest.raises(ValueError, match="mode"):
        e.search(str(project), "q", mode="best")

    class Last:
        def rerank(self, query, documents):
            return [float("Saga" in d) for d in documents]

    r = SearchEngine(spark, e.settings, reranker=Last())
    assert r.search(str(project), "acquire_lock name", mode="hybrid")[0]["path"] == "pkg/saga.py"


def test_render():
    rows = [{"path": "a.py", "start_line": 1, "end_line": 2, "symbol": "f", "score": 0.5, "text": "x ``` y"}, {"path": "b.py", "start_line": 1, "end_line": 1, "symbol": "", "score": 1.0, "text": "z" * 1600}]
    text = format_results("q", rows)
    assert "1. a.py:1-2  (f)  [score=0.500]\n````\n" in text and "…(truncated)" in text and "untrusted" in text
    assert format_results("q", []) == "[No code matches for query 'q'.]"
    assert safe_fence("plain") == "```"


def test_fetch_rules(tmp_path):
    s = Settings(repo_cache=str(tmp_path / "c"), gitlab_token="tok")
    assert fetch.clone_url(s, "group/repo") == "https://oauth2:tok@gitlab.com/group/repo.git"
    for bad in ("https://evil.example/x", "git@evil.example:x", "ftp"):
        if bad != "ftp":
            with pytest.raises(ValueError, match="host"):
                fetch.clone_url(s, bad)
    free = Settings(fetch_allow_hosts="*", gitlab_token="tok")
    assert fetch.clone_url(free, "http://h.example/x") == "http://h.example/x"
    with pytest.raises(ValueError, match="local folders"):
        fetch.fetch_repo(Settings(allow_local_path=False), str(tmp_path), "HEAD")
    ran = []

    class Done:
        returncode, stderr, stdout = 1, "e" * 400, ""

    with pytest.raises(RuntimeError) as problem:
        fetch.fetch_repo(s, "group/repo", "v1", run=lambda cmd, **k: (ran.append(cmd), Done)[1])
    assert "--branch" in ran[0] and len(str(problem.value)) < 330
    (tmp_path / "c" / catalog.index_key("group/kept", "HEAD")).mkdir(parents=True)
    assert fetch.fetch_repo(s, "group/kept", "HEAD", run=None).name == catalog.index_key("group/kept", "HEAD")  # a cached copy is used as it is
    with pytest.raises(ValueError, match="method"):
        fetch.fetch_repo(Settings(fetch="ftp", repo_cache=str(tmp_path / "d")), "g/r", "HEAD")


def test_rest_fetch(tmp_path):
    def get(url, params, headers):
        if url.endswith("/tree"):
            page = params["page"]
            entries = [{"type": "blob", "path": f"pkg/m{page}.py"}, {"type": "blob", "path": "README.md"}, {"type": "tree", "path": "pkg"}]
            return 200, {"x-next-page": "2" if page == "1" else ""}, json.dumps(entries).encode()
        return (404, {}, b"") if "m2" in url else (200, {}, b"x = 1\r\n")

    s = Settings(fetch="rest", repo_cache=str(tmp_path))
    root = fetch.fetch_repo(s, "group/repo", "HEAD", get=get)
    assert [p.name for p in root.rglob("*.py")] == ["m1.py"]
    with pytest.raises(ValueError):
        list(fetch.rest_paths(s, "https://gitlab.com/x", "HEAD", get))
    fetch.cleanup_repo(s, "group/repo", "HEAD")
    assert not root.exists()


def test_status_post():
    sent = []
    code = status.post_commit_status("https://h.example/", "t", "a/b", "sha", "failed", ["r" * 300], send=lambda *a: (sent.append(a), 201)[1])
    assert code == 201 and "a%2Fb" in sent[0][0] and len(sent[0][1]["description"]) == 255


def test_settings():
    s = Settings.from_env({"LAKELENS_EMBED_DIM": "64", "LAKELENS_ALLOW_LOCAL_PATH": "false", "LAKELENS_INCLUDE_GLOBS": "**/*.py, docs, src/*.tar.gz"})
    assert s.embed_dim == 64 and not s.allow_local_path and s.suffixes == {".py", ".gz"}
    assert s.allowed_hosts == ["gitlab.com"]
    with pytest.raises(ValueError):
        Settings(rerank_top_k=0)


def test_directory_reads_relative_parts_only(spark, tmp_path):
    root = tmp_path / "build" / "repo"
    root.mkdir(parents=True)
    (root / "a.py").write_text("x")
    (root / "b.py").write_text("y" * 50)
    rows = directory.read_tree(spark, str(root), Settings(max_file_bytes=20)).collect()
    assert [tuple(r) for r in rows] == [("a.py", "x")]


def test_blank_files_give_no_index(spark, tmp_path):
    root = tmp_path / "blank"
    root.mkdir()
    (root / "a.py").write_text("\n \n")
    e = engine(spark, tmp_path)
    assert e.index(str(root)).chunks == 0 and not e.status(str(root))["indexed"] and e._needs_index(str(root), "HEAD")
    assert e.search(str(root), "anything") == []


def test_catalog_helpers(spark):
    f = "project_id string, ref string, path string, sha string"
    stored = spark.createDataFrame([("p", "m", "a", "1"), ("p", "m", "b", None), ("p", "m", "c", "3")], f)
    current = spark.createDataFrame([("p", "m", "a", "1"), ("p", "m", "b", "2"), ("p", "m", "d", "4")], f)
    got = sorted((r.path, r.change) for r in catalog.diff_paths(current, stored).collect())
    assert got == [("b", "changed"), ("c", "removed"), ("d", "changed")]
    merged = catalog.upsert(stored, current, ["project_id", "ref", "path"])
    assert sorted((r.path, r.sha) for r in merged.collect()) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]
    old = spark.createDataFrame([("p", "c1", None), ("q", "c2", "s")], "k string, commit string, sig string")
    new = spark.createDataFrame([("p", None, "s1"), ("r", "c3", None)], "k string, commit string, sig string")
    assert sorted(map(tuple, catalog.merge_columns(old, new, ["k"]).collect()), key=repr) == [("p", "c1", "s1"), ("q", "c2", "s"), ("r", "c3", None)]


def test_addresses_and_refs(tmp_path):
    s = Settings(gitlab_token="tok", repo_cache=str(tmp_path / "c"))
    assert fetch.Remote.of(s, "git@Host.example:a/b.git") == fetch.Remote("git@Host.example:a/b.git", "ssh", "host.example")
    assert fetch.host_of("https://U@H.example:8/x") == "h.example" and fetch.host_of("group/repo") is None
    assert [fetch._ref(r) for r in ("HEAD", "default", "", "dev")] == [{}, {}, {}, {"ref": "dev"}]

    def failing(command, **_):
        return subprocess.CompletedProcess(command, 1, "", "no access with oauth2:tok@gitlab.com")

    with pytest.raises(RuntimeError) as problem:
        fetch.fetch_repo(s, "group/repo", "HEAD", run=failing)
    assert "tok@" not in str(problem.value)

    def broken(url, params, headers):
        return (200, {}, b'[{"type": "blob", "path": "a.py"}, {"type": "blob", "path": "../../x.py"}]') if url.endswith("/tree") else (200, {}, b"x")

    root = fetch.fetch_repo(Settings(fetch="rest", repo_cache=str(tmp_path / "d")), "group/repo", "dev", get=broken)
    assert [p.name for p in root.rglob("*.py")] == ["a.py"] and not list(tmp_path.rglob("x.py"))
    with pytest.raises(RuntimeError):
        fetch.fetch_repo(Settings(fetch="rest", repo_cache=str(tmp_path / "e")), "group/repo", "dev", get=lambda *a: (500, {}, b""))
    assert not [p for p in (tmp_path / "e").iterdir() if not p.name.endswith(".partial")]
