import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelens.operators import embedding, evaluation, fusion, lexical, vector

CHUNKS = "chunk_pos long, project_id string, ref string, path string, start_line int, end_line int, symbol string, text string"


def chunks(spark, rows):
    return spark.createDataFrame([(n, "p", "HEAD", f"f{n}.py", 1, 2, s, t) for n, (s, t) in enumerate(rows)], CHUNKS)


def stored(df, asked, key="k"):
    postings = lexical.build_postings(df.withColumn("index_key", F.lit(key)), ("index_key", "chunk_pos"))
    stats = lexical.doc_stats(df)
    totals = stats.agg(F.count(F.lit(1)), F.avg("n_tokens")).first()
    return lexical.bm25(postings, stats, asked, tuple(totals), key)


def test_more_terms_than_a_set_takes_give_the_same(spark, monkeypatch):
    df = chunks(spark, [("a", "lock the lock of a"), (None, "acquire_lock acquire"), ("x", ""), ("lock", "b")])
    asked = spark.createDataFrame([(0, "acquire_lock"), (1, "the lock")], "query_id int, query string")
    one = [tuple(r) for r in lexical.search(df, asked, 5).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(lexical, "TERM_SET", 1)
    assert one and [tuple(r) for r in lexical.search(df, asked, 5).orderBy("query_id", "rank").collect()] == one


@pytest.mark.parametrize("seed", [1, 2])
def test_bm25_equals_sqlite(spark, seed):
    rng = random.Random(seed)
    words = ["acquire", "lock", "acquire_lock", "Redis", "crème", "init", "__init__", "fooBar", "saga", "x1", "lock.lock"]
    rows = [(rng.choice(["", None, "acquire_lock", "fooBar"]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for _ in range(40)]
    queries = ["acquire_lock", "__init__ redis", "fooBar saga", "creme x1", "lock", "nothing_here", "!!!"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, symbol)")
    db.executemany("INSERT INTO t(rowid, text, symbol) VALUES (?, ?, ?)", [(n + 1, t, s or "") for n, (s, t) in enumerate(rows)])
    df = chunks(spark, rows)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {(r.query_id, r.chunk_pos): r.score for r in stored(df, asked).collect()}
    want = {}
    from lakelens.functions import text as T

    terms = {r.query_id: r.t for r in asked.select("query_id", T.query_terms(F.col("query")).alias("t")).collect()}
    for q in terms:
        match = " OR ".join(f'"{t}"' for t in terms[q])
        if match:
            want |= {(q, n - 1): -s for n, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_camel_case_is_split_in_queries_only(spark):
    df = chunks(spark, [("", "acquireLock now"), ("", "the lock")])
    asked = spark.createDataFrame([(1, "lock"), (2, "acquireLock")], "query_id int, query string")
    got = {(r.query_id, r.chunk_pos) for r in lexical.search(df, asked, 5).collect()}
    assert got == {(1, 1), (2, 0), (2, 1)}


def test_empty_index_and_like(spark):
    df = chunks(spark, [("", "load_model here"), ("", "loadXmodel"), ("", None)])
    asked = spark.createDataFrame([(1, "load_model")], "query_id int, query string")
    assert lexical.search(df.limit(0), asked, 5).count() == 0
    assert [r.chunk_pos for r in lexical.like_search(df, spark.createDataFrame([(1, "_x"), (2, "load")], "query_id int, query string"), 5).where("query_id = 2").collect()] == [0, 1]


def test_cosine_single_and_batch_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((60, 8)).astype(np.float32)
    m[7] = m[3]
    df = spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(m)] + [(100, None), (101, [1.0])], "id long, vector array<float>")
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for q in (3, 9):
        scores = np.round(unit @ unit[q], 6)
        want = sorted(range(60), key=lambda n: (-scores[n], n))[:5]
        single = [r.id for r in vector.top_k(df, m[q].tolist(), 5).collect()]
        batch = vector.batch_top_k(df, df.where(f"id = {q}").select(F.col("id").alias("query_id"), "vector"), 5)
        assert single == want == [r.id for r in batch.orderBy("rank").collect()]
    assert vector.batch_top_k(df.limit(0), df.select(F.col("id").alias("query_id"), "vector"), 5).count() == 0


ARMS = "query_id int, arm int, rank int, path string, start_line int, end_line int"


def test_rrf_golden(spark):
    rows = [(1, 0, r, p, 1, 2) for r, p in enumerate("abc")] + [(1, 1, r, p, 1, 2) for r, p in enumerate("bda")]
    got = [(r.path, round(r.score, 6)) for r in fusion.fuse(spark.createDataFrame(rows, ARMS)).orderBy("rank").collect()]
    assert got == [("b", 0.03306), ("a", 0.032796), ("d", 0.016393), ("c", 0.016129)]


def test_rrf_counts_a_repeated_key_twice_and_keeps_first_on_ties(spark):
    rows = [(1, 0, 0, "x", 1, 2), (1, 0, 1, "x", 1, 2), (1, 0, 0, "y", 1, 2), (1, 1, 0, "z", 1, 2)]
    got = [(r.path, r.score) for r in fusion.fuse(spark.createDataFrame(rows, ARMS)).orderBy("rank").collect()]
    assert got == [("x", round(1 / 60 + 1 / 61, 6)), ("y", round(1 / 60, 6)), ("z", round(1 / 60, 6))]
    assert fusion.fuse(spark.createDataFrame([], ARMS)).count() == 0


def test_rerank_head_and_tail(spark):
    df = spark.createDataFrame([(1, n, p, 0.5 - n / 10, s) for n, (p, s) in enumerate([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", 9.0)])] + [(2, 0, "e", 0.7, 5.0)], "query_id int, rank int, path string, score double, rel double")
    got = [(r.query_id, r.path, r.score) for r in fusion.rerank_head(df, F.col("rel"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, "b", 3.0), (1, "c", 3.0), (1, "a", 1.0), (1, "d", pytest.approx(0.2)), (2, "e", 0.7)]


def test_arm_sizes(spark):
    row = spark.range(1).select(fusion.arm_size(F.lit(2), F.lit("hybrid")), fusion.arm_size(F.lit(5), F.lit("hybrid")), fusion.arm_size(F.lit(5), F.lit("lexical")), fusion.arm_size(F.lit(5), F.lit("lexical"), F.lit(20)), fusion.clamp(F.lit(99), 50), fusion.clamp(F.lit(-3), 50)).first()
    assert tuple(row) == (10, 15, 5, 20, 50, 1)


def test_ndcg_and_found(spark):
    ranked = spark.createDataFrame([(1, "tests/test_x.py", 0), (1, "src/x.py", 1), (1, "src/x.py", 2), (2, "q/y.py", 0)], "query_id int, path string, rank int")
    items = spark.createDataFrame([(1, "x.py", None), (2, "y.py", {"y.py": 3.0, "z.py": 1.0}), (3, "none.py", {})], "query_id int, expect string, relevant map<string,double>")
    paths = evaluation.unique_paths(ranked)
    got = {r.query_id: r.ndcg for r in evaluation.ndcg(paths, evaluation.relevance(items)).collect()}
    assert got[1] == pytest.approx(1 / math.log2(3)) and got[3] == 0
    assert got[2] == pytest.approx(3 / (3 + 1 / math.log2(3)))
    s = evaluation.summary(paths, items).first()
    assert (s.n, s.found_at_k, s.precision_at_1) == (3, pytest.approx(2 / 3), pytest.approx(2 / 3))


def test_hash_embedder(spark):
    assert embedding.HashEmbedder(4).embed_query("abc") == pytest.approx([0.492947, -0.303721, 0.081385, 0.811254], abs=1e-6)
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "n int, t string")
    got = {r.n: r.v for r in df.select("n", embedding.embed_column(F.col("t"), lambda: embedding.HashEmbedder(4)).alias("v")).collect()}
    assert got[1] == pytest.approx([0.492947, -0.303721, 0.081385, 0.811254], abs=1e-6) and got[2] is None and len(got[3]) == 4


def test_rerank_rows(spark):
    class Overlap:
        def rerank(self, query, documents):
            return [float(len(set(query.split()) & set(d.split()))) for d in documents]

    df = spark.createDataFrame([("a b", "a b c"), ("a b", "z"), ("q", "q")], "query string, text string")
    assert sorted(r.relevance for r in embedding.rerank_rows(df, Overlap).collect()) == [0.0, 1.0, 2.0]


def test_retry():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert embedding.with_retry(call, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        embedding.with_retry(lambda: (_ for _ in ()).throw(OSError()), sleep=waits.append)
    assert waits[2:] == [2.0, 4.0, 8.0, 16.0, 32.0]


def test_hosted_embedder_speaks_the_public_interface():
    import json

    from lakelens.config import Settings

    sent = []

    def post(url, headers, body):
        sent.append((url, headers, json.loads(body)))
        return json.dumps({"embeddings": [{"values": [0.5, 1]} for _ in sent[-1][2]["requests"]]}).encode()

    model = embedding.HostedEmbedder(embedding.GoogleTransport("key", "m1", 2, post), 2)
    assert model.embed_documents(["a", "b"]) == [[0.5, 1], [0.5, 1]] and model.embed_documents([]) == [] and model.embed_query("q") == [0.5, 1]
    assert sent[0][0].endswith("/models/m1:batchEmbedContents") and sent[0][1]["x-goog-api-key"] == "key"
    assert [r["taskType"] for r in sent[0][2]["requests"]] == ["RETRIEVAL_DOCUMENT"] * 2 and sent[-1][2]["requests"][0]["taskType"] == "RETRIEVAL_QUERY"
    with pytest.raises(ValueError, match="gemini_api_key"):
        embedding.make_embedder(Settings(embedder="gemini"))
    assert embedding.make_embedder(Settings(embedder="gemini", gemini_api_key="k", embed_dim=7)).dim == 7


def test_benchmark_model_takes_texts_and_titled_entries():
    model = embedding.BenchmarkModel(embedding.HashEmbedder(4))
    plain = embedding.HashEmbedder(4)
    assert model.encode_queries(["q", "r"]) == [plain.embed_query("q"), plain.embed_query("r")]
    assert model.encode_corpus([{"title": "t", "text": "x"}, "y", {"text": "z"}], batch_size=2) == [plain.embed_query(t) for t in ("t\nx", "y", "z")]


def test_text_rank_counts_presence_and_repeats(spark):
    df = chunks(spark, [("lock", "redis lock lock"), (None, "redis only"), ("redis", "nothing here"), (None, None), (None, "lock " * 400)])
    asked = spark.createDataFrame([(0, "Lock the redis"), (1, "!!!"), (2, "")], "query_id int, query string")
    got = {r.chunk_pos: r.score for r in lexical.text_rank(df, asked, 5).collect()}
    one = 0.1 / 1.64493406685
    many = one * sum(1 / n**2 for n in range(1, 256))
    assert got == pytest.approx({0: (one * 1.25 + one) / 3, 1: one / 3, 4: many / 3}, abs=1e-6)
    assert lexical.text_rank(df.limit(0), asked, 5).count() == 0
