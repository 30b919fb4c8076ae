import random

import pytest
from pyspark.sql import functions as F

from lakelens.functions import text as T


def values(spark, inputs, column):
    df = spark.createDataFrame([(n, x) for n, x in enumerate(inputs)], "n int, x string")
    return [r.v for r in df.select("n", column(F.col("x")).alias("v")).orderBy("n").collect()]


def test_lines_like_python(spark):
    odd = ["", "a", "a\n", "a\r\nb", "a\r\r\nb\n", "\n\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "x\n\ny"]
    assert values(spark, odd, T.lines) == [x.splitlines() for x in odd]


def test_dense_length_counts_like_isspace(spark):
    odd = ["", " \t\n", "a b", "\u00a0x\u2003y\u3000", "\x1c\x1f.", "ß ü"]
    assert values(spark, odd, T.dense_length) == [sum(not c.isspace() for c in x) for x in odd]


@pytest.mark.parametrize(
    ("query", "terms"),
    [
        ("GeminiEmbedder embed_content", "content embed embed_content embedder gemini geminiembedder"), ("HTTPServer", "httpserver"),
        ("getHTTPResponse", "get gethttpresponse httpresponse"), ("a1B2", "a1 a1b2 b2"), ("!!!", ""), ("Über", "ber"),
    ],
)
def test_query_terms(spark, query, terms):
    assert values(spark, [query], T.query_terms) == [terms.split()]


def test_tokens_fold_and_split(spark):
    assert values(spark, ["Crème_brûlée acquireLock 3.5", None, "__"], T.tokens) == [["creme", "brulee", "acquirelock", "3", "5"], [], []]


def test_mode(spark):
    shapes = ["acquire_lock()", "SagaOrchestrator.compensate", '"exactly this"', "src/lock/redis.py", "find iPhone", "version 3.5 of the thing", "don't think we can't do it"]
    assert values(spark, shapes, T.select_mode) == ["hybrid"] * len(shapes)
    assert values(spark, ["ACQUIRE_LOCK now please run it", "how do we compensate a failed saga step", "two words", "  "], T.select_mode) == ["semantic", "semantic", "hybrid", "hybrid"]


def test_problems(spark):
    bad = ["", "  \n", "x" * 2001, "a\x00b", "a\x07", "a\tb\n", None, "fine"]
    assert values(spark, bad, T.query_problem) == ["empty", "empty", "too long", "control characters", "control characters", None, "empty", None]
    assert values(spark, ["a\nb", "y" * 513, "group/repo"], T.project_problem) == ["control characters", "too long", None]


def test_fence_and_snippet(spark):
    assert values(spark, ["plain", "a ``` b", "`````"], T.fence) == ["```", "````", "``````"]
    cut = values(spark, ["y" * 1501, "y" * 1500], T.snippet)
    assert cut == ["y" * 1500 + T.TRUNCATED, "y" * 1500]


def test_hosts(spark):
    urls = ["https://Git.Example.com:8443/a/b.git", "git@scm.example:a/b.git", "http://u:p@h.example/x", "group/repo", "git@", None]
    assert values(spark, urls, T.remote_host) == ["git.example.com", "scm.example", "h.example", None, None, None]


def test_content_sha_ignores_line_ends(spark):
    a, b, c = values(spark, ["a\r\nb\r", "a\nb\n", "a\nc\n"], T.content_sha)
    assert a == b != c


def test_suffix(spark):
    assert values(spark, ["a/b.py", "a/.env", "x", "a.b/c", "k.tar.gz"], T.suffix) == [".py", "", "", "", ".gz"]


def test_random_texts_fence_is_never_closed_inside(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("`a\n") for _ in range(40)) for _ in range(50)]
    for text, fence in zip(texts, values(spark, texts, T.fence)):
        assert fence not in text
