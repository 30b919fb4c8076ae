import random

from lakelens.operators import chunking as C

FILES = "project_id string, ref string, path string, text string"


def windows(spark, text, n):
    df = spark.createDataFrame([("p", "HEAD", "a.txt", text)], FILES)
    return [(r.start_line, r.end_line, r.text) for r in C.line_windows(df, n).orderBy("start_line").collect()]


def test_line_windows(spark):
    assert windows(spark, "a\nb\nc\nd\ne\n", 2) == [(1, 2, "a\nb"), (3, 4, "c\nd"), (5, 5, "e")]
    assert windows(spark, "", 2) == [] and windows(spark, None, 2) == [] and windows(spark, "\n \n", 5) == []


def test_every_line_is_in_one_window(spark):
    rng = random.Random(5)
    for _ in range(4):
        text = "".join(rng.choice(["x", " ", "\n", "\r\n"]) for _ in range(200))
        lines = text.splitlines()
        got = [k for s, e, _ in windows(spark, text, 7) for k in range(s, e + 1)]
        assert len(got) == len(set(got))
        assert all(k + 1 in got for k, x in enumerate(lines) if x.strip())
        assert [w[2] for w in windows(spark, text, 7)] == [w[3] for w in C.window_rows(text, 7)]


def test_syntax_chunks():
    text = "import a\nimport b\n\ndef f(x):\n    return x\n\n\nclass K:\n    def m(self):\n        pass\n\nX = 1\n"
    assert C.syntax_chunks(text, C.python_nodes, 1000) == [
        (1, 2, "", "import a\nimport b"), (4, 5, "f", "def f(x):\n    return x"), (8, 10, "K", "class K:\n    def m(self):\n        pass"), (12, 12, "", "X = 1"),
    ]


def test_imports_are_packed_to_the_budget_and_large_definitions_split():
    text = "\n".join(f"import module_{n}" for n in range(50)) + "\n\ndef big():\n" + "\n".join(f"    value_{n} = {n}" for n in range(400))
    got = C.syntax_chunks(text, C.python_nodes, 300)
    imports = [c for c in got if c[3].startswith("import")]
    assert len(imports) > 1 and all(len("".join(c[3].split())) <= 300 for c in imports)
    big = [c for c in got if c not in imports]
    assert big[0][2] == "big" and {c[2] for c in big[1:]} == {""}
    covered = sorted(k for c in got for k in range(c[0], c[1] + 1))
    assert covered == sorted(set(range(1, 50 + 2 + 401)) - {51})


def test_decorated_definitions_are_no_definitions():
    text = "@wrap\ndef f():\n    pass\n"
    assert C.syntax_chunks(text, C.python_nodes, 100) == [(1, 3, "", "@wrap\ndef f():\n    pass")]


def test_chunk_files_falls_back_and_reports_errors(spark):
    df = spark.createDataFrame([("p", "HEAD", "a.py", "def f():\n  pass"), ("p", "HEAD", "b.py", "def f(:\n"), ("p", "HEAD", "c.txt", "x\ny"), ("p", "HEAD", "d.py", None)], FILES)
    rows = {r.path: r for r in C.chunk_files(df).collect()}
    assert rows["a.py"].symbol == "f" and rows["b.py"].symbol == "" and rows["c.txt"].end_line == 2
    assert rows["d.py"].error and rows["d.py"].text is None
    assert C.chunk_files(df.limit(0)).count() == 0
