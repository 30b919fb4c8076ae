import random

import pytest

from lakelens.llm import generated as G
from lakelens.session import stage_table

SCHEMA = "chunk_pos long, project_id string, ref string, path string, start_line int, text string, tool string, ratio int, label string"


def hand(rng, n=25):
    names = ["merge", "lookup", "window", "offset", "render", "policy", "batch"]
    body = [f"    {rng.choice(names)}_{rng.choice(names)} = self.{rng.choice(names)}({rng.choice(names)}, {rng.choice(names)})" if rng.random() < 0.7 else f"    if {rng.choice(names)} is None:\n        return {rng.choice(names)}" for _ in range(n)]
    return f"def {rng.choice(names)}(x):\n" + "\n".join(body)


def minified(rng, n=60):
    return "".join(f"function {rng.choice('abcxyz')}(e,t){{return e.{rng.choice('pqrs')}?t:{rng.choice('abc')}(e,{rng.randrange(999)})}}var {rng.choice('klm')}={rng.randrange(99)};" for _ in range(n))


def table(rng, n=60):
    return "DATA = [\n" + "\n".join("  [" + ", ".join(str(rng.randrange(9999)) for _ in range(8)) + "]," for _ in range(n)) + "\n]"


def corpus(seed):
    """(rows, truth): labelled files with notices, and files without any."""
    rng, rows, truth = random.Random(seed), [], {}

    def add(path, text, found, line=1):
        rows.append((len(rows), "group/own", "HEAD", path, line, text, "", 1, ""))
        truth[path] = found

    for n in range(60):
        add(f"src/own{n}.py", "# Copyright (c) 2023 the own project\n" + hand(rng), False)
        add(f"src/tool{n}.js", "// Code generated by mk v1.2. DO NOT EDIT.\n" + (minified(rng) if n % 2 else table(rng)), True)
    for n in range(40):
        add(f"lib/plain{n}.py", hand(rng), False)
        add(f"lib/packed{n}.js", minified(rng), True)
        add(f"lib/data{n}.py", table(rng), True)
    return rows, truth


def test_held_out_files_without_notices(spark):
    rows, truth = corpus(1)
    got = {r.path: r for r in G.judged(spark.createDataFrame(rows, SCHEMA), stage_table).collect()}
    plain = {p for p in truth if p.startswith("lib/")}
    right = sum(got[p].found == truth[p] for p in plain)
    assert right >= 0.97 * len(plain)
    assert all(got[p].found == truth[p] for p in truth if p not in plain)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// Code generated by x v4. DO NOT EDIT.\nf()", (True, False, False)), ("// <auto-generated> x 2.1 </auto-generated>", (True, False, False)), ("# Autogenerated on build, do not modify by hand (x 5.2)", (True, False, False)),
        ("/*\n * Ce fichier est produit par x, ne pas le modifier à la main.\n */", (True, False, False)), ('"""\nRegenerate with: make x-stubs. Hand edits are lost.\n"""', (True, False, False)),
        ("// Copied from lib 6.4.5 (upstream commit edb34253f141). Keep in sync.", (False, True, False)), ("/*! lib v4.3.3 | (c) 2009 the lib authors | released under a licence */", (False, True, False)), ("# lib 8.13.7 - https://lib.example/  Copyright 2010 lib contributors", (False, True, False)),
        ("# Copyright (c) 2022 the own project\nx", (False, False, True)), ("// generated ids are unique per run; bounded", (False, False, False)), ("// the caller may edit the generated report: now", (False, False, False)), ("# third party means a supplier here", (False, False, False)),
        ('out.write("# Code generated by %s. DO NOT EDIT.\\n" % tool)', (False, False, False)), ("x\n" * 40 + "// Code generated by x v4. DO NOT EDIT.", (False, False, False)), ("", (False, False, False)),
    ],
)
def test_notices(text, want):
    assert G.notices(text, 1, "https://h.example/group/own.git") == want


LICENCE = "".join(f" * Term {n} of the permissions granted to whoever reads along.\n" for n in range(200))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("var a=1;" * 200 + "\n//# sourceMappingURL=a.js.map\n", (True, False, False)), ("a{b:c}" * 200 + "/*# sourceMappingURL=a.css.map */", (True, False, False)),
        ("/*\n" + LICENCE + " * Copied from lib 6.4.5 (upstream commit edb34253f141).\n */\nx", (False, True, False)), ("# Terms of use, line by line.\n" * 40 + "\n# Code generated by x v4. DO NOT EDIT.\nf()", (True, False, False)),
        ("/*! " + "words of a banner " * 40 + "Code generated by x v4. DO NOT EDIT. */ f()", (True, False, False)), ("// " + "words of a banner " * 40 + "copied from lib 6.4.5", (False, True, False)),
        ("x = 1\n" * 100 + "out.write('//# sourceMappingURL=' + name)", (False, False, False)), ("/*! short */" + "f(1);" * 200 + "g('copied from lib')", (False, False, False)),
        ("# a\n" + "x = 1\n" * 40 + "# Code generated by x v4. DO NOT EDIT.", (False, False, False)), ("- a point\n" * 40 + "- Code generated by x v4. DO NOT EDIT.", (False, False, False)),
    ],
)
def test_notices_beyond_the_first_lines(text, want):
    assert G.notices(text, 1, "https://h.example/group/own.git") == want


def test_lines_of_literals_are_read_once():
    import time

    began = time.perf_counter()
    for line in ("1" * 200_000 + "x", "1+1+" * 50_000 + "x", "[1, 'a', " * 50_000 + "f()", '"a" ' * 50_000 + "x"):
        assert not G._LITERALS.match(line)
    assert G._LITERALS.match("  [1, -2.5e3, 0xff, 'a', null]," * 1000) and G._LITERALS.match("INSERT INTO t (a) VALUES (f())")
    assert time.perf_counter() - began < 5


def test_labels_come_from_header_notices_alone(spark):
    rows, truth = corpus(2)
    bare = [r for r in rows if r[3].startswith("lib/")] + [(900 + n, "group/own", "HEAD", f"vendor/p{n}.js", 1, minified(random.Random(n)), "", 1, "") for n in range(9)]
    got = G.judged(spark.createDataFrame(bare, SCHEMA), stage_table).collect()
    assert {r.chance for r in got} == {0.0}
    assert {r.path for r in got if r.found} == {r.path for r in got if r.placed or r.data} and any(r.data for r in got)


def test_places_and_names(spark):
    rows = [("vendor/x/a.go", True), ("src/third_party/a.py", True), ("node_modules/a/b.js", True), ("src/vendor_payouts/a.py", False), ("shop/vendors/a.py", False), ("package-lock.json", True), ("a/x.min.css", True), ("src/a-1a2b3c4d.js", True), ("a/b.tab.c", True), ("tools/codegen/a.py", False)]
    text = hand(random.Random(0))
    df = spark.createDataFrame([(n, "p", "r", p, 1, text, "", 1, "") for n, (p, _) in enumerate(rows)], SCHEMA)
    got = {r.path: r.placed for r in G.judged(df, stage_table).collect()}
    assert got == dict(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, "a.py", None, None, "", 1, ""), (2, None, None, "a.py", 1, "", "", 1, ""), (3, "p", "r", None, 1, "x", "", 1, ""), (4, "p", "r", "b.py", 1, "y = 1\n" * 40_000, "", 1, ""), (5, "p", "r", "b.py", 1, "y = 1", "", 1, ""), (5, "p", "r", "b.py", 1, "y = 1", "", 1, "")]
    got = [(r.project_id, r.path, r.found) for r in G.judged(spark.createDataFrame(rows, SCHEMA), stage_table).collect()]
    assert sorted(got, key=repr) == [("p", "b.py", False), (None, "a.py", False)]
    assert G.judged(spark.createDataFrame([], SCHEMA), stage_table).count() == 0
