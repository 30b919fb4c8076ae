import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakelens.llm import splitting as S

SCHEMA = "chunk_pos long, text string, start_line int, end_line int, symbol string, cut string, piece_no string"
LINE = st.one_of(st.just(""), st.text("ab {};\t\r", max_size=30), st.text("xyzé", min_size=30, max_size=90), st.just("def f(x):"), st.just("}"))


def rebuilt(text, pieces):
    out = text[: pieces[0].end]
    for p in pieces[1:]:
        gap = text[len(out) : p.start]
        assert gap in ("", "\n")
        out = out + gap + text[len(out) + len(gap) : p.end]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(LINE, max_size=40).map("\n".join), st.sampled_from([20, 60, 200]))
def test_pieces_fit_and_lose_nothing(text, limit):
    pieces = S.split(text, limit, limit // 4)
    assert rebuilt(text, pieces) == text
    lines = text.split("\n")
    for p in pieces:
        assert S.dense_length(text[p.start : p.end]) <= limit
        assert p.first <= p.last and text.count("\n", 0, p.start) == p.first
    for before, p in zip(pieces, pieces[1:]):
        assert p.end > before.end
        if not p.shared_chars:  # whole lines are shared: two, or as many as fit
            k = p.first + p.shared_lines
            more = p.shared_lines + 1
            need = S.dense_length(lines[k]) if S.dense_length(lines[k]) <= limit else 1
            full = p.shared_lines == 2 or k - more < 0 or sum(S.dense_length(x) for x in lines[k - more : k]) + need > limit
            assert full


@pytest.mark.parametrize(("before", "shared"), [(1_599, 1), (1_590, 10), (1_570, 30), (1_500, 40)])
def test_a_short_first_part_of_a_long_line_is_shared(before, shared):
    text = "a" * (before - 1) + "\na\n" + "b" * 5_000
    pieces = S.split(text)
    assert rebuilt(text, pieces) == text and all(S.dense_length(text[p.start : p.end]) <= 1_600 for p in pieces)
    inside = [p for p in pieces if p.first == 2]
    assert [p.shared_chars for p in inside] == [shared] + [40] * (len(inside) - 1)


def test_long_lines_share_forty_characters():
    text = "a\nb\n" + " ".join(["word"] * 1200) + "\nc\nd"
    pieces = S.split(text)
    inside = [p for p in pieces if p.first == p.last == 2]
    assert len(inside) >= 2 and all(p.shared_chars == 40 for p in inside)
    assert pieces[-1].shared_chars == 40 and text[pieces[-1].start : pieces[-1].end].endswith("\nc\nd")


def test_an_edit_changes_neighbouring_pieces_only():
    lines = [f"    value_{n * 7919 % 1000} = compute({n})" if n % 9 else "def step():" for n in range(600)]
    a, b = "\n".join(lines), "\n".join(lines[:300] + ["    inserted = 1"] + lines[300:])
    one, two = ({t[p.start : p.end] for p in S.split(t)} for t in (a, b))
    assert len(one) > 10 and len(one - two) <= 3 and len(two - one) <= 3


def test_cuts_prefer_natural_boundaries():
    text = "\n".join("\n".join([f"def f{n}():"] + [f"    x_{k} = {n * k}" for k in range(14)] + ["    return x_1", ""]) for n in range(40))
    pieces = S.split(text)
    fresh = [text[p.start : p.end].split("\n")[p.shared_lines] for p in pieces[1:]]
    assert sum(x.startswith("def ") for x in fresh) >= 0.8 * len(fresh)


def test_operator(spark):
    big = "\r\n".join(["x" * 50] * 40)
    rows = [(1, None, 1, 2, "s", "", ""), (2, "", 1, 1, None, "", ""), (3, "y" * 1600, 1, 1, "", "", ""), (4, big, 11, 50, "f", "", ""), (5, "z" * 5000, None, None, None, "", ""), (5, "z" * 5000, None, None, None, "", ""), (None, big, 1, 1, "", "", "")]
    got = S.split_oversized(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.chunk_pos, r.cut) for r in got} == {(4, "whole_lines"), (5, "inside_line")}
    four = sorted((r for r in got if r.chunk_pos == 4), key=lambda r: r.piece_no)
    assert four[0].start_line == 11 and four[-1].end_line == 50 and {r.symbol for r in four} == {"f"}
    assert all(b.start_line == a.end_line - 1 for a, b in zip(four, four[1:])) and four[0].text.endswith("\r")
    assert all(r.start_line == 1 and r.symbol is None for r in got if r.chunk_pos == 5)
    assert sum(r.chunk_pos == 5 and r.piece_no == 0 for r in got) == 2
    assert S.split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0
