import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lakelens.llm import packing as P
from lakelens.session import stage_table

SCHEMA = "doc_id long, text string, container string, level int"


def packed(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(parts)
    return P.pack(df, stage_table, **more).collect()


def check(rows, got, capacity):
    loads, pieces = Counter(), defaultdict(list)
    for r in got:
        loads[r.container] += r.n_tokens
        pieces[r.doc_id].append(r)
        assert r.n_tokens <= capacity
    assert all(n <= capacity for n in loads.values())
    assert all(r.load == loads[r.container] for r in got)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t or "")
    assert pieces.keys() == texts.keys()
    for d, own in pieces.items():
        assert sum(r.piece_no == 0 for r in own) == len(texts[d])
        if len(texts[d]) == 1:
            own.sort(key=lambda r: r.piece_no)
            assert [r.piece_no for r in own] == list(range(own[0].n_pieces))
            assert own[0].char_start == 0 and own[-1].char_end == len(texts[d][0])
            assert all(a.char_end == b.char_start for a, b in zip(own, own[1:]))
    return loads


def test_every_document_is_placed_once_and_space_is_used(spark):
    rng = random.Random(1)
    rows = [(n, " ".join(rng.choice(["alpha", "beta", "x_1", "Ünïcödé", "日本"]) for _ in range(rng.choice([3, 60, 200, 900])))) for n in range(400)]
    loads = check(rows, packed(spark, rows), P.CAPACITY)
    assert sum(loads.values()) >= 0.95 * P.CAPACITY * (len(loads) - 1)


def test_oversized_nulls_empty_repeated_and_wide_ids(spark):
    rows = [(1, "日本語 " * 3000), (2, None), (3, ""), (4, "same"), (4, "same"), (None, "no id"), (2**60 + 1, "wide"), (5, "é" * 9000)]
    got = packed(spark, rows)
    check(rows, got, P.CAPACITY)
    assert max(r.n_pieces for r in got if r.doc_id == 1) > 1
    assert {r.n_pieces for r in got if r.doc_id not in (1, 5)} == {1}
    assert packed(spark, []) == []


def test_the_tree_has_several_levels(spark):
    rng = random.Random(2)
    rows = [(n, "word " * rng.choice([5, 30, 70])) for n in range(300)]
    loads = check(rows, packed(spark, rows, parts=9, capacity=100, fan_in=2, least_handed=3), 100)
    assert len({c.split("-")[0] for c in loads}) >= 2


def test_bins_not_handed_up_cost_no_merge(spark):
    rng = random.Random(3)
    rows = [(n, "word " * rng.choice([58, 66, 71, 90])) for n in range(900)] + [(2000 + n, "word " * rng.choice([20, 30, 38])) for n in range(6)]
    few, many = (len(check(rows, packed(spark, rows, capacity=100, fan_in=2, least_handed=n), 100)) for n in (1, 10_000))
    assert few == many


def test_two_sizes_in_any_order_reach_the_ideal(spark):
    rows = [(n, "word " * (59 if n < 4000 else 39)) for n in range(8000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).coalesce(2)
    loads = check(rows, P.pack(df, stage_table, capacity=100).collect(), 100)
    assert len(loads) <= 1.02 * 4000


def test_kinds_stored_apart_fill_each_other(spark):
    rows = [(n, "word " * (58 if n < 1500 else 38)) for n in range(3000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).coalesce(2)
    loads = check(rows, P.pack(df, stage_table, capacity=100).collect(), 100)
    assert sum(loads.values()) >= 0.93 * 100 * len(loads)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit(sizes):
    bins = P.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    halves = [b for b in bins if sum(sizes[i] for i in b) <= 25]
    assert len(halves) <= 1
