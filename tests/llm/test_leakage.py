import random
import re

import numpy as np
import pytest

from lakelens.llm import leakage as L
from lakelens.session import stage_table

DOCS, ITEMS = "doc_id long, text string, item_id string, t int", "item_id long, text string, doc_id int"


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(n, t, "x", 1) for n, t in docs], DOCS)
    i = spark.createDataFrame([(n, t, 3) for n, t in items], ITEMS)
    return L.leaks(d, i, stage_table, **more).collect()


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, n=12):
    def grams(t):
        w = words(t)
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    held = [(i, grams(t)) for i, t in items]
    return {(d, i) for d, t in docs if t for g in [grams(t)] for i, h in held if g & h}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é", "lock", "acquire", "Größe", "x1", "9", "orchard", "日本", "manifold"]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 40])))) for n in range(25)]
    docs = []
    for n in range(200):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if n % 3 == 0:
            w = words(rng.choice(items)[1])
            k = rng.randrange(0, max(1, len(w) - 10))
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = w[k : k + rng.choice([11, 12, 13, 30])]
        docs.append((n, rng.choice([" ", "_", ", ", "\n"]).join(text)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_passages_equal_brute_force(spark, seed):
    docs, items = corpus(seed)
    rows = run(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, items)
    texts = dict(docs)
    for r in rows:
        part = (" " + " ".join(words(texts[r.doc_id])) + " ")[r.doc_start : r.doc_end]
        assert r.n_edits == 0 and r.n_words >= 12 and len(part.split(" ")) - 2 >= r.n_words


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = corpus(4)
    monkeypatch.setattr(L, "_HITS", 7)
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, items, block_chars=800)} == brute(docs, items)


def within(text, passage, edits):
    """Whether some part of the text is at most so many edits from the passage: the plain algorithm over all ends."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row) <= edits


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_short_passages_with_edits_are_found_by_shorter_grams(spark, edits):
    rng = random.Random(edits)
    item = "a b c ab d e f g h ab i j k"
    passages = [" " + " ".join(item.split()[k : k + 12]) + " " for k in range(2)]
    docs, must = [], set()
    for n in range(60):
        text, made = list(rng.choice(passages).strip()), rng.randrange(0, 4)
        for _ in range(made):
            at = rng.randrange(1, len(text) - 1)
            text[at : at + rng.choice([0, 1])] = rng.choice(["", "z", "q"])
        docs.append((n, "zz " + "".join(text) + " yy"))
        must |= {n} if made <= edits else set()
    got = {r.doc_id for r in run(spark, docs, [(1, item)], edits=edits)}
    may = {n for n, t in docs if any(within(" " + " ".join(words(t)) + " ", p, edits) for p in passages)}
    # an edit on the space at either end of a passage does not count as within it, and a word that goes takes its space along
    assert must & may and must & may <= got <= may
    assert L.gram_length(L.shortest_passage(L._codes(" " + item + " "), 12), edits) == {0: 16, 1: 8, 2: 8}[edits]


def test_keys_beyond_one_number_are_counted():
    far = np.array([[2**62, 1, 5], [0, 2**40, -(2**61)], [2**62, 1, 5]])
    keys, counts = L._distinct(far, np.array([1, 1, 2]))
    assert keys.tolist() == [[0, 2**40, -(2**61)], [2**62, 1, 5]] and counts.tolist() == [1, 3]


def test_bands_overlap_by_half():
    halves = np.array([[0, 0, 4], [0, 0, 5], [0, 0, 9], [1, 0, 10]])
    got = L.bands(halves, np.array([3, 4, 6, 7]), np.array([6]))
    assert sorted(map(tuple, got.tolist())) == [(0, 0, 4), (0, 0, 8), (0, 0, 9), (1, 0, 9), (1, 0, 10)]
    assert len(L.bands(halves[:0], np.zeros(0, np.int64), np.array([6]))) == 0


def test_too_many_edits_are_refused(spark):
    with pytest.raises(ValueError, match="edits"):
        run(spark, [(1, "x")], [(1, "y")], min_words=2, edits=3)


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, None), (2, ""), (3, passage.upper().replace(" ", "_")), (3, passage), (4, "x " * 150_000 + passage + " y" * 150_000), (None, passage), (5, passage[:-3])]
    items = [(7, passage), (8, None), (None, passage), (9, ""), (7, passage)]
    got = sorted((r.doc_id, r.item_id) for r in run(spark, docs, items))
    assert set(got) == {(3, 7), (4, 7)} and got.count((3, 7)) >= 2
    assert run(spark, docs, []) == [] and run(spark, [], items) == []


def test_small_edits_are_bridged(spark):
    item = "the manifold keeps its orchard until the quiet lantern has been moved by the careful operators of the harbour"
    typo = item.replace("quiet", "quist")
    dropped = item.replace("orchard", "orchrd")
    added = item.replace("lantern", "lanteern")
    docs = [(1, item), (2, typo), (3, dropped), (4, added), (5, typo.replace("careful", "carefxl")), (6, "nothing of the kind " * 10)]
    exact = {r.doc_id: r for r in run(spark, docs, [(1, item)], min_words=19)}
    assert exact.keys() == {1}
    near = {r.doc_id: r for r in run(spark, docs, [(1, item)], min_words=19, edits=1)}
    assert near.keys() == {1, 2, 3, 4}
    assert near[1].n_edits == 0 and {near[n].n_edits for n in (2, 3, 4)} == {1}
    assert {r.doc_id for r in run(spark, docs, [(1, item)], min_words=19, edits=2)} == {1, 2, 3, 4, 5}


def test_the_least_count_is_a_lower_bound():
    rng = random.Random(5)
    text = " " + " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(40)) + " "
    index = L.ItemIndex([(1, text)], 16, 12, 0)
    gaps = [k for k, c in enumerate(text) if c == " "]
    for a, b in zip(gaps, gaps[12:]):
        at, _, place = next(index.hits(L._codes(text[a : b + 1])))
        assert sum(p - q == a for p, q in zip(place, at)) >= index.least[0]
