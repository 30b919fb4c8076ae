import random
import re
from itertools import combinations

import numpy as np
import pytest

from lakelens.llm import near_duplicates as N
from lakelens.session import stage_table

SCHEMA = "chunk_pos long, project_id string, ref string, text string, a int, cid int, h1 string"


def frame(spark, texts):
    return spark.createDataFrame([(n, None, None, t, 1, 2, "x") for n, t in texts], SCHEMA)


def shingles(text):
    words = re.findall("[a-z0-9_]+", (text or "").lower())
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) >= 20 else set()


def brute(texts):
    sets = {n: shingles(t) for n, t in texts}
    return {(a, b) for a, b in combinations(sorted(n for n, s in sets.items() if s), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + rng.randrange(2)] = [rng.choice("abcdefgh") * 3] * rng.randrange(2)
    return words


def corpus(seed, families=30, size=8):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(3000)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 40, 150]))]
        texts += [" ".join(edited(rng, base, rng.randrange(0, 9))) for _ in range(size)]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    texts = corpus(seed)
    got = {(r.chunk_pos_a, r.chunk_pos_b) for r in N.similar_rows(frame(spark, texts), stage_table).collect()}
    want = brute(texts)
    assert got <= want and len(got) >= 0.995 * len(want)


def test_odd_rows(spark):
    long = " ".join(f"word{n}" for n in range(60_000))
    base = " ".join(f"t{n}" for n in range(25))
    texts = [(1, None), (2, ""), (3, "too few words"), (4, base), (5, base.upper() + " !!!"), (6, long), (7, long + " more"), (None, base), (8, "same " * 30), (9, "same " * 40)]
    got = {(r.chunk_pos_a, r.chunk_pos_b) for r in N.similar_rows(frame(spark, texts), stage_table).collect()}
    assert got == {(4, 5), (6, 7), (8, 9)}
    assert N.similar_rows(frame(spark, []), stage_table).count() == 0
    assert N.groups(frame(spark, texts[:3]), stage_table).count() == 0


def test_a_hot_group_and_crowded_nodes(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{n}" for n in range(200)]
    texts = list(enumerate([" ".join(base)] * 40 + [" ".join(edited(rng, base, 1)) for _ in range(60)] + [" ".join(f"u{k}_{n}" for n in range(30)) for k in range(30)]))
    monkeypatch.setattr(N, "NODE", 6)
    monkeypatch.setattr(N, "DEPTH", 5)
    got = {(r.chunk_pos_a, r.chunk_pos_b) for r in N.similar_rows(frame(spark, texts), stage_table).collect()}
    want = brute(texts)
    assert got <= want and len(got) >= 0.995 * len(want)


def test_recall_at_the_threshold_within_a_hot_group(spark):
    shared = [f"w{n}" for n in range(300)]
    texts = [(k, " ".join(shared + [f"u{k}_{n}" for n in range(96)])) for k in range(400)]  # every pair has similarity 0.603
    assert N.similar_rows(frame(spark, texts), stage_table).count() >= 0.995 * 400 * 399 / 2


def test_groups_are_components(spark):
    words = [f"w{n}" for n in range(100)]
    chain = [(n, " ".join(words[: 100 - 12 * n] + [f"x{n}_{k}" for k in range(12 * n)])) for n in range(5)]
    texts = chain + [(10, " ".join(f"q{n}" for n in range(30))), (11, " ".join(f"q{n}" for n in range(30)))]
    rows = {r.chunk_pos: r for r in N.groups(frame(spark, texts), stage_table).collect()}
    pairs = brute(texts)
    assert rows[11].class_id == 10 and rows[11].n_links == 0 and rows[10].group_id == 10
    for n in range(5):
        assert rows[n].n_links == sum(n in p for p in pairs)
    linked = {n for p in pairs for n in p if n < 5}
    assert {rows[n].group_id for n in linked} == {min(linked)}


def test_components_of_a_long_path(spark):
    pairs = spark.createDataFrame([(n, n + 1) for n in range(100)] + [(500, 501)], "a long, b long")
    roots = {r.id: r.root for r in N.components(pairs, stage_table).collect()}
    assert all(roots[n] == 0 for n in range(1, 101)) and roots[501] == 500


def test_sketches_estimate_similarity():
    s = N.Shingler()
    a, b = [f"w{n}" for n in range(400)], [f"w{n}" for n in range(100, 500)]
    _, starts, h = s([" ".join(a), " ".join(b)])
    t = N.sketches(starts, h)
    assert abs((t[0] == t[1]).mean() - 298 / 498) < 0.2
    assert np.diff(np.r_[starts, len(h)]).tolist() == [398, 398]
