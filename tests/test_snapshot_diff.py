import random
from datetime import datetime, timedelta

import pytest

from lakelens.operators.snapshot_diff import snapshot_changes

FILES = "project_id string, ref string, path string, sha string, snapshot_no int, taken_at timestamp, loaded_at timestamp"
META = "project_id string, ref string, snapshot_no int, state string"
T0 = datetime(2024, 1, 1)


def run(spark, files, meta, **more):
    f = spark.createDataFrame([(p, r, x, s, n, T0, t) for p, r, x, s, n, t in files], FILES)
    m = spark.createDataFrame(meta, META)
    return sorted(map(tuple, snapshot_changes(f, m, **more).collect()), key=repr)


def test_added_removed_changed(spark):
    files = [("p", "HEAD", "a", "1", 1, T0), ("p", "HEAD", "b", "1", 1, T0), ("p", None, "./a", "1", 3, T0), ("p", "", "c", "9", 3, T0), ("p", "HEAD", "a", "AB", 4, T0), ("p", "HEAD", "c", "9", 4, T0)]
    meta = [("p", "HEAD", 1, "complete"), ("p", "HEAD", 2, "aborted"), ("p", None, 3, "complete"), ("p", "", 4, "complete"), ("p", "HEAD", 5, "complete")]
    assert run(spark, files, meta) == [
        ("p", "HEAD", "a", 4, "changed"), ("p", "HEAD", "a", 5, "removed"), ("p", "HEAD", "b", 3, "removed"), ("p", "HEAD", "c", 3, "added"), ("p", "HEAD", "c", 5, "removed"),
    ]


def test_case_nulls_and_last_delivery(spark):
    later = T0 + timedelta(days=2)
    files = [("p", "m", "a", "aB", 1, T0), ("p", "m", "a", "Ab", 2, T0), ("p", "m", "b", None, 1, T0), ("p", "m", "b", None, 2, T0), ("p", "m", "c", None, 1, T0), ("p", "m", "c", "1", 2, T0)]
    files += [("p", "m", "d", "1", 1, T0), ("p", "m", "d", "2", 2, T0), ("p", "m", "d", "1", 2, later), ("p", "m", "e", "1", 1, None), ("p", "m", "e", "2", 1, T0), ("p", "m", "e", "2", 2, None)]
    assert run(spark, files, [("p", "m", 1, "complete"), ("p", "m", 2, "complete")]) == [("p", "m", "c", 2, "changed")]


def test_null_keys_rows_without_snapshot_and_empty_tables(spark):
    files = [(None, "m", "a", "1", 1, T0), (None, "m", None, "1", 1, T0), ("q", "m", "a", "1", None, T0), ("q", "m", "a", "1", 1, T0)]
    assert run(spark, files, [(None, "m", 1, "complete"), (None, "m", 2, "complete"), ("p", "m", 2, "complete")]) == [(None, "m", "a", 2, "removed")]
    assert run(spark, [], [("p", "m", 1, "complete")]) == []
    assert run(spark, files, []) == []


def test_extra_columns_with_clashing_names(spark):
    f = spark.createDataFrame([("p", "m", "a", "1", 1, T0, T0, 5, "x", 7)], FILES + ", k1 int, pid string, seq int")
    m = spark.createDataFrame([("p", "m", 1, "complete", 1, 1), ("p", "m", 2, "complete", 2, 2)], META + ", seq int, loaded int")
    assert [tuple(r) for r in snapshot_changes(f, m).collect()] == [("p", "m", "a", 2, "removed")]


@pytest.mark.parametrize(("seed", "broadcast_rows"), [(1, 1_000_000), (2, 0)])
def test_against_brute_force_over_many_buckets(spark, seed, broadcast_rows):
    rng = random.Random(seed)
    meta = [(p, "m", n, rng.choice(["complete", "complete", "aborted"])) for p in "pq" for n in range(1, 7)]
    files = [(rng.choice("pq"), "m", f"f{rng.randrange(30)}" + "x" * rng.choice([0, 5000]), rng.choice(["a", "A", "b", None]), rng.randrange(1, 7), T0 + timedelta(seconds=n)) for n in range(900)]
    want = []
    for p in "pq":
        complete = [n for q, _, n, s in meta if q == p and s == "complete"]
        lists = [{x: (s or "").lower() or None for q, _, x, s, n, _ in files if q == p and n == no} for no in complete]
        for no, old, new in zip(complete[1:], lists, lists[1:]):
            want += [(p, "m", x, no, "added") for x in new.keys() - old.keys()] + [(p, "m", x, no, "removed") for x in old.keys() - new.keys()]
            want += [(p, "m", x, no, "changed") for x in new.keys() & old.keys() if new[x] != old[x]]
    assert run(spark, files, meta, rows_per_bucket=40, broadcast_rows=broadcast_rows) == sorted(want, key=repr)


def test_one_file_delivered_again_and_again(spark):
    files = [("p", "m", "hot", str(n % 7), 1 + n % 2, T0 + timedelta(seconds=n)) for n in range(30_000)] + [("p", "m", "a", "1", 1, T0), ("p", "m", "hot", None, 2, None)]
    want = [("p", "m", "a", 2, "removed"), ("p", "m", "hot", 2, "changed")]
    assert run(spark, files, [("p", "m", 1, "complete"), ("p", "m", 2, "complete")]) == want
