"""What changed between consecutive full snapshots.

Rows are reduced to compact fixed-width arrays (128-bit key hash, snapshot position, time, 64-bit row hash), combined within
every batch, hashed once into buckets of a bounded number of rows, sorted in numpy and compared by ``searchsorted`` set
differences. Full values are fetched afterwards, for differing keys only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.session import shuffle_partitions, stage_table

#: Rows of one bucket: about 50 MB of compact arrays.
ROWS_PER_BUCKET = 500_000
#: Snapshots, and differing keys, that are broadcast at most (some 100 MB); more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_COMPACT = "k1 long, k2 long, seq int, snapshot_no int, next_no int, loaded long, row_hash long"
_ABSENT = "\x00"  # stands for NULL inside hashed and joined keys; no path, ref or project holds it
_KINDS = np.array(["added", "removed", "changed"], dtype=object)


def plain_ref(ref: Column) -> Column:
    """NULL and empty mean HEAD."""
    return F.when(ref.isNull() | (ref == ""), F.lit("HEAD")).otherwise(ref)


def plain_path(path: Column) -> Column:
    """Without one leading ``./``."""
    return F.regexp_replace(path, r"^\./", "")


def _latest(k1: np.ndarray, k2: np.ndarray, seq: np.ndarray, loaded: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions, sorted by key and snapshot, of the latest row of each file in each snapshot; ties by the greater hash."""
    order = np.lexsort((row, loaded, seq, k2, k1))
    a, b = order[:-1], order[1:]
    last = np.r_[(k1[a] != k1[b]) | (k2[a] != k2[b]) | (seq[a] != seq[b]), True] if len(order) else np.zeros(0, bool)
    return order[last]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side: of the rows of one file and snapshot within a batch only the latest goes on, however often it was delivered."""
    for batch in batches:
        column = {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names)}
        yield batch.take(pa.array(_latest(*(column[n] for n in ("k1", "k2", "seq", "loaded", "row_hash")))))


def _set_differences(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Differences of one bucket as (k1, k2, snapshot_no, kind code) arrays."""
    k1, k2, seq, no, nxt, loaded, row = (pdf[c.split()[0]].to_numpy(np.int64) for c in _COMPACT.split(", "))
    order = _latest(k1, k2, seq, loaded, row)
    k1, k2, seq, row, no, nxt = (a[order] for a in (k1, k2, seq, row, no, nxt))
    # one number for each key, so that (key, seq) becomes a single sorted array
    fresh = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])] if len(k1) else np.zeros(0, bool)
    key = np.cumsum(fresh) - 1
    span = int(seq.max()) + 3 if len(seq) else 3
    code = key * span + seq
    before = np.searchsorted(code, code - 1)
    has_before = (before < len(code)) & (code[np.minimum(before, len(code) - 1)] == code - 1)
    after = np.searchsorted(code, code + 1)
    has_after = (after < len(code)) & (code[np.minimum(after, len(code) - 1)] == code + 1)
    added = (seq > 0) & ~has_before
    changed = has_before & (row != row[np.minimum(before, len(code) - 1)])
    removed = (nxt >= 0) & ~has_after
    at = np.concatenate([np.flatnonzero(added), np.flatnonzero(removed), np.flatnonzero(changed)])
    kind = np.repeat([0, 1, 2], [added.sum(), removed.sum(), changed.sum()])
    when = np.where(kind == 1, nxt[at], no[at])
    return k1[at], k2[at], when, kind


def _diff_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    k1, k2, when, kind = _set_differences(pdf)
    return pd.DataFrame({"k1": k1, "k2": k2, "snapshot_no": when.astype(np.int32), "change_type": _KINDS[kind]})


def snapshot_changes(files: DataFrame, snapshots: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Files added, removed or changed between consecutive complete snapshots of each index.

    files: project_id, ref, path, sha, snapshot_no, loaded_at. snapshots: project_id, ref, snapshot_no, state.
    Result: project_id, ref, path, snapshot_no (the later one), change_type.

    Defined cases: NULL or empty ``ref`` is HEAD; a NULL project is an index of its own; rows with a NULL path or
    snapshot number are no files; NULL sha equals NULL and differs from any value; of several rows of one file in one
    snapshot the latest ``loaded_at`` holds (NULL earliest, ties by the greater hash of the sha); rows of snapshots that are
    not complete or not listed are ignored; empty tables give no rows; extra columns are ignored.

    One shuffle of compact rows. Snapshots and differing keys are counted and broadcast up to ``broadcast_rows``; more
    snapshots, or more differing keys, are joined by a shuffle.
    """
    spark = files.sparkSession
    index = [F.coalesce(F.col("project_id"), F.lit(_ABSENT)).alias("pid"), plain_ref(F.col("ref")).alias("rf")]
    # position among the complete snapshots of an index; an empty complete snapshot keeps its place
    w = Window.partitionBy("pid", "rf").orderBy("snapshot_no")
    listed = snapshots.where((F.col("state") == "complete") & F.col("snapshot_no").isNotNull())
    meta = (
        listed.select(*index, F.col("snapshot_no").cast("int").alias("snapshot_no"))
        .distinct()
        .withColumn("seq", (F.row_number().over(w) - 1).cast("int"))
        .withColumn("next_no", F.coalesce(F.lead("snapshot_no").over(w), F.lit(-1)))
    )
    if listed.count() <= broadcast_rows:
        meta = F.broadcast(meta)
    path = plain_path(F.col("path"))
    # the two hashes see the fields in another order, which makes 128 independent bits
    k1, k2 = F.xxhash64("pid", "rf", "path"), F.xxhash64(F.lit("lakelens"), "path", "rf", "pid")
    named = files.where(F.col("path").isNotNull() & F.col("snapshot_no").isNotNull()).select(
        *index,
        path.alias("path"),
        F.col("snapshot_no").cast("int").alias("snapshot_no"),
        F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(2**62))).alias("loaded"),
        F.when(F.col("sha").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lower("sha"))).alias("row_hash"),
    )
    compact = named.join(meta, ["pid", "rf", "snapshot_no"]).select(k1.alias("k1"), k2.alias("k2"), "seq", "snapshot_no", "next_no", "loaded", "row_hash")
    # more buckets than partitions, so that their hashes fill the partitions evenly
    buckets = max(-(-files.count() // rows_per_bucket), 4 * shuffle_partitions(spark))
    differing = stage_table(
        compact.mapInArrow(_combine, _COMPACT)
        .withColumn("bucket", F.pmod(F.col("k1"), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .applyInPandas(_diff_bucket, "k1 long, k2 long, snapshot_no int, change_type string"),
        "differing-keys",
    )
    keys = differing.select("k1", "k2").distinct()
    keyed = named.select(k1.alias("k1"), k2.alias("k2"), "pid", "rf", "path")
    small = differing.count() <= broadcast_rows  # a row group's count, nothing is read
    held = keyed.join(F.broadcast(keys), ["k1", "k2"], "left_semi") if small else keyed
    values = held.groupBy("k1", "k2").agg(F.first("pid").alias("pid"), F.first("rf").alias("rf"), F.first("path").alias("path"))
    return differing.join(values, ["k1", "k2"]).select(
        F.nullif(F.col("pid"), F.lit(_ABSENT)).alias("project_id"),
        F.col("rf").alias("ref"),
        "path",
        "snapshot_no",
        "change_type",
    )
