"""Near-duplicate records: chosen-path set similarity join.

Texts become sets of hashed word shingles; equal sets form one class. Independent trees branch the classes: a node picks
1 / threshold minwise functions on average and sends every class to a child for each, keyed by its minwise token there.
Similar classes stay together with a probability that falls only slowly with depth, others part at once. Nodes of few
classes are compared exhaustively, crowded ones are branched further, level by level, and the trees are repeated until the
recall at the threshold is reached. Candidates pass a sketch comparison and are verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, SHINGLE, MIN_WORDS = 0.6, 3, 20
#: Independent trees. At a similarity equal to the threshold one tree keeps a pair to depth 2 with probability 0.62 and to
#: depth 4 with 0.46, so fourteen miss it with 0.000001 and 0.0002. Deeper nodes lose more (one tree keeps 0.21 to depth 14),
#: so none is branched beyond depth 4.
TREES = 14
FUNCTIONS = 88  # minwise functions of a sketch; six for the first two levels of each tree
#: Classes that a node may hold to be compared exhaustively; depth at which crowded nodes are compared in blocks.
NODE, DEPTH = 48, 4
_SLACK = 0.21  # four standard deviations of the sketch's estimate at the threshold
_MASK = (1 << 64) - 1
_RECORD = "pos long, h1 long, h2 long, n int, sketch binary"
Stage = Callable[[DataFrame, str], DataFrame]


def words_column(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and ``_``, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts (joined words) to flat arrays of distinct shingle hashes; word hashes are kept between batches."""

    def __init__(self, size: int = SHINGLE, min_words: int = MIN_WORDS, most_kept: int = 500_000):
        self.size, self.min_words, self.most_kept, self.known = size, min_words, most_kept, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions of texts with enough words, start of each one's shingles, shingles sorted within each text)."""
        if len(self.known) > self.most_kept:
            self.known = {}
        known, kept, ids, lengths = self.known, [], [], []
        for k, text in enumerate(texts):
            words = text.split(" ")
            if len(words) < max(self.min_words, self.size):
                continue
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            ids += [known[w] for w in words]
            kept.append(k)
            lengths.append(len(words))
        w, n = np.array(ids, np.uint64), np.array(lengths, np.int64)
        if not len(n):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = w[: len(w) - self.size + 1].copy()
        for j in range(1, self.size):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15)) + w[j : len(w) - self.size + 1 + j]
        h = _mix(h)
        text_of = np.repeat(np.arange(len(n)), n)[: len(h)]
        inside = np.arange(len(h)) < np.repeat(np.cumsum(n), n)[: len(h)] - self.size + 1
        h, text_of = h[inside], text_of[inside]
        order = np.lexsort((h, text_of))
        h, text_of = h[order], text_of[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (text_of[1:] != text_of[:-1])]
        h, text_of = h[fresh], text_of[fresh]
        return np.array(kept, np.int64), np.searchsorted(text_of, np.arange(len(n))), h


_ODD = _mix(np.arange(1, 2 * FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketches(starts: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """(texts, FUNCTIONS) minwise tokens, 16 bits each."""
    out = np.empty((len(starts), FUNCTIONS), np.uint16)
    for i in range(FUNCTIONS):
        least = np.minimum.reduceat((shingles ^ _ODD[FUNCTIONS + i]) * _ODD[i], starts)
        out[:, i] = (_mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _features(size: int, min_words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(size, min_words)
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                kept, starts, h = shingle(pdf["t"].iloc[a : a + 2000].tolist())
                if not len(kept):
                    continue
                with np.errstate(over="ignore"):
                    h1 = np.add.reduceat(_mix(h), starts).view(np.int64)
                    h2 = np.add.reduceat(_mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
                tokens = sketches(starts, h)
                yield pd.DataFrame({
                    "pos": pdf["pos"].to_numpy()[a + kept], "h1": h1, "h2": h2,
                    "n": np.diff(np.r_[starts, len(h)]).astype(np.int32), "sketch": [r.tobytes() for r in tokens],
                })

    return run


def _tokens(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, FUNCTIONS)


def _child(node: np.ndarray, function: np.ndarray | int, token: np.ndarray) -> np.ndarray:
    f = np.asarray(function, np.uint64)
    return _mix(node * np.uint64(0xD6E8FEB86659FD93) + (f << np.uint64(16)) + token.astype(np.uint64) + np.uint64(1))


def _second(node: np.ndarray) -> np.ndarray:
    """Whether a node picks two functions (2 of 3 nodes) or one: 1.67 on average."""
    return (node >> np.uint64(40)) % np.uint64(3) != 0


def _branch_roots(trees: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The first two levels of all trees: (node, cid) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 4000):
                ids, t = pdf["cid"].to_numpy()[a : a + 4000], _tokens(pdf["sketch"].iloc[a : a + 4000])
                nodes, owners = [], []
                for r in range(trees):
                    root = _mix(np.array([r + 1], np.uint64))
                    for k in range(1 + (r % 3 != 0)):
                        f = (6 * r + k) % FUNCTIONS
                        first = _child(root, f, t[:, f])
                        two = _second(first)
                        for j in range(2):
                            f = (6 * r + 2 + 2 * k + j) % FUNCTIONS
                            leaf = _child(first, f, t[:, f])
                            nodes.append(leaf if j == 0 else leaf[two])
                            owners.append(ids if j == 0 else ids[two])
                yield pd.DataFrame({"node": np.concatenate(nodes).view(np.int64), "cid": np.concatenate(owners)})

    return run


def _branch_deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Children of crowded nodes: each picks its functions by its own key."""
    for pdf in batches:
        if not len(pdf):
            continue
        node, ids, t = pdf["node"].to_numpy(np.int64).view(np.uint64), pdf["cid"].to_numpy(), _tokens(pdf["sketch"])
        each = np.arange(len(node))
        f1 = (node >> np.uint64(3)) % np.uint64(FUNCTIONS)
        f2 = (f1 + np.uint64(1) + (node >> np.uint64(17)) % np.uint64(FUNCTIONS - 1)) % np.uint64(FUNCTIONS)
        two = _second(node)
        one = _child(node, f1, t[each, f1.astype(np.int64)])
        other = _child(node, f2, t[each, f2.astype(np.int64)])[two]
        yield pd.DataFrame({"node": np.concatenate([one, other]).view(np.int64), "cid": np.concatenate([ids, ids[two]])})


def _agree(threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            same = (_tokens(pdf["sa"]) == _tokens(pdf["sb"])).mean(axis=1)
            yield pdf.loc[same >= threshold - _SLACK, ["a", "b"]]

    return run


def _shingle_sets(size: int, min_words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(size, min_words)
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                kept, starts, h = shingle(part["t"].tolist())
                ends = np.r_[starts[1:], len(h)] if len(starts) else starts
                yield pd.DataFrame({"cid": part["pos"].to_numpy()[kept], "sh": [h[s:e].tobytes() for s, e in zip(starts, ends)]})

    return run


def _verify(threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for k, (x, y) in enumerate(zip(pdf["ha"], pdf["hb"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep[k] = common >= threshold * (len(x) + len(y) - common) - 1e-9
            yield pdf.loc[keep, ["a", "b"]]

    return run


def similar_classes(chunks: DataFrame, stage: Stage, threshold: float = THRESHOLD, size: int = SHINGLE, min_words: int = MIN_WORDS, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(members: pos, cid; pairs: a < b of class ids with Jaccard similarity >= threshold).

    A class holds the rows with one shingle set; its id is the least position. Pairs of classes are complete up to the
    trees' recall; every reported pair is verified on whole sets.
    """
    if trees * 6 > FUNCTIONS:
        raise ValueError(f"at most {FUNCTIONS // 6} trees")
    texts = chunks.where(F.col("chunk_pos").isNotNull() & F.col("text").isNotNull()).select(F.col("chunk_pos").cast("long").alias("pos"), words_column(F.col("text")).alias("t"))
    records = stage(texts.mapInPandas(_features(size, min_words), _RECORD), "shingle-records")
    classes = stage(records.groupBy("h1", "h2").agg(F.min("pos").alias("cid"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "shingle-classes")
    members = records.select("h1", "h2", "pos").join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("pos", "cid")

    def shared(rows: DataFrame, depth: int) -> DataFrame:
        """Rows of nodes with two classes or more, and how many; counted map-side first, so a hot node is no task's burden."""
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return stage(rows.join(counts, "node"), f"nodes-{depth}")

    level, depth, lists = shared(classes.mapInPandas(_branch_roots(trees), "node long, cid long"), 2), 2, []
    while True:
        small = level.where(F.col("size") <= NODE)
        lists.append(small.groupBy("node").agg(F.sort_array(F.collect_list("cid")).alias("ids")).select("ids"))
        crowded = level.where(F.col("size") > NODE)
        if crowded.isEmpty():
            break
        if depth >= DEPTH:
            lists.append(_blocks(crowded))
            break
        depth += 1
        deeper = crowded.select("node", "cid").join(classes.select("cid", "sketch"), "cid").mapInPandas(_branch_deeper, "node long, cid long")
        level = shared(deeper, depth)
    ids = lists[0]
    for x in lists[1:]:
        ids = ids.unionByName(x)
    # the same few classes meet in many nodes: equal lists are expanded once
    first = ids.distinct().select("ids", F.posexplode("ids").alias("k", "a"))
    candidates = first.select("a", F.explode(F.slice("ids", F.col("k") + 2, F.greatest(F.size("ids") - F.col("k") - 1, F.lit(0)))).alias("b")).distinct()
    light = classes.select("cid", "n", "sketch")
    compared = (
        candidates.join(light.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(light.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        .where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
        .select("a", "b", "sa", "sb")
    )
    likely = stage(compared.mapInPandas(_agree(threshold), "a long, b long"), "likely-pairs")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("pos")).distinct()
    sets = texts.join(wanted, "pos", "left_semi").mapInPandas(_shingle_sets(size, min_words), "cid long, sh binary").dropDuplicates(["cid"])
    full = likely.join(sets.select(F.col("cid").alias("a"), F.col("sh").alias("ha")), "a").join(sets.select(F.col("cid").alias("b"), F.col("sh").alias("hb")), "b")
    return members, full.select("a", "b", "ha", "hb").mapInPandas(_verify(threshold), "a long, b long")


def _blocks(crowded: DataFrame) -> DataFrame:
    """Classes that share every token down to the last level: compared block with block, no block larger than a node."""
    half = NODE // 2
    blocks = (F.col("size") / half).cast("long") + 1
    placed = crowded.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    spread = placed.select("node", "cid", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return spread.groupBy("node", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).agg(F.sort_array(F.collect_set("cid")).alias("ids")).select("ids")


def similar_rows(chunks: DataFrame, stage: Stage, **parameters: float) -> DataFrame:
    """Pairs of rows (chunk_pos_a < chunk_pos_b) of similar texts, rows of one class included.

    Rows with a NULL key or text and texts under 20 words never occur. Repeated rows of one ``chunk_pos`` count once.
    """
    members, pairs = similar_classes(chunks, stage, **parameters)
    members, pairs = stage(members.distinct(), "shingle-members"), stage(pairs, "similar-classes")
    a, b = members.select(F.col("cid").alias("a"), F.col("pos").alias("pa")), members.select(F.col("cid").alias("b"), F.col("pos").alias("pb"))
    across = pairs.join(a, "a").join(b, "b").select("pa", "pb")
    within = a.join(b, (F.col("a") == F.col("b")) & (F.col("pa") < F.col("pb"))).select("pa", "pb")
    return across.unionByName(within).select(F.least("pa", "pb").alias("chunk_pos_a"), F.greatest("pa", "pb").alias("chunk_pos_b"))


def components(pairs: DataFrame, stage: Stage) -> DataFrame:
    """(id, root): the least id of each connected component, by alternating large-star and small-star steps.

    Every step groups links by a node with map-side distinct links; nothing is gathered beyond counts.
    """
    links = stage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links-0")
    before, k = None, 0
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select("u", F.col("m").alias("v")))
        k += 1
        links = stage(small.distinct(), f"links-{k}")
        now = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.lit(0))).first()
        if now == before:
            break
        before = now
    return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))


def groups(chunks: DataFrame, stage: Stage, **parameters: float) -> DataFrame:
    """One row per row of a text with 20 words or more: chunk_pos, class_id, group_id, n_links (to other classes)."""
    members, pairs = similar_classes(chunks, stage, **parameters)
    pairs = stage(pairs, "similar-classes")
    roots = components(pairs, stage)
    links = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    return (
        members.distinct().join(links, "cid", "left").join(roots.withColumnRenamed("id", "cid"), "cid", "left")
        .select(F.col("pos").alias("chunk_pos"), F.col("cid").alias("class_id"), F.coalesce("root", "cid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
