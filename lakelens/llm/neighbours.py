"""Most similar vectors for every vector: coarse cells, score-aware four-bit codes, exact reranking.

Unit vectors are spread over coarse cells; every vector is searched in the few cells nearest to it and in every further one
within a margin of the nearest, which is settled on a sample so that the cells of a dense group are all searched. Within a cell the base
vectors are product-quantised with four bits per subspace under an anisotropic loss, which weighs the error parallel to
the vector more than the rest. Scores are read from tables, two codes at a time. A pair whose cosine reaches the threshold
has a table score of at least ``threshold - |parallel error| - sin * |orthogonal error|``: this bound, kept per base vector,
makes the scan lose nothing; what passes it is scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.session import shuffle_partitions

DIM, K, THRESHOLD = 64, 5, 0.9
#: Vectors the quantisers are fitted on, at most; every vector is indexed.
SAMPLE = 50_000
CELL, CELLS, PROBES = 3_000, 16_384, 4
_SUB, _CODES = 16, 16  # subspaces, codes of one (four bits)
_QUERIES, _BASE = 128, 20_000  # rows scanned at a time, and rows of one task's share of a crowded cell
_ASKED = 60_000  # vectors searched by one task in (a block of) a cell
_PLACED = 150_000  # placed rows of one scan partition, about 50 MB
#: Sampled vectors that margins are settled on, share of their neighbours that a margin must reach, and its least width: in
#: standard deviations of how far a vector at the threshold lies over in a given direction, where no direction is favoured.
_TRIED, _REACHED, _WIDTH = 5_000, 0.999, 2.5
_SCORES = 1 << 22  # scores against centres held at a time
_ROW = "pos long, vec binary"


def usable_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_pos, vector) to (pos, vec as float32 bytes) of the usable vectors."""
    for batch in batches:
        vectors, pos = batch.column(1), batch.column(0)
        ok = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), DIM), False)) & np.asarray(pos.is_valid())
        kept = vectors.filter(pa.array(ok))
        matrix = np.asarray(kept.flatten().fill_null(float("nan")), np.float32).reshape(-1, DIM)
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        ids = np.asarray(pos.filter(pa.array(ok)).cast(pa.int64()))[good]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in matrix[good]], pa.binary())], names=["pos", "vec"])


def _matrix(column: pd.Series | list) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, DIM)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def fit_cells(unit: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; above 512 cells in two levels."""
    rng = np.random.default_rng(7)

    def means(x: np.ndarray, k: int) -> np.ndarray:
        centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
        for _ in range(rounds):
            near = np.concatenate([(x[a : a + 4096] @ centre.T).argmax(axis=1) for a in range(0, len(x), 4096)])
            sums = np.zeros_like(centre)
            np.add.at(sums, near, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centre = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centre)
        return centre

    x = unit.astype(np.float32)
    if not len(x):
        return np.eye(1, DIM, dtype=np.float32)
    if cells <= 512:
        return means(x, cells)
    top = means(x, int(cells**0.5))
    near = (x @ top.T).argmax(axis=1)
    parts = [means(x[near == t], max(1, round(cells * (near == t).mean()))) for t in range(len(top)) if (near == t).any()]
    return np.concatenate(parts)


def _weights(threshold: float = THRESHOLD) -> tuple[float, float]:
    """Loss weights of the parallel and the orthogonal error: those with which each enters the bound at the threshold."""
    return 1 / (1 - threshold * threshold), 1.0


def encode(x: np.ndarray, residual: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (n, subspaces) of residuals, by coordinate descent on the anisotropic loss. x: the unit vectors."""
    n, width = len(x), DIM // _SUB
    along, across = _weights()
    xs, rs = x.reshape(n, _SUB, width), residual.reshape(n, _SUB, width)
    codes = np.stack([((rs[:, m, None] - books[m]) ** 2).sum(axis=2).argmin(axis=1) for m in range(_SUB)], axis=1)
    parallel = np.stack([((rs[:, m] - books[m][codes[:, m]]) * xs[:, m]).sum(axis=1) for m in range(_SUB)], axis=1)
    for _ in range(sweeps):
        total = parallel.sum(axis=1)
        for m in range(_SUB):
            left = rs[:, m, None] - books[m]  # (n, codes, width)
            p = (left * xs[:, m, None]).sum(axis=2)
            whole = (total - parallel[:, m])[:, None] + p
            loss = across * (left * left).sum(axis=2) + (along - across) * whole * whole
            codes[:, m] = loss.argmin(axis=1)
            now = p[np.arange(n), codes[:, m]]
            total += now - parallel[:, m]
            parallel[:, m] = now
    return codes.astype(np.uint8)


def fit_books(x: np.ndarray, residual: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Codebooks (subspaces, codes, width) minimising the anisotropic loss."""
    n, width = len(x), DIM // _SUB
    rng = np.random.default_rng(11)
    along, across = _weights()
    xs, rs = x.reshape(n, _SUB, width), residual.reshape(n, _SUB, width)
    books = np.stack([rs[rng.choice(n, _CODES, replace=n < _CODES), m] + rng.normal(0, 1e-4, (_CODES, width)) for m in range(_SUB)])
    for _ in range(rounds):
        codes = encode(x, residual, books, 1)
        parallel = np.stack([((rs[:, m] - books[m][codes[:, m]]) * xs[:, m]).sum(axis=1) for m in range(_SUB)], axis=1)
        for m in range(_SUB):
            others = parallel.sum(axis=1) - parallel[:, m]
            for c in range(_CODES):
                mine = codes[:, m] == c
                if not mine.any():
                    continue
                a, r = xs[mine, m], rs[mine, m]
                target = others[mine] + (r * a).sum(axis=1)
                left = across * mine.sum() * np.eye(width) + (along - across) * a.T @ a
                books[m, c] = np.linalg.solve(left, across * r.sum(axis=0) + (along - across) * a.T @ target)
    return books


def _gaps(scores: np.ndarray, own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far each vector would have to move to lie in each cell: distance from the plane between that cell and its own."""
    which, inverse = np.unique(own, return_inverse=True)
    square = (centres * centres).sum(axis=1)
    apart = np.sqrt(np.maximum(square + square[which][:, None] - 2 * centres[which] @ centres.T, 1e-6))
    return (scores[np.arange(len(own)), own][:, None] - scores) / apart[inverse]


def fit_margins(unit: np.ndarray, near: np.ndarray, centres: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """By cell, the gap up to which its vectors are searched in other cells.

    At least the width above and what ``_REACHED`` of the sampled neighbours need, more for a cell whose own ones need more.
    """
    tried = np.random.default_rng(13).choice(len(unit), min(_TRIED, len(unit)), replace=False)
    x, step, owners, needed = unit.astype(np.float32), max(1, _SCORES // max(len(unit), len(centres), 1)), [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for a in range(0, len(tried), step):
        t = tried[a : a + step]
        cosine = x[t] @ x.T
        cosine[np.arange(len(t)), t] = -2
        top = min(k, len(x) - 1)
        best = np.argpartition(-cosine, top - 1, axis=1)[:, :top] if top > 0 else np.zeros((len(t), 0), np.int64)
        at, rank = np.nonzero(np.take_along_axis(cosine, best, axis=1) >= threshold)
        owners.append(near[t[at]])
        needed.append(_gaps(x[t] @ centres.T, near[t], centres)[at, near[best[at, rank]]])
    owner, need = np.concatenate(owners), np.concatenate(needed)
    least = _WIDTH * np.sqrt((2 - 2 * threshold) / (DIM - 1))
    margins = np.full(len(centres), max(least, np.quantile(need, _REACHED) if len(need) else 0), np.float32)
    np.maximum.at(margins, owner, need.astype(np.float32) * np.float32(1.0001))
    return margins


def probed(unit: np.ndarray, centres: np.ndarray, margins: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(own cell of each vector, (vectors, cells) whether it is searched there): the nearest cells and all within its margin."""
    scores, p = unit.astype(np.float32) @ centres.T, min(probes, len(centres))
    own = scores.argmax(axis=1)
    asked = _gaps(scores, own, centres) <= margins[own][:, None]
    np.put_along_axis(asked, np.argpartition(-scores, p - 1, axis=1)[:, :p], True, axis=1)
    asked[np.arange(len(own)), own] = True
    return own, asked


class Cell:
    """The coded base vectors of (a block of) one cell."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, centre: np.ndarray, books: np.ndarray, threshold: float):
        self.ids, self.unit, self.books, self.centre = ids, _unit(raw), books, centre.astype(np.float64)
        residual = self.unit - self.centre
        codes = encode(self.unit, residual, books)
        error = residual - np.concatenate([books[m][codes[:, m]] for m in range(_SUB)], axis=1)
        along = (error * self.unit).sum(axis=1)
        across = np.sqrt(np.maximum((error * error).sum(axis=1) - along * along, 0))
        self.least = (threshold - np.abs(along) - np.sqrt(1 - threshold**2) * across - 1e-5).astype(np.float32)
        self.pairs = codes[:, 0::2].astype(np.intp) * _CODES + codes[:, 1::2]

    def search(self, ids: np.ndarray, raw: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, neighbour id, cosine rounded to 6) of the k best others, ties by the smaller id."""
        unit, out = _unit(raw), []
        width = DIM // _SUB
        score = np.empty((len(self.ids), min(_QUERIES, len(ids))), np.float32)
        part = np.empty_like(score)
        for a in range(0, len(ids), _QUERIES):
            q = unit[a : a + _QUERIES]
            tables = np.einsum("mcw,qmw->mcq", self.books, q.reshape(len(q), _SUB, width)).astype(np.float32)
            both = (tables[0::2, :, None] + tables[1::2, None]).reshape(_SUB // 2, _CODES * _CODES, len(q))
            s, t = score[:, : len(q)], part[:, : len(q)]
            if len(q) < score.shape[1]:
                s, t = np.ascontiguousarray(s), np.ascontiguousarray(t)
            np.take(both[0], self.pairs[:, 0], axis=0, out=s)
            for m in range(1, _SUB // 2):
                s += np.take(both[m], self.pairs[:, m], axis=0, out=t)
            s += (q @ self.centre).astype(np.float32)
            b, i = np.nonzero(s >= self.least[:, None])
            other = self.ids[b] != ids[a + i]
            b, i = b[other], i[other]
            exact = np.concatenate([np.zeros(0)] + [np.einsum("nd,nd->n", self.unit[b[x : x + 65536]], q[i[x : x + 65536]]) for x in range(0, len(b), 65536)])
            near = exact >= threshold - 1e-12
            out.append((ids[a + i[near]], self.ids[b[near]], np.round(exact[near], 6)))
        query, base, cosine = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((base, -cosine, query))
        query, base, cosine = query[order], base[order], cosine[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        return query[rank < k], base[rank < k], cosine[rank < k]


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for each of the ``n`` blocks of every row."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def nearest(classes: DataFrame, k: int = K, threshold: float = THRESHOLD, cell: int = CELL, probes: int = PROBES, sample: int = SAMPLE, cells: int = CELLS) -> DataFrame:
    """(id, neighbour, cosine): the k most similar other vectors of each, of those at or above the threshold.

    classes: pos, vec (distinct vectors). The quantisers are fitted on at most ``sample`` vectors. A crowded cell is cut
    into blocks of base and query rows of bounded size, each pair of blocks a task of its own. ``probes`` is the least number
    of cells a vector is searched in; margins add all others that may hold a neighbour. ``cells`` and ``sample`` go together:
    beyond ``cells * cell`` vectors (49 million with the defaults) both should grow with the square root of the input, or
    cells grow instead and with them the work for a vector; the result is the same.
    """
    spark = classes.sparkSession
    total = classes.count()
    drawn = classes.select("vec").sample(fraction=min(1.0, sample / max(total, 1)), seed=17) if total > sample else classes.select("vec")
    raw = _matrix([bytes(r.vec) for r in drawn.collect()])
    unit = _unit(raw)
    centres = fit_cells(unit, min(cells, max(1, round(total / cell)), max(1, len(unit))))
    near = np.concatenate([np.zeros(0, np.int64)] + [(unit[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(unit), 4096)])
    books = fit_books(unit[:20_000], (unit - centres[near])[:20_000]) if len(unit) else np.zeros((_SUB, _CODES, DIM // _SUB))
    crowd = np.bincount(near, minlength=len(centres)) * (total / max(len(unit), 1))
    blocks = np.maximum(1, np.ceil(crowd / _BASE)).astype(np.int64)
    margins = fit_margins(unit, near, centres, k, threshold)
    step = max(1, min(8192, _SCORES // len(centres)))
    asked = sum((probed(unit[a : a + step], centres, margins, probes)[1].sum(axis=0) for a in range(0, len(unit), step)), np.zeros(len(centres)))
    shares = np.maximum(1, np.ceil(np.maximum(asked * (total / max(len(unit), 1)) / _ASKED, crowd / _BASE))).astype(np.int64)
    shipped = spark.sparkContext.broadcast((centres, books, blocks, shares, margins))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, _, blocks, shares, margins = shipped.value
        for pdf in batches:
            for a in range(0, len(pdf), step):
                ids, vec = pdf["pos"].to_numpy()[a : a + step], pdf["vec"].to_numpy()[a : a + step]
                mine, asked = probed(_unit(_matrix(vec)), centres, margins, probes)
                at, where = np.nonzero(asked)
                home = where == mine[at]
                if (blocks == 1).all() and (shares == 1).all():
                    yield pd.DataFrame({"cell": where, "b": 0, "q": 0, "base": home, "query": True, "pos": ids[at], "vec": vec[at]})
                    continue
                # base rows go to their block with every query block, query rows to their block with every base block
                row, other = _spread(blocks[where])
                asking = pd.DataFrame({"cell": where[row], "b": other, "q": ids[at[row]] % shares[where[row]], "base": False, "query": True, "pos": ids[at[row]], "vec": vec[at[row]]})
                row, other = _spread(shares[mine])
                held = pd.DataFrame({"cell": mine[row], "b": ids[row] % blocks[mine[row]], "q": other, "base": True, "query": False, "pos": ids[row], "vec": vec[row]})
                yield pd.concat([asking, held])

    def scan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        centres, books, *_ = shipped.value
        base, query = pdf[pdf["base"]], pdf[pdf["query"]]
        if not len(base) or not len(query):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        held = Cell(base["pos"].to_numpy(np.int64), _matrix(base["vec"]), centres[key[0]], books, threshold)
        a, b, c = held.search(query["pos"].to_numpy(np.int64), _matrix(query["vec"]), k, threshold)
        return pd.DataFrame({"id": a, "neighbour": b, "cosine": c})

    placed = classes.mapInPandas(assign, "cell long, b long, q long, base boolean, query boolean, pos long, vec binary")
    # the number is given, so that small rows of much work are not gathered into few tasks
    rows = asked.sum() * total / max(len(unit), 1)
    placed = placed.repartition(max(shuffle_partitions(spark), int(rows // _PLACED) + 1), "cell", "b", "q")
    pairs = placed.groupBy("cell", "b", "q").applyInPandas(scan, "id long, neighbour long, cosine double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("neighbour")))), 1, k)
    return pairs.groupBy("id").agg(best.alias("best")).select("id", F.explode("best").alias("x")).select("id", "x.neighbour", (-F.col("x.c")).alias("cosine"))


def similar_pairs(chunks: DataFrame, stage: Callable[[DataFrame, str], DataFrame], k: int = K, threshold: float = THRESHOLD, **index: int) -> DataFrame:
    """Pairs of rows of which either is among the other's k most similar, with cosine at or above the threshold.

    chunks: chunk_pos, vector. Rows with a NULL, short, long, zero or non-finite vector never occur. Equal vectors form one
    class, searched once: of a class only the k + 1 smallest positions can be anyone's neighbours, so a class of any size
    adds k pairs for each member. Ties go to the smaller position. Result: chunk_pos_a < chunk_pos_b.
    """
    key = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2")]
    rows = chunks.select("chunk_pos", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(usable_rows, _ROW).select("pos", "vec", *key)
    by_class = "PARTITION BY h1, h2 ORDER BY pos"
    heads = stage(
        rows.withColumn("rn", F.expr(f"row_number() OVER ({by_class})"))
        .where(F.col("rn") <= k + 1)
        .withColumn("cid", F.expr(f"first(pos) OVER ({by_class})"))
        .select("h1", "h2", "cid", "pos", F.when(F.col("rn") == 1, F.col("vec")).alias("vec"), "rn"),
        "vector-classes",
    )
    classes = heads.where("rn = 1").select("pos", "vec")
    found = nearest(classes, k, threshold, **index)
    own = heads.select(F.col("cid").alias("id"), "pos", F.lit(1.0).alias("cosine"))
    others = found.join(heads.select(F.col("cid").alias("neighbour"), "pos"), "neighbour").select("id", "pos", "cosine")
    # for every class the k + 1 best positions: a member takes the first k that are not itself
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "pos"))), 1, k + 1), lambda x: x.pos)
    ranked = others.unionByName(own).groupBy("id").agg(best.alias("best")).where(F.size("best") > 1)
    members = rows.select("h1", "h2", "pos").join(heads.where("rn = 1").select("h1", "h2", F.col("cid").alias("id")), ["h1", "h2"])
    taken = members.join(ranked, "id").select("pos", F.explode(F.slice(F.filter("best", lambda x: x != F.col("pos")), 1, k)).alias("other"))
    return taken.select(F.least("pos", "other").alias("chunk_pos_a"), F.greatest("pos", "other").alias("chunk_pos_b")).distinct()
