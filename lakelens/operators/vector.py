"""Exact cosine top-k: one query as a SQL expression, many queries as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors shipped to the executors at a time, in bytes of double precision.
QUERY_BYTES = 32_000_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; the norms are kept above zero by 1e-12."""
    return _dot(a, b) / ((F.sqrt(_dot(a, a)) + 1e-12) * (F.sqrt(_dot(b, b)) + 1e-12))


def top_k(vectors: DataFrame, query: list[float], k: int, digits: int = 6) -> DataFrame:
    """(id, score) of the k vectors most similar to one query, ties by id: a map and a partial sort."""
    q = F.array(*(F.lit(float(x)) for x in query))
    usable = vectors.where(F.size("vector") == len(query))
    return usable.select("id", F.round(cosine(F.col("vector"), q), digits).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k most similar vectors for each of a stated set of queries.

    vectors: id, vector. queries: query_id, vector. The queries are measured, then shipped in blocks of ``QUERY_BYTES``;
    every partition keeps its own k best per query, so only k rows per query and partition are shuffled. Vectors of
    another length than a query's never match it.
    """
    spark = vectors.sparkSession
    stated = queries.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    size = stated.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0] * 8
    blocks = max(1, -(-size // QUERY_BYTES))
    out = None
    for b in range(blocks):
        mine = stated.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else stated
        by_length: dict[int, tuple[list, list]] = {}
        for row in mine.toLocalIterator():
            ids, rows = by_length.setdefault(len(row.vector), ([], []))
            ids.append(row.query_id)
            rows.append(row.vector)
        shipped = spark.sparkContext.broadcast({n: (np.array(ids, np.int64), _unit(np.array(rows, np.float64))) for n, (ids, rows) in by_length.items()})

        def best(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            kept: pd.DataFrame | None = None
            for pdf in batches:
                found = [kept] if kept is not None else []
                lengths = pdf["vector"].map(lambda v: 0 if v is None else len(v)).to_numpy()
                for n, (ids, unit) in shipped.value.items():
                    part = pdf[lengths == n]
                    if not len(part):
                        continue
                    # einsum adds in the order of the dimensions, so equal vectors get equal scores
                    scores = np.round(unit @ _unit(np.array(part["vector"].tolist(), np.float64)).T, digits)
                    at = part["id"].to_numpy()
                    m = min(k, len(part))
                    edge = -np.partition(-scores, m - 1, axis=1)[:, m - 1]
                    q, i = np.nonzero(scores >= edge[:, None])
                    found.append(pd.DataFrame({"query_id": ids[q], "id": at[i], "score": scores[q, i]}))
                if found:
                    kept = pd.concat(found).sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if kept is not None:
                yield kept

        part = vectors.select("id", "vector").mapInPandas(best, "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
