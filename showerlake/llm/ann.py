"""Exact top-k inner products by a block matrix join.

Queries and candidates are dealt into blocks by a hash; every pair of a query block and
a candidate block is one tile, one task's work of bounded size. In a tile vectors are int8
codes with a scale each; the integer products (exact in float32 matrix code up to 1,024
components, in float64 beyond) give an approximate score with a proven error bound. A
pair is recomputed in double precision only if its upper bound reaches the
k-th largest lower bound of its query. The tiles' results are merged by a heap for each query.

A query's own rows are all rows with its vec_id; query rows that agree in vec_id and vector are
searched once. Vectors that are null, empty, zero, or hold null or
non-finite components take no part; candidates of another length than the query are no
candidates of it. Ties go to the smaller vec_id. Fewer than k candidates: all of them. An empty
table gives no rows. Rows that are repeated are candidates each; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each vector, the length of its rounding error and its own length."""
    v = v.astype(np.float64)
    scale = np.abs(v).max(1) / 127
    with np.errstate(divide="ignore", invalid="ignore"):
        codes = np.rint(np.where(scale[:, None] > 0, v / scale[:, None], 0)).clip(-127, 127).astype(np.int8)
    error = np.sqrt(((v - codes * scale[:, None]) ** 2).sum(1))
    return codes, scale, error, np.sqrt((v**2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up component by component in order, so equal pairs give equal values anywhere."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j].astype(np.float64) * b[:, j].astype(np.float64)
    return out


def tile_top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, score) of the k best rows of each query in this tile."""
    q, qs, qe, qn = quantised(queries)
    c, cs, ce, cn = quantised(rows)
    kind = np.float32 if queries.shape[1] <= 1024 else np.float64
    places: list = []
    step = max(1, (1 << 22) // max(1, len(rows)))
    for at in range(0, len(q), step):
        s = slice(at, at + step)
        rough = (q[s].astype(kind) @ c.astype(kind).T).astype(np.float64) * qs[s, None] * cs[None, :]
        # |<v,w> - <v',w'>| <= |v - v'| |w| + |v'| |w - w'|, and the room that double rounding takes
        bound = qe[s, None] * cn[None, :] + (qn[s] + qe[s])[:, None] * ce[None, :]
        bound += 1e-12 * (qn[s, None] * cn[None, :])
        own = query_ids[s, None] == row_ids[None, :]
        low = np.where(own, -np.inf, rough - bound)
        kth = np.partition(low, max(0, low.shape[1] - k), axis=1)[:, max(0, low.shape[1] - k)]
        i, j = np.nonzero((rough + bound >= kth[:, None]) & ~own)
        score = products(queries[s][i], rows[j])
        order = np.lexsort((row_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, np.arange(len(qs[s])))
        keep = np.arange(len(i)) - first[i] < k
        places.append((i[keep] + at, j[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*places, strict=True))


FOUND = "query_id long, query_copy long, vec_id long, score double"


def _tile(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(rows):
        for dim, q in queries.groupby(queries["v"].map(len)):
            c = rows[rows["v"].map(len) == dim]
            if len(c):
                qv, cv = np.stack(q["v"].to_numpy()), np.stack(c["v"].to_numpy())
                i, j, score = tile_top(qv, q["vec_id"].to_numpy(), cv, c["vec_id"].to_numpy(), k)
                out.append(pd.DataFrame({"query_id": q["vec_id"].to_numpy()[i], "query_copy": q["copy"].to_numpy()[i], "vec_id": c["vec_id"].to_numpy()[j], "score": score}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_copy": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query_copy": "int64", "vec_id": "int64"})


def _merge(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    heaps: dict[tuple, list] = {}
    for pdf in batches:
        for q, copy, v, score in zip(pdf["query_id"], pdf["query_copy"], pdf["vec_id"], pdf["score"], strict=True):
            heap = heaps.setdefault((q, copy), [])
            (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -v))
    rows = [(q, rank, -v, score) for (q, _), heap in heaps.items() for rank, (score, v) in enumerate(sorted(heap, reverse=True), 1)]
    yield pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k nearest rows of `vectors` (vec_id, embedding) of each row of `queries`, as query_id, rank, vec_id, score."""
    clean = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    n_vectors, n_queries = vectors.count(), queries.count()
    n_c, n_q = max(1, -(-n_vectors // candidate_block)), max(1, -(-n_queries // query_block))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    q = clean(queries).dropDuplicates(["vec_id", "v"]).withColumn("copy", F.xxhash64("v")).withColumn("qb", block(n_q)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = clean(vectors).withColumn("cb", block(n_c)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    tiles = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
    found = tiles.applyInPandas(lambda a, b: _tile(a, b, k), FOUND)
    return found.repartition("query_id").mapInPandas(lambda b: _merge(b, k), "query_id long, rank int, vec_id long, score double")
