"""Exact nearest neighbours of a stated query set: block matrix join over int8 tiles with error bounds.

Vectors are scaled to length one and rounded to int8 with a scale of their own.  A tile of queries x candidates is one
product of small whole numbers; with the lengths of what rounding lost it bounds every cosine from both sides.  Pairs
whose upper bound reaches the query's k-th best lower bound survive, are computed again from the original vectors in
double precision, and merged into a heap for each query.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries that meet in one task, and columns of a tile.
CANDIDATES, QUERIES, TILE = 8192, 1024, 2048


def _matrix(rows: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (ids, vectors) of the rows that take part."""
    by: dict[int, list] = {}
    for i, v in zip(rows["vec_id"], rows["embedding"]):
        x = np.asarray(v, dtype=np.float64)
        if len(x) and np.isfinite(x).all() and x.any():
            by.setdefault(len(x), []).append((i, x))
    return {d: (np.array([i for i, _ in r], np.int64), np.stack([x for _, x in r])) for d, r in by.items()}


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (held as floats, whose products and sums stay exact), scale, length of the rounded vector, length lost."""
    big = np.abs(x).max(1, keepdims=True)
    u = x / big
    u = u / np.sqrt((u * u).sum(1, keepdims=True))
    scale = np.abs(u).max(1, keepdims=True) / 127
    q = np.rint(u / scale)
    kind = np.float32 if x.shape[1] <= 1024 else np.float64   # 1024 * 127 * 127 < 2**24
    return q.astype(kind), scale[:, 0], np.sqrt(((q * scale) ** 2).sum(1)), np.sqrt(((u - q * scale) ** 2).sum(1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, adding components in their order, so that equal vectors score alike anywhere."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    with np.errstate(all="ignore"):
        for k in range(a.shape[1]):
            x, y = a[:, k], b[:, k]
            dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
        s = dot / np.sqrt(aa * bb)
        odd = ~np.isfinite(s) | (aa * bb < 1e-280)
    if odd.any():   # squares left the range of doubles: scale first, a power of two loses nothing
        p, q = (np.ldexp(m[odd], -np.frexp(np.abs(m[odd]).max(1))[1][:, None]) for m in (a, b))
        s[odd] = cosine(p, q)
    return np.clip(s, -1.0, 1.0)


def _search(cand: pd.DataFrame, quer: pd.DataFrame, k: int) -> pd.DataFrame:
    heaps: dict[int, list[tuple[float, int]]] = {}
    cs = _matrix(cand)
    for dim, (qid, q) in _matrix(quer).items():
        if dim not in cs:
            continue
        cid, c = cs[dim]
        q8, qs, _, qe = _quantised(q)
        floor = np.full(len(qid), -np.inf)   # the k-th best lower bound so far
        best = np.full((len(qid), k), -np.inf)
        for at in range(0, len(cid), TILE):
            ids, x = cid[at:at + TILE], c[at:at + TILE]
            x8, xs, xn, xe = _quantised(x)
            near = (q8 @ x8.T).astype(np.float64) * qs[:, None] * xs[None, :]
            slack = qe[:, None] * xn[None, :] + xe[None, :] + 1e-9
            own = qid[:, None] == ids[None, :]
            low = np.where(own, -np.inf, near - slack)
            top = -np.partition(-low, min(k, low.shape[1]) - 1, axis=1)[:, :k]
            best = -np.sort(-np.concatenate([best, top], 1), axis=1)[:, :k]
            floor = best[:, k - 1]
            i, j = np.nonzero(~own & (near + slack >= floor[:, None]))
            for s in range(0, len(i), 1 << 16):
                for a, v, score in zip(qid[i[s:s + (1 << 16)]].tolist(), ids[j[s:s + (1 << 16)]].tolist(),
                                       cosine(q[i[s:s + (1 << 16)]], x[j[s:s + (1 << 16)]]).tolist()):
                    h = heaps.setdefault(a, [])
                    if len(h) < k:
                        heapq.heappush(h, (score, -v))
                    elif (score, -v) > h[0]:
                        heapq.heapreplace(h, (score, -v))
    out = [(a, -v, s) for a, h in heaps.items() for s, v in h]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
            candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest cosine for each query, ties to the smaller id.

    ``is_query`` marks the query rows; every other row but those with the query's own id is a candidate, compared in
    blocks: each block of queries meets each block of candidates once, in a task that holds the two.  Nothing is
    broadcast.  Null ids, and vectors that are null, empty, zero or hold null or non-finite components, take no part;
    vectors of different length are not compared.  Rows that repeat id and vector count once;
    an id with several vectors is a candidate with each, and asks with each for one list of k rows.
    """
    rows = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), is_query.alias("_q"))
            .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .dropDuplicates(["vec_id", "embedding"]))
    n, nq = vectors.select(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, qblocks = max(1, math.ceil(n / candidates)), max(1, math.ceil(nq / queries))
    dealt = lambda m: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(m)).cast("int")
    cand = rows.select("vec_id", "embedding", dealt(blocks).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("q"))
    quer = rows.filter("_q").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"), dealt(qblocks).alias("q"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _search(a, b, k)

    found = (cand.groupBy("c", "q").cogroup(quer.groupBy("c", "q"))
             .applyInPandas(meet, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same search written out pair by pair.
ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM g q JOIN g c
      ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
