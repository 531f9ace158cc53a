"""Embedding whitening with exact cross-products from bit slices.

Entries become integers x = floor(256 c).  In a block of rows every dimension is shifted to start at 0 and cut into bit
planes; a plane is packed across the rows into 64-bit words.  The rows that have bit i of one dimension and bit j of
another are counted by AND and popcount, and the counts weighted by 2**(i + j) are the exact cross-product.  Blocks add
up as integers of any length, are centred as integers (n * sum(x y) - sum(x) sum(y)), and only the finished covariance
becomes a float matrix for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.llm.common import settled

SCALE, COMPONENTS = 256, 4
#: Rows packed together; bits of a limb in which long sums travel.
BLOCK, LIMB = 8192, 40
_LONG = 2 ** 63 - 1


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S; column k of ``axes`` is a unit eigenvector, ``values`` their variances, falling."""
    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    widest: int   # largest |x|


def whole(vector: str | Column, scale: int = SCALE) -> Column:
    """x of a vector as array<long>; null for a vector that is null or holds null or non-finite entries."""
    v = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(good, F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, weight) of the bit planes of non-negative x (rows x dimensions); planes without a bit are left out."""
    words, dim, weight = [], [], []
    pad = -len(x) % 64
    x = np.pad(x, ((0, pad), (0, 0)))
    for k in range(int(x.max()).bit_length() if x.size else 0):
        bits = np.packbits((x >> np.uint64(k)).astype(np.uint8) & 1, axis=0, bitorder="little")
        full = np.flatnonzero(bits.any(0))
        words.append(np.ascontiguousarray(bits[:, full].T).view(np.uint64))
        dim.append(full)
        weight.append(np.full(len(full), k))
    return (np.concatenate(words), np.concatenate(dim), np.concatenate(weight)) if words else (np.zeros((0, 1), np.uint64), np.zeros(0, int), np.zeros(0, int))


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the rows of an integer matrix, as Python integers."""
    low = x.min(0)
    words, dim, weight = planes((x - low).view(np.uint64))   # the difference of two longs fits unsigned, also where it wraps
    d = x.shape[1]
    sums, cross = np.zeros(d, object), np.zeros((d, d), object)
    for p in range(len(words)):
        sums[dim[p]] += int(np.bitwise_count(words[p]).sum()) << int(weight[p])
    one = 1 << np.arange(64, dtype=object)
    for p in range(len(words)):   # each pair of planes once; a plane with itself counts once, two planes both ways
        w = weight[p + 1:] + weight[p]
        both = np.bitwise_count(words[p + 1:] & words[p]).sum(1, dtype=np.int64)
        safe = w.max(initial=0) < 55 - len(x).bit_length()   # up to 64 planes of a dimension add up in a long
        add = np.zeros(d, np.int64 if safe else object)
        np.add.at(add, dim[p + 1:], both << w if safe else both.astype(object) * one[weight[p + 1:]] * one[weight[p]])
        cross[dim[p]] += add.astype(object)
        cross[:, dim[p]] += add.astype(object)
        cross[dim[p], dim[p]] += int(np.bitwise_count(words[p]).sum()) << int(2 * weight[p])
    low, n = low.astype(object), len(x)
    raw = cross + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return sums + n * low, raw


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def moments(fit: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    """(n, sums, cross-products, largest |x|) of the rows ``x``: a partition sends its sums, one row for each pair of dimensions.

    The driver gets d * (d + 1) / 2 rows whatever the table's size.
    """
    pairs = [*combinations_with_replacement(range(d), 2)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, wide, sums, cross = 0, 0, np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            m = _matrix(b.column(0), d)
            for at in range(0, len(m), BLOCK):
                s, c = scatter(m[at:at + BLOCK])
                sums, cross, n = sums + s, cross + c, n + len(m[at:at + BLOCK])
                wide = max(wide, abs(int(m[at:at + BLOCK].min())), abs(int(m[at:at + BLOCK].max())))
        if n:
            rows = [(-1, 0, 0, n), (-2, 0, 0, min(wide, _LONG))] + [(-3, a, k, v) for a in range(d) for k, v in enumerate(_limbs(int(sums[a])))]
            rows += [(a, b, k, v) for a, b in pairs for k, v in enumerate(_limbs(int(cross[a, b])))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "limb", "v"])

    got = fit.select("x").mapInArrow(partial, "a long, b long, limb long, v long").groupBy("a", "b", "limb").agg(F.sum("v").alias("v"), F.max("v").alias("m"))
    n, wide, sums, cross = 0, 0, np.zeros(d, object), np.zeros((d, d), object)
    for a, b, limb, v, m in got.collect():
        if a == -1:
            n = v
        elif a == -2:
            wide = m
        elif a == -3:
            sums[b] += v << (LIMB * limb)
        else:
            cross[a, b] += v << (LIMB * limb)
    return n, sums, np.triu(cross) + np.triu(cross, 1).T, wide


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct x of ``df``, and these x, one row each; None where no row remains."""
    rows = df.select(whole(vector, scale).alias("x")).filter("x is not null")
    d = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if d is None or d["d"] == 0:
        return None, rows
    d = d["d"]
    distinct = settled(rows.filter(F.size("x") == d).distinct())
    n, s, c, wide = moments(distinct, d)
    centred = n * c - np.outer(s, s)
    v = np.array([[x / (n * n) for x in row] for row in centred.tolist()], float)   # integer division of any length, rounded once
    e, axes = np.linalg.eigh(v)
    trace = sum(int(centred[k, k]) for k in range(d)) / (n * n)
    return Whitening(n, tuple(int(x) for x in s), axes[:, ::-1][:, :components], e[::-1][:components], trace, wide), distinct


def _scored(model: Whitening):
    """For each row of x: the exact squared deviation, and the projections."""
    n, s, d = model.n, np.array(model.sums, object), len(model.sums)
    reach = n * (model.widest + 1) + max(map(abs, model.sums), default=0)
    exact64 = reach * reach * d <= _LONG
    live = model.values > 1e-12 * max(model.trace, 1e-300)
    to = np.where(live, model.axes / np.sqrt(np.where(live, model.values, 1)), np.nan)

    def rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = x * n - s.astype(np.int64) if exact64 else x.astype(object) * n - s
        total = (off * off).sum(1)
        return total, (off / n).astype(float) @ to
    return rows


def transform(df: DataFrame, model: Whitening | None, vector: str = "embedding", scale: int = SCALE, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns in ``keep``, ``deviation`` (sum over dimensions of (n x - S)**2) and ``whitened`` (array, a number for each
    component) of every row whose vector is whole and as long as the fitted ones.

    A deviation beyond a long is null.  A component without variance has a null in ``whitened``.
    """
    x = df.select(*keep, whole(vector, scale).alias("_x"))
    d = len(model.sums) if model else -1
    x = x.filter(F.size("_x") == d)
    if model is None:
        return x.select(*keep, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    score = _scored(model)

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(xs: pd.Series) -> pd.DataFrame:
        total, out = score(np.stack(xs.to_numpy())) if len(xs) else (np.zeros(0), np.zeros((0, 0)))
        return pd.DataFrame({"deviation": pd.array([int(t) if t <= _LONG else None for t in total], "Int64"),
                             "whitened": [[None if y != y else y for y in row] for row in out.tolist()]})
    return x.withColumn("_p", project("_x")).select(*keep, "_p.deviation", "_p.whitened")


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, over components with variance."""
    score = _scored(model)
    use = [k for k, e in enumerate(model.values) if e > 1e-12 * model.trace]

    @F.pandas_udf("array<double>")
    def project(xs: pd.Series) -> pd.Series:
        return pd.Series(list(score(np.stack(xs.to_numpy()))[1])) if len(xs) else pd.Series([], dtype=object)
    w = distinct.select(project("x").alias("w"))
    pairs = [*combinations_with_replacement(use, 2)]
    if not pairs:
        return 0.0
    got = w.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]) for a, b in pairs]).first()
    return max(abs(g - (a == b)) for g, (a, b) in zip(got, pairs))


def whitened(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component.

    Vectors that are null or hold null or non-finite entries are dropped, and so are vectors of another length than most
    have.  Repeated vectors count once in the fit and come out each.  Null and repeated ids are kept; other columns are
    not looked at.  Fewer dimensions than components give a row for each dimension.  A component without variance has a
    null ``whitened``.  An empty table gives no rows.
    """
    model, distinct = fit(df, vector, components)
    out = transform(df.select(F.col(row_id).alias("vec_id"), F.col(vector).alias("_v")), model, "_v")
    err = identity_error(distinct, model) if model else 0.0
    shares = [float(e / model.trace) if model.trace else 0.0 for e in model.values] if model else []
    return (out.select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
            .select("vec_id", (F.col("_k") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(F.array(*[F.lit(s) for s in shares or [0.0]]), F.col("_k") + 1).alias("explained"), F.lit(float(err)).alias("identity_error")))
