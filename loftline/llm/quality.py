"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed terms: words, pairs of neighbouring words, and character
n-grams inside words with their edges.  A softmax layer on the average gives the classes.  Vectors and layer are
trained together by stochastic gradient descent, one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.llm.common import text_of

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Code points hashed at once: bounds the memory that a very long text takes.
_SLICE = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents that training sees at most; the least hashes of their ids are taken, so the
    choice is the same in every run.  Training gathers that many rows on the driver, nothing else."""

    sample: int = 4000
    bits: int = 16
    dim: int = 10
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 12
    rate: float = 0.6
    seed: int = 7


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _Q
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _terms(c: np.ndarray, s: Settings) -> np.ndarray:
    """Slots of all terms of a piece of text given as code points, which begins and ends with a space."""
    with np.errstate(over="ignore"):
        space = c == 32
        out = []
        inner = np.r_[0, np.cumsum(space)]
        for n in s.grams:
            m = len(c) - n + 1
            if m <= 0:
                continue
            keep = np.flatnonzero(inner[n - 1:n - 1 + m] == inner[1:1 + m])   # no space but at the ends
            h = np.full(len(keep), n, np.uint64)
            for k in range(n):
                h = h * _P + c[keep + k].astype(np.uint64) + np.uint64(1)
            out.append(_slot(h, s.bits))
        at = np.flatnonzero(~space & np.r_[True, space[:-1]])
        if len(at):
            solid = np.flatnonzero(~space)
            place = solid - np.repeat(at, np.diff(np.r_[np.searchsorted(solid, at), len(solid)]))
            power = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max()), _P)])
            h = np.add.reduceat((c[solid].astype(np.uint64) + np.uint64(1)) * power[place], np.searchsorted(solid, at))
            out.append(_slot(h * _P + np.uint64(11), s.bits))
            pair = np.where(h[1:] == h[:-1], np.uint64(13), h[:-1] * _Q + h[1:] * _P)   # a word met again at once is one shared term
            out.append(_slot(pair * _P + np.uint64(17), s.bits))
        return np.concatenate(out) if out else np.empty(0, np.int32)


def _pieces(text: str | None) -> Iterator[np.ndarray]:
    """The whole text in slices that end at a space, so that no term is lost but pairs across a cut."""
    line = f" {' '.join((text or '').split())} "
    at = 0
    while at < len(line) - 1:
        end = line.find(" ", at + _SLICE)
        end = len(line) - 1 if end < 0 else end
        yield np.frombuffer(line[at:end + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        at = end


def _counts(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and the share of its terms in each."""
    total = np.zeros(0, np.int64)
    for c in _pieces(text):
        n = np.bincount(_terms(c, s), minlength=1 << s.bits)
        total = n if not len(total) else total + n
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1, total.sum())).astype(np.float32)


def _packed(at: np.ndarray, share: np.ndarray) -> bytes:
    """Slots as gaps and shares, compressed: an example waits on the driver in a fraction of its size."""
    gaps = np.diff(at, prepend=np.int32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T
    return len(at).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(gaps.tobytes() + share.tobytes())


def _opened(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(b[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(b[4:]) if n else b""
    gaps = np.ascontiguousarray(np.frombuffer(raw[:4 * n], np.uint8).reshape(4, n).T).view(np.uint32)[:, 0] if n else np.empty(0, np.uint32)
    return np.cumsum(gaps, dtype=np.int32), np.frombuffer(raw[4 * n:], np.float32).astype(np.float64)


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray   # slot x dim
    layer: np.ndarray     # dim x class
    bias: np.ndarray      # class
    settings: Settings

    def scorer(self):
        """text -> probability of class 1.  The layer is linear, so its product with each vector is taken once."""
        lean = self.vectors @ (self.layer[:, 1] - self.layer[:, 0])
        base, s = float(self.bias[1] - self.bias[0]), self.settings

        def score(text: str | None) -> float:
            total, n = 0.0, 0
            for c in _pieces(text):
                at = _terms(c, s)
                total, n = total + float(lean[at].sum(dtype=np.float64)), n + len(at)
            return float(1 / (1 + np.exp(-np.clip(base + total / max(1, n), -60, 60))))
        return score


def train(rows: list[tuple[bytes, int]], s: Settings) -> Model:
    """Stochastic gradient descent over (packed slots and shares, label) rows, each opened when its turn comes; classes weigh alike."""
    rng = np.random.default_rng(s.seed)
    v = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim))
    w, b = np.zeros((s.dim, 2)), np.zeros(2)
    n = np.bincount([y for _, y in rows], minlength=2)
    weight = np.sqrt(len(rows) / (2 * np.maximum(1, n)))
    total, done = max(1, s.epochs * len(rows)), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            (at, share), y = _opened(rows[k][0]), rows[k][1]
            step = s.rate * (1 - done / total) * weight[y]
            done += 1
            mean = share @ v[at]
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= step * np.outer(mean, p)
            b -= step * p
            v[at] -= step * np.outer(share * len(at) ** 0.5, back)   # shares are small where terms are many
    return Model(v.astype(np.float32), w.astype(np.float32), b.astype(np.float32), s)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "quality") -> Model:
    """Train on at most ``s.sample`` labelled documents that are not held out.

    Rows with a null id or label give no example; labels that disagree on a document count by their mean, a tie as 0.
    A document met in several rows is one example for each different text.  Without labels the model is indifferent.
    """
    marks = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg(label) > 0.5).cast("int").alias("_y")))
    told = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")   # ids alone: texts of others stay where they are
    ids = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    known = docs.select("doc_id", text_of().alias("_t")).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "_t"])   # s.sample rows at most are sent

    @F.pandas_udf("slots binary, shares binary, packed binary")
    def counted(texts: pd.Series) -> pd.DataFrame:
        got = [_counts(t, s) for t in texts]
        return pd.DataFrame({"slots": [a.tobytes() for a, _ in got], "shares": [b.tobytes() for _, b in got], "packed": [_packed(a, b) for a, b in got]})

    seen = known.select("doc_id", "_y", counted("_t").alias("f")).select("doc_id", "_y", "f.*")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("slots", "shares"))   # among the different texts of an id
    rows = seen.select("doc_id", F.col("_y").cast("int").alias("_y"), "packed", place.alias("_n")).orderBy(F.xxhash64("doc_id"), "doc_id", "_n").limit(s.sample)
    return train([(bytes(r.packed), r._y) for r in rows.select("packed", "_y").toLocalIterator()], s)


def held_out(doc_id: Column) -> Column:
    """One id in five, by the checksum of its digits, is kept from training; so is a null one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Every row with the probability that its whole text is of class 1.

    The score depends on the text alone: equal texts score alike; null and empty texts, without terms, score by the
    bias of the layer.  A column that is already called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)   # 2**bits x dim floats, whatever the data

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")
    return docs.withColumn(out, score(text_of(text)))
