"""Near-duplicate groups by exact Jaccard similarity of five-word shingles.

Candidates come from two indexes.  SimHash fingerprints of the shingles meet in the byte-position inverted index with count
filtering (see ``simhash``), which finds every pair of up to four differing bits, the closest copies.  At a similarity of
0.8 fingerprints differ in some ten bits; such pairs meet by min-hashes: texts that agree in all ROWS minima of one of BANDS
bands, which a pair of similarity s does with chance 1 - (1 - s**ROWS)**BANDS, 0.9999 at 0.8 and more above.  The texts of each
set of connected candidates are then read once, and the whole shingle sets of every two of them are counted against each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm import simhash
from loftline.llm.common import settled, text_of
from loftline.llm.components import components

#: Words of a shingle, and the least similarity of two texts of a group as a fraction.
WORDS, NEAR = 5, (4, 5)
BANDS, ROWS = 24, 5
#: Members of one set of candidates that a single cell compares; larger sets are cut into blocks, cells are pairs of blocks.
BLOCK = 512
#: Nodes that are broadcast at most: 30 bytes each.
BROADCAST = 500_000

_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles; a text without words has one shingle of its own kind."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(parts) - words + 1)
    return np.array(list({xxhash.xxh64_intdigest(b" ".join(parts[i:i + words])) for i in range(n)}), np.uint64)


def bands(own: np.ndarray) -> np.ndarray:
    """One signed number for each band of minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):   # a very long text in slices
        least = np.minimum(least, (own[None, at:at + 2048] * _TIMES + _PLUS).min(1))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have at least the similarity NEAR: shared shingles counted by products of incidence columns."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), size)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        s, e = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[row[s:e], column[s:e] - at] = 1
        both += (m @ m.T).astype(np.int64)
    np.fill_diagonal(both, size)
    return both * NEAR[1] >= NEAR[0] * (size[:, None] + size[None, :] - both)


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that connect whatever is connected in a cell; in a cell of two blocks, through pairs of one and the other."""
    near = _similar([shingles(t) for t in pdf["_t"]])
    own = pdf["_b"].to_numpy()
    if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
        near &= own[:, None] != own[None, :]
    np.fill_diagonal(near, True)
    label = np.arange(len(pdf))
    while True:   # each text takes the smallest label among its neighbours
        now = np.where(near, label, len(label)).min(1)
        if (now == label).all():
            break
        label = now
    at = np.flatnonzero(label != np.arange(len(label)))
    node = pdf["node"].to_numpy()
    return pd.DataFrame({"a": node[label[at]], "b": node[at]})


def linked_prints(nodes: DataFrame) -> DataFrame:
    """The rows of nodes with ``_g``: the smallest fingerprint that links of fingerprints lead to from their own, ``fp``."""
    roots = settled(components(simhash.links(nodes.select("fp").distinct()))).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select(*nodes.columns, F.coalesce("root", "fp").alias("_g"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, few_nodes: int = BROADCAST,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, node, root) of every row: rows have one root if a chain of texts links them, each like the next by at
    least NEAR.  The columns in ``keep`` follow.

    Rows with equal texts are one node, named by the text's 64-bit hash.  Null counts as empty; texts without words are
    alike.  Candidates are the links of fingerprints and of bands.  A bucket of min-hashes hands on a row for each member, never its pairs; sets of candidates are compared in blocks.
    Tables of nodes are counted and sent to all tasks while they have at most ``few_nodes`` rows.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_t"), *keep).withColumn("node", F.xxhash64("_t"))
    sent = lambda df: F.broadcast(df) if df.count() <= few_nodes else df

    @F.pandas_udf("array<long>")
    def banded(texts: pd.Series) -> pd.Series:
        return pd.Series([bands(shingles(t)) for t in texts])

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash.fingerprint(t, WORDS) for t in texts], dtype="int64")

    marked = settled(named.select("node", banded("_t").alias("_p"), printed("_t").alias("fp")).groupBy("node").agg(F.first("_p").alias("_p"), F.first("fp").alias("fp")))
    # texts of linked fingerprints meet as those of a band do
    post = linked_prints(marked).select("node", F.explode(F.array_append("_p", F.xxhash64("_g", F.lit("print")))).alias("p"))
    met = post.groupBy("p").agg(F.min("node").alias("m"), F.max("node").alias("last")).filter("m <> last").select("p", "m")
    sets = settled(components(post.join(met, "p").filter("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")).distinct()))
    size = sets.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_k"))
    members = (sets.join(size, "root").withColumn("_b", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_k")).cast("int")))
    texts = named.select("node", "_t").join(sent(sets.select("node")), "node").groupBy("node").agg(F.first("_t").alias("_t"))
    cells = (texts.join(members, "node").select("root", "node", "_t", "_b", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_j"))
             .select("root", "node", "_t", "_b", F.least("_b", "_j").alias("i"), F.greatest("_b", "_j").alias("j")))
    links = cells.groupBy("root", "i", "j").applyInPandas(_cell, "a long, b long").distinct()
    roots = settled(components(links))
    return (named.drop("_t").join(sent(roots), "node", "left")
            .select("doc_id", "node", F.coalesce("root", "node").alias("root"), *keep))
