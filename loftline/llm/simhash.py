"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits keep at least four of their eight bytes.  The index files
a fingerprint under (positions, bytes at them); a pair that shares enough byte postings is a candidate, its shared
positional bytes are tallied, pairs under the guaranteed minimum go, the rest are verified bit by bit.

A posting of one single byte holds 1/256 of any corpus, so pairs read from such lists would grow with its square.
Postings are therefore kept for three positions together (24 bits).  Twenty of the 56 triples are enough to lie inside
every set of four positions: with the positions cut into classes of 3, 3 and 2, the triples inside one class and those
with two positions in a class and one in the next.  The tally afterwards is over all eight single positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.llm.common import settled, text_of
from loftline.llm.components import components

#: Members of one posting that a single cell compares; larger postings are cut into blocks, cells are pairs of blocks.
BLOCK = 1024
_CLASSES = ((0, 1, 2), (3, 4, 5), (6, 7))
SHORT = 16


def triples() -> list[tuple[int, int, int]]:
    """Byte positions filed together: each four of the eight positions contain at least one of them."""
    out = []
    for k, own in enumerate(_CLASSES):
        after = _CLASSES[(k + 1) % 3]
        out += list(combinations(own, 3)) + [(*two, one) for two in combinations(own, 2) for one in after]
    return [tuple(sorted(t)) for t in out]


def fingerprint(text: str | None, words: int = 4) -> int:
    """Signed 64-bit SimHash of word shingles; a text without words has 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: only A-Z are lowered, only ASCII white space splits
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        starts, ends = [0], [len(line)]
    else:
        edge = np.cumsum([len(p) + 1 for p in parts]).tolist()
        starts, ends = [0, *edge[:len(parts) - words]], [e - 1 for e in edge[words - 1:]]
    tally, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 32768):   # a very long text is tallied in slices
        h = np.array([xxhash.xxh64_intdigest(line[s:e], 42) for s, e in zip(starts[at:at + 32768], ends[at:at + 32768])], dtype=">u8")
        tally += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits((tally * 2 > n).astype(np.uint8)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) of every row, and the columns in ``keep``."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_t"), *keep).select("doc_id", simhash("_t").alias("fp"), *keep)


def _postings(fp: Column) -> Column:
    byte = lambda p: F.shiftrightunsigned(fp, 56 - 8 * p).bitwiseAND(F.lit(255))
    return F.array(*[F.lit(k << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for k, (a, b, c) in enumerate(triples())])


def _close(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Which exclusive-ors belong to links: tally of equal bytes first, then the bits."""
    equal = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)
    ok = equal >= 8 - max_bits
    ok[ok] = np.bitwise_count(x[ok]) <= max_bits
    return ok


def _linked(cells: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal cells that keep each cell's connected fingerprints connected."""
    cut = np.flatnonzero(np.any(cells[1:] != cells[:-1], axis=1)) + 1
    start, end = np.r_[0, cut], np.r_[cut, len(fps)]
    size = end - start
    a, b = [], []
    left = np.repeat(np.where(size <= SHORT, end, start), size) - np.arange(len(fps))   # rows left in a short run
    for k in range(1, SHORT):
        at = np.flatnonzero(left > k)
        if not len(at):
            break
        ok = at[_close(fps[at] ^ fps[at + k], max_bits)]
        a.append(fps[ok])
        b.append(fps[ok + k])
    for s, e in zip(start[size > SHORT], end[size > SHORT]):
        f = fps[s:e]
        near = np.stack([_close(f ^ x, max_bits) for x in f])
        label = np.arange(len(f))
        while True:   # each fingerprint takes the smallest label among its neighbours
            now = np.where(near, label, len(f)).min(1)
            if (now == label).all():
                break
            label = now
        own = np.flatnonzero(label != np.arange(len(f)))
        a.append(f[label[own]])
        b.append(f[own])
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def links(nodes: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp`` that differ in at most ``max_bits`` (up to 4) bits.

    Not every link comes out, but enough to connect whatever is connected.  A posting with more than ``block``
    members is cut into blocks by hash; each pair of blocks is a cell of its own on some task, so no task holds more
    than two blocks of a hot posting and no cell emits more rows than it has members.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("four equal bytes of eight are sure only for up to 4 bits")
    post = nodes.select("fp", F.explode(_postings(F.col("fp"))).alias("p"))
    shared = post.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("_k")).cast("int")
    cells = (post.join(shared, "p").withColumn("_k", blocks).withColumn("_b", own)
             .select("p", "fp", "_b", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_j"))
             .select("p", F.least("_b", "_j").alias("i"), F.greatest("_b", "_j").alias("j"), "fp"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None   # the last cell of a batch may go on in the next one
        for pdf in batches:
            cell, fp = pdf[["p", "i", "j"]].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
            if held is not None:
                cell, fp = np.concatenate([held[0], cell]), np.concatenate([held[1], fp])
            if not len(fp):
                continue
            keep = int(np.argmax((cell == cell[-1]).all(1)))
            held = cell[keep:], fp[keep:]
            if keep:
                a, b = _linked(cell[:keep], fp[:keep], max_bits)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        if held is not None:
            a, b = _linked(*held, max_bits)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (cells.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
            .mapInPandas(compare, "a long, b long").distinct())


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4,
                block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row: component_id is the smallest doc_id reachable over links, root
    the group's smallest fingerprint as a signed number.  The columns in ``keep`` follow.

    Rows with equal fingerprints, copies of any number among them, are one node of the graph.  A null or empty text
    has fingerprint 0 and links like any other.  A null doc_id is kept; it names a component only where nothing else
    does.  Repeated rows come out once each; other columns are not looked at.  An empty table gives no rows.
    """
    marked = settled(fingerprints(docs, doc_id, text, words, keep))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes, max_bits, block))
    member = roots.withColumnRenamed("node", "fp")
    named = member.join(nodes, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = (nodes.join(member.join(named, "root").select("fp", "root", "component_id"), "fp", "left")
             .select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id")))
    of_fp = settled(of_fp)   # both sides of the last join are then dealt for it alone, and Spark can split a hot fingerprint
    return marked.join(of_fp, "fp").select("doc_id", "fp", "root", "component_id", *keep)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
