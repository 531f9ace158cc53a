"""Packing tokenised documents into sequences: swap-based local search over underfull bins.

Documents are cut into pieces of at most one sequence, pieces are dealt evenly into groups of bounded size, and each
group is packed by a task of its own.  Every group wastes less than one sequence against its own lower bound as a
rule, so the whole comes near the bound at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm.common import settled, text_of

LENGTH, GROUP, END_ID = 2048, 8192, 0
#: Local search gives up on a bin after this many exchanges that did not empty it.
TRIES = 400


def _encoder(vocabulary: str):
    """text -> ids of the byte-level vocabulary in a tokenizer file.

    The ids equal those that the file's own library gives; its merges are handed to the faster encoder for the same
    scheme.  A special token written in a text is that token, as there.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    spec = json.loads(open(vocabulary, encoding="utf-8").read())
    # byte-level files write bytes as printable characters: the printable ones stand for themselves, the rest follow from U+0100
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(char[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, END_ID added.

    Only documents over ``length`` are cut, so that every piece but the first is full.  Null text counts as empty and
    gives one piece of the end id alone.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["_t"]):
                ids = np.array([*encoder.encode(text, allowed_special="all"), END_ID], "<u4")
                first = (len(ids) - 1) % length + 1
                at = [0, *range(first, len(ids) + 1, length)]
                out += [(doc_id, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(at, at[1:]))]
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    return (docs.select(F.col("doc_id").cast("long"), text_of().alias("_t"))
            .mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long"))


class _Bins:
    """Bins of one group with their free room; items are places in ``size``."""

    def __init__(self, size: list[int], length: int):
        self.size, self.length = size, length
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[set[int]] = [set() for _ in range(length + 1)]
        self.mask = 0   # bit f: some bin has f free

    def _room(self, b: int, f: int) -> None:
        old = self.by_free[self.free[b]]
        old.discard(b)
        if not old:
            self.mask &= ~(1 << self.free[b])
        self.free[b] = f
        self.by_free[f].add(b)
        self.mask |= 1 << f

    def open(self) -> int:
        self.items.append([])
        self.free.append(self.length)
        self.by_free[self.length].add(len(self.items) - 1)
        self.mask |= 1 << self.length
        return len(self.items) - 1

    def put(self, i: int, b: int) -> None:
        self.items[b].append(i)
        self._room(b, self.free[b] - self.size[i])

    def take(self, i: int, b: int) -> None:
        self.items[b].remove(i)
        self._room(b, self.free[b] + self.size[i])

    def close(self, b: int) -> None:
        """Sets an empty bin aside."""
        self.by_free[self.free[b]].discard(b)
        if not self.by_free[self.free[b]]:
            self.mask &= ~(1 << self.free[b])

    def tightest(self, w: int, but: int = -1) -> int:
        """The bin with the least room that still takes w, or -1."""
        m = self.mask >> w << w
        while m:
            f = (m & -m).bit_length() - 1
            for b in self.by_free[f]:
                if b != but:
                    return b
            m &= m - 1
        return -1

    def underfull(self, but: int) -> Iterator[int]:
        m = self.mask & ~1
        while m:
            f = (m & -m).bit_length() - 1
            yield from [b for b in self.by_free[f] if b != but]
            m &= m - 1


def pack(size: list[int], length: int = LENGTH, tries: int = TRIES) -> list[int]:
    """A bin for each item.  Items first go to the tightest bin, longest first; then the emptiest bins are cleared.

    Clearing works item by item: an item moves to a bin with room for it, or is exchanged with one shorter item, or
    with two that are shorter together, of a bin that this leaves fuller.  Each step moves fill from the emptiest bin
    to a fuller one, so the sum of squared fills rises until the bin is empty or no step is left.
    """
    bins = _Bins(size, length)
    for i in sorted(range(len(size)), key=lambda i: -size[i]):
        b = bins.tightest(size[i])
        bins.put(i, bins.open() if b < 0 else b)
    least = -(-sum(size) // length)
    alive = {b for b in range(len(bins.items))}
    stuck: set[int] = set()
    while len(alive) > least:
        todo = [b for b in alive if b not in stuck]
        if not todo:
            break
        low = max(todo, key=lambda b: bins.free[b])
        left = tries
        while bins.items[low] and left:
            left -= 1
            if not _step(bins, low):
                break
        if bins.items[low]:
            stuck.add(low)
        else:
            bins.close(low)
            alive.discard(low)
    of = [0] * len(size)
    for k, b in enumerate(sorted(alive)):
        for i in bins.items[b]:
            of[i] = k
    return of


def _step(bins: _Bins, low: int) -> bool:
    """One move or exchange that takes fill out of ``low``; False if there is none."""
    size = bins.size
    mine = sorted(bins.items[low], key=lambda i: -size[i])
    for i in mine:
        b = bins.tightest(size[i], low)
        if b >= 0 and bins.length - bins.free[b] + size[i] > bins.length - bins.free[low]:
            bins.take(i, low)
            bins.put(i, b)
            return True
    seen = 0
    for b in bins.underfull(low):
        room = bins.free[b]
        if room >= bins.free[low] or seen > 256:
            break
        seen += 1
        theirs = sorted(bins.items[b], key=lambda j: size[j])
        for i in mine:
            fit = [j for j in theirs if 0 < size[i] - size[j] <= room]
            if fit:   # one for one: the exchange that fills b most
                _swap(bins, low, b, i, [fit[0]])
                return True
            for x in range(len(theirs)):
                for y in range(x + 1, len(theirs)):
                    if 0 < size[i] - size[theirs[x]] - size[theirs[y]] <= room:
                        _swap(bins, low, b, i, [theirs[x], theirs[y]])
                        return True
    return False


def _swap(bins: _Bins, low: int, b: int, i: int, back: list[int]) -> None:
    bins.take(i, low)
    for j in back:
        bins.take(j, b)
    bins.put(i, b)
    for j in back:
        bins.put(j, low)


def packed(docs: DataFrame, vocabulary: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Pieces lie gapless in their sequence from 0.  Groups are dealt by hash of id, piece and content, so the result
    does not depend on partitions; rows that repeat one another are packed once each, numbered so that they are dealt
    over all groups.  No documents, no rows.
    """
    cut = settled(pieces(docs, vocabulary, length))
    groups = max(1, -(-cut.count() // group))
    same = cut.groupBy("doc_id", "piece", "start", "length", "ids_crc32").agg(F.count(F.lit(1)).alias("_n"))
    steps = same.withColumn("_s", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / group).cast("int"))))
    numbered = steps.withColumn("_r", F.explode(F.sequence(F.lit(0), F.least(F.lit(group), F.col("_n") - F.col("_s") * group).cast("int") - 1)))
    dealt = numbered.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.col("_s") * group + F.col("_r") + 5), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        pdf["_b"] = pack(pdf["length"].tolist(), length)
        pdf = pdf.sort_values(["_b", "doc_id", "piece"], kind="stable")
        pdf["offset"] = pdf.groupby("_b")["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = pdf["_g"] * (1 << 24) + pdf["_b"]
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return dealt.groupBy("_g").applyInPandas(one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
