"""Language-model scores of texts by n-gram tries.

The model is an n-gram model with Dirichlet smoothing: P(w) = (c(w) + 1) / (N + V + 1) for one word, and
P(w | u) = (c(u w) + PRIOR * P(w | u without its first word)) / (c(u) + PRIOR) for longer grams, c over all training texts.

Texts are packed into parts where they are read, with a dictionary each.  A part asks for each of its distinct grams
once, with the number of times it counts itself, in messages to shards of the grams; a shard adds up what all parts
count and answers.  From the answers each part builds an Elias-Fano trie of just the grams that its texts need (see
``triefile``) and scores its texts by lookups.  No model stands anywhere whole, whatever the corpus holds, and a gram that
is everywhere is asked for once a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.llm.common import settled, text_of
from loftline.llm.triefile import STEPS, Trie

ORDER, PRIOR = 3, 64.0
#: Bytes of text after which a part ends; grams that a shard holds about.
PART_BYTES, SHARD_GRAMS = 8 << 20, 2_000_000
_OUT = "held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


class _Dictionary(dict):
    """Word -> number in order of first sight; the end of a text is the empty word, number 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def _squeeze(a: np.ndarray) -> bytes:
    """Compressed, first bytes of all numbers first: the upper bytes of small numbers are long runs of zeros."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _stretch(b: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def bodies(docs: DataFrame, doc_id: str, text: str, held: Column, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each part: (part, doc_id, held, n_tokens as arrays over its texts, words, tokens, train_tokens, train_docs)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, typ = TaskContext.get().partitionId() << 32, None
        held, ids, tokens, size, words = [], [], [], 0, _Dictionary({b"": 0})

        def row() -> pa.RecordBatch:
            n = np.array([len(t) for t in tokens])
            train = ~np.array(held, bool)
            cols = [pa.array([part], pa.int64()), pa.array([ids], pa.list_(typ)), pa.array([held], pa.list_(pa.bool_())), pa.array([n], pa.list_(pa.int64())),
                    pa.array([zstandard.ZstdCompressor(level=3).compress(b"\n".join(words))], pa.binary()), pa.array([_squeeze(np.concatenate(tokens))], pa.binary()),
                    pa.array([int(n[train].sum())], pa.int64()), pa.array([int(train.sum())], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "held", "n_tokens", "words", "tokens", "train_tokens", "train_docs"])

        for b in batches:
            typ = b.schema.field(0).type
            for i, h, t in zip(b.column(0), b.column(1), b.column(2)):
                raw = t.as_py().encode("utf-8", "surrogatepass").lower().split()   # bytes: only A-Z are lowered, only ASCII white space splits
                ids.append(i)
                held.append(h.as_py())
                tokens.append(np.fromiter(map(words.__getitem__, [*raw, b""]), np.uint32, len(raw) + 1))
                size += 6 * len(raw) + 6
                if size >= part_bytes:
                    ids = [x.as_py() for x in ids]
                    yield row()
                    part, held, ids, tokens, size, words = part + 1, [], [], [], 0, _Dictionary({b"": 0})
        if ids:
            ids = [x.as_py() for x in ids]
            yield row()

    return rows.mapInArrow(pack, f"part long, doc_id array<{kind}>, held array<boolean>, n_tokens array<long>, words binary, tokens binary, train_tokens long, train_docs long")


@dataclass
class Grams:
    """The distinct grams of order k of a part: global keys, slots of their first and last k - 1 words, the slot at each token (-1 for none)."""
    keys: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    slot: np.ndarray


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: list[bytes], tokens: np.ndarray, n_tokens: np.ndarray, order: int) -> tuple[list[Grams], np.ndarray, np.ndarray]:
    """(grams of each order, document of each place, which places are tokens): order - 1 begin marks, numbered after the words, stand before each text."""
    pad, begin = order - 1, len(words)
    doc = np.repeat(np.arange(len(n_tokens)), n_tokens + pad)
    place = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(n_tokens + pad)[:-1]], n_tokens + pad)
    line = np.full(len(doc), begin, np.int64)
    line[place >= pad] = tokens
    keys = np.array([xxhash.xxh64_intdigest(w) for w in words] + [1], np.uint64)
    none = np.full(begin + 1, -1)
    out = [Grams(keys, none, none, line)]
    for k in range(2, order + 1):
        low = out[-1]
        at = np.flatnonzero(place >= k - 1)
        head = line[at - k + 1]
        _, first, inverse = np.unique(head * len(low.keys) + low.slot[at], return_index=True, return_inverse=True)
        slot = np.full(len(line), -1, np.int64)
        slot[at] = inverse
        suffix = low.slot[at[first]]
        out.append(Grams(_mixed(keys[head[first]], low.keys[suffix]), low.slot[at[first] - 1], suffix, slot))
    return out, doc, place >= pad


def _opened(row) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    words = zstandard.ZstdDecompressor().decompress(row.words).split(b"\n")
    return words, _stretch(row.tokens, np.uint32).astype(np.int64), np.asarray(row.n_tokens, np.int64), np.asarray(row.held, bool)


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams in order of key, shards that get some, where each one's grams start): a shard is a range of keys."""
    order = np.argsort(keys)
    shard = ((keys[order] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    to, start = np.unique(shard, return_index=True)
    return order, to, np.r_[start, len(keys)]


def requests(packed: DataFrame, order: int, shards: int) -> DataFrame:
    """(shard, k, part, keys, counts): the distinct k-grams of a part that belong to a shard, as gaps between sorted keys, and their counts in its training texts."""
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                words, tokens, n, held = _opened(row)
                found, doc, _ = grams(words, tokens, n, order)
                train = ~held[doc]
                for k, g in enumerate(found, 1):
                    size = len(g.keys) - (k == 1)   # the begin mark is nothing to count
                    counts = np.bincount(g.slot[train & (g.slot >= 0)], minlength=len(g.keys))[:size]
                    at, to, start = _dealt(g.keys[:size], shards)
                    yield pd.DataFrame([(int(s), k, row.part, _squeeze(np.diff(g.keys[at[a:b]], prepend=np.uint64(0))), _squeeze(counts[at[a:b]].astype(np.uint32))) for s, a, b in zip(to, start, start[1:])],
                                       columns=["shard", "k", "part", "keys", "counts"])
    return packed.select("part", "words", "tokens", "n_tokens", "held").mapInPandas(ask, "shard long, k int, part long, keys binary, counts binary")


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    known = 0
    for k, asked in pdf.groupby("k"):
        keys = [np.cumsum(_stretch(b, np.uint64)) for b in asked["keys"]]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, inverse, np.concatenate([_stretch(b, np.uint32) for b in asked["counts"]]).astype(np.int64))
        known += int((totals > 0).sum()) if k == 1 else 0
        start = np.r_[0, np.cumsum([len(x) for x in keys])]
        out += [(p, k, s, _squeeze(totals[inverse[a:b]])) for p, s, a, b in zip(asked["part"], asked["shard"], start, start[1:])]
    return pd.DataFrame(out, columns=["part", "k", "shard", "totals"]).assign(known=known)


def trie_of(found: list[Grams], totals: list[np.ndarray], n: int, v: int, prior: float) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(trie of the grams seen in training, its number for each word or -1, P of each single word)."""
    prob = single = (totals[0] + 1) / (n + v + 1)
    levels, given = [], []   # place of each gram among the seen ones of its order
    for k, g in enumerate(found, 1):
        if k > 1:
            prob = (totals[k - 1] + prior * prob[g.suffix]) / (totals[k - 2][g.prefix] + prior)
        seen = totals[k - 1] > 0
        given.append(np.where(seen, np.cumsum(seen) - 1, -1))
        own = [np.log10(prob[seen]), np.log10(prior / (totals[k - 1][seen] + prior))]
        if k > 1:
            own += [given[k - 2][g.prefix[seen]], given[k - 2][g.suffix[seen]]]
        levels.append(tuple(own))
    return Trie.build(len(levels[0][0]), levels)[0], given[0], single


def _gram_scores(trie: Trie, found: list[Grams], words: np.ndarray, unknown: float) -> np.ndarray:
    """-log10 P of each gram of the highest order, in steps: the longest suffix that the trie has, and back-offs before it."""
    def at(values: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.zeros(len(node), np.int64)
        out[node >= 0] = values[node[node >= 0]]
        return out

    nodes = [words]
    score = np.full(len(words), int(np.clip(round(-unknown * STEPS), 0, 65535)), np.int64)
    score[words >= 0] = trie.prob[0][words[words >= 0]]
    for k, g in enumerate(found[1:], 2):
        middle = None if k == 2 else nodes[-2][found[k - 2].suffix[g.prefix]]
        node = trie.child(k, nodes[-1][g.prefix], nodes[-1][g.suffix], middle)
        score = np.where(node >= 0, at(trie.prob[k - 1], node), score[g.suffix] + at(trie.back[k - 2], nodes[-1][g.prefix]))
        nodes.append(node)
    return score


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held: Column | None = None, order: int = ORDER, prior: float = PRIOR,
           part_bytes: int = PART_BYTES, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learnt from the rows that ``held`` leaves.

    ``score`` is the sum over tokens of log10 P(token | the order - 1 tokens before it), each factor rounded to 1/4096 of
    a decade; ``base_score`` sums log10 P of single tokens unrounded.  Null text is empty and has one token, its end.  A
    null id counts as training.  Repeated rows count and come out each; other columns are not looked at; an empty table
    gives no rows.  A very long text is a part of its own.  Grams are told apart by 64-bit hashes.
    """
    packed = settled(bodies(docs, doc_id, text, held_out(F.col(doc_id)) if held is None else held, part_bytes))
    n, n_docs, total = packed.agg(F.sum("train_tokens"), F.sum("train_docs"), F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    n, n_docs, shards = n or 0, n_docs or 0, max(1, math.ceil((total or 0) * order / shard_grams))
    answers = settled(requests(packed, order, shards).groupBy("shard").applyInPandas(_answered, "part long, k int, shard long, totals binary, known long"))
    v = answers.groupBy("shard").agg(F.max("known").alias("known")).agg(F.sum("known")).first()[0] or 0

    def score(body: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        row = next(body.itertuples())
        words, tokens, lengths, held = _opened(row)
        found, doc, real = grams(words, tokens, lengths, order)
        totals = []
        for k, g in enumerate(found, 1):
            size = len(g.keys) - (k == 1)
            at, to, start = _dealt(g.keys[:size], shards)
            mine = answer[answer["k"] == k].set_index("shard")["totals"]
            got = np.full(len(g.keys), n_docs, np.int64)   # the begin mark stands before each training text
            for s, a, b in zip(to, start, start[1:]):
                got[at[a:b]] = _stretch(mine[s], np.int64)
            totals.append(got)
        buffer, number, single = trie_of(found, totals, n, v, prior)
        value = _gram_scores(Trie(buffer), found, number, -math.log10(n + v + 1))[found[-1].slot[real]]
        first = np.r_[0, np.cumsum(lengths)[:-1]]
        own = found[0].slot[real]
        return pd.DataFrame({"doc_id": list(row.doc_id), "held_out": held, "n_tokens": lengths, "n_known": np.add.reduceat((totals[0] > 0)[own].astype(np.int64), first),
                             "base_score": np.add.reduceat(np.log10(single[own]), first), "score": np.add.reduceat(value, first) / -STEPS})

    kind = docs.schema[doc_id].dataType.simpleString()
    out = packed.drop("train_tokens", "train_docs").groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(score, f"doc_id {kind}, {_OUT}")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
