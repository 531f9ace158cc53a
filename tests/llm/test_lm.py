"""Language-model scores against a plain model of dictionaries; the trie and its sequences against plain searches."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loftline.llm import lm, triefile

SCHEMA = "doc_id long, text string, part int, source string"


@pytest.mark.parametrize("values", [[], [0], [5], [0, 1, 2, 3], [7, 90, 91, 1000, 10 ** 9], list(range(0, 100000, 37)), [k * k for k in range(500)]])
def test_sequence(values):
    v = np.array(values, np.int64)
    for universe in {int(v.max(initial=0)) + 1, int(v.max(initial=0)) * 3 + 10}:
        ef = triefile.EliasFano(triefile.EliasFano.build(v, universe))
        assert ef.get(np.arange(len(v))).tolist() == values
        x = np.unique(np.clip(np.r_[v, v + 1, v - 1, 0, universe - 1], 0, universe - 1))
        at, same = ef.successor(x)
        assert at.tolist() == np.searchsorted(v, x).tolist() and same.tolist() == np.isin(x, v).tolist()


def test_repeated_values():
    v = np.array([0, 0, 0, 4, 4, 9, 9, 9, 9, 200])
    ef = triefile.EliasFano(triefile.EliasFano.build(v, 200))
    assert ef.get(np.arange(len(v))).tolist() == v.tolist()


def plain_scores(rows, order, prior):
    """Counts in dictionaries, the same formula, each factor rounded alike."""
    docs = [(i, [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" ") if w] + [("end",)],
             i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t, *_ in rows]
    counts, uni = Counter(), Counter()
    for _, w, held in docs:
        if not held:
            uni.update(w)
            line = [("begin",)] * (order - 1) + w
            for k in range(1, order + 1):
                counts.update(tuple(line[j - k + 1:j + 1]) for j in range(k - 1, len(line)) if k > 1 or j >= order - 1)
            counts[("begin",),] += 1
    n, v = sum(uni.values()), len(uni)

    def p(gram):
        if len(gram) == 1:
            return (uni[gram[0]] + 1) / (n + v + 1)
        return (counts[gram] + prior * p(gram[1:])) / (counts[gram[:-1]] + prior)

    def steps(gram):
        if len(gram) == 1 or counts[gram]:
            return round(-math.log10(p(gram)) * 4096)
        c = counts[gram[:-1]]
        return (round(-math.log10(prior / (c + prior)) * 4096) if c else 0) + steps(gram[1:])
    out = []
    for i, w, held in docs:
        line = [("begin",)] * (order - 1) + w
        out.append((i, held, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w),
                    -sum(steps(tuple(line[j - order + 1:j + 1])) for j in range(order - 1, len(line))) / 4096))
    return out


def corpus():
    rng = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "deltaİ", "eé", "zeta", "x1"]
    rows = [(i, " ".join(rng.choice(words[:rng.randint(2, 7)]) for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n", " rare%d" % i]), 0, "s") for i in range(60)]
    return rows + [(None, None, 0, "s"), (None, "alpha beta", 1, None), (3, "", 0, "s"), (3, "\x0b \t", 0, "s"), (9, "Alpha alpha " * 3000, 0, "s"), (16, "beta", 0, "s"), (16, "beta", 0, "s")]


@pytest.mark.parametrize("order,prior", [(1, 4.0), (2, 64.0), (3, 2.0), (4, 0.5)])
def test_scores_equal_plain(spark, order, prior):
    rows = corpus()
    got = lm.scores(spark.createDataFrame(rows, SCHEMA).repartition(3), order=order, prior=prior, part_bytes=900, shard_grams=50).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(plain_scores(rows, order, prior), key=key), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-9 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 1e-9, (g, w)


def test_parts_do_not_matter(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    a, b = (sorted(map(tuple, lm.scores(df.repartition(n), part_bytes=p, shard_grams=s).collect()), key=str) for n, p, s in ((1, 1 << 20, 10 ** 6), (4, 200, 20)))
    assert [x[:5] + x[6:] for x in a] == [x[:5] + x[6:] for x in b]


def test_degenerate_tables(spark):
    assert lm.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.scores(spark.createDataFrame([(held, "no training at all", 0, "s")], SCHEMA)).collect()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0


def test_model_beats_base_on_held_out(spark):
    got = lm.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1]


def test_trie_from_a_file(tmp_path):
    """Levels of a trie of order 3, mapped from a file: every gram is found, others are not."""
    rng = np.random.default_rng(1)
    tri = np.unique(rng.integers(0, 12, (400, 3)), axis=0)
    bi = np.unique(np.r_[tri[:, :2], tri[:, 1:]], axis=0)
    where = {tuple(g): k for k, g in enumerate(bi.tolist())}
    flat = lambda n: (-np.arange(n) / 100, -np.arange(n) / 50)
    buffer, nodes = triefile.Trie.build(12, [flat(12), (*flat(len(bi)), bi[:, 0], bi[:, 1]),
                                             (*flat(len(tri)), np.array([where[a, b] for a, b, _ in tri.tolist()]), np.array([where[b, c] for _, b, c in tri.tolist()]))])
    (tmp_path / "trie").write_bytes(buffer)
    trie = triefile.Trie.open(str(tmp_path / "trie"))
    every = np.array([(a, b, c) for a in range(12) for b in range(12) for c in range(12)])
    low = {tuple(g): n for g, n in zip(bi.tolist(), nodes[1])}
    found = trie.child(3, np.array([low.get((a, b), -1) for a, b, _ in every.tolist()]), np.array([low.get((b, c), -1) for _, b, c in every.tolist()]), every[:, 1])
    there = {tuple(g): n for g, n in zip(tri.tolist(), nodes[2])}
    assert found.tolist() == [there.get(tuple(g), -1) for g in every.tolist()]
    assert trie.prob[2][nodes[2]].tolist() == triefile.quantised(flat(len(tri))[0]).tolist()


def test_the_query_looks_at_two_words_before(spark):
    """The same words in another order of their pairs' contexts score otherwise: pairs alone cannot tell."""
    seen = [(k, "a b c d e b f", None, None, 0) for k in range(60)]
    texts = ["a b c", "e b c"]   # the pair b c is known, after a alone
    rows = [r[:2] for r in seen] + [(1000 + k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") >= 1000
    get = lambda **kw: {r.doc_id: r.score for r in lm.scores(df, held=held, **kw).filter("held_out").collect()}
    assert get() == get(order=3) != get(order=2)
