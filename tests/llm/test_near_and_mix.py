"""SimHash groups, line chunks, mixing and packing against plain versions on small tables."""

import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from public_tokenizers import path

from loftline.llm import components, linechunks, mixing, packing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_every_four_positions_hold_a_triple():
    found = [set(t) for t in simhash.triples()]
    assert len(found) == 20
    assert all(any(t <= set(four) for t in found) for four in itertools.combinations(range(8), 4))


def test_fingerprints_of_odd_texts():
    for t in [None, "", " \t\n", "One", "one two three", "a b c d", "A\x0bb c İ d e", "wörd " * 500, "x" * 40000, "e\U0001f600f g h i"]:
        assert simhash.fingerprint(t) % (1 << 64) == plain_fingerprint(t)


def test_groups_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).toPandas()
    texts = list(table["text"]) + [None, "", "Same text here twice", "same TEXT here\ttwice"] + [t + " end" for t in table["text"][:20]]
    fps = [plain_fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in simhash.near_groups(docs(spark, texts).withColumn("fp", simhash.F.lit("clash"))).collect()}
    want = plain_groups(fps)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].fp % (1 << 64) == fps[i] and got[i].component_id == want[i]


@pytest.mark.parametrize("block", [3, 40, 1024])
def test_dense_groups_in_blocks(spark, block):
    """Many fingerprints a few bits apart: the links found connect just what is connected."""
    rng = random.Random(3)
    base, far = rng.getrandbits(64), rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(120)} | {far ^ (7 << k) for k in range(0, 60, 4)} | {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(nodes, 4, block)).collect()}
    roots = plain_groups(fps)
    groups = defaultdict(set)
    for f, r in zip(signed, roots):
        groups[r].add(f)
    for g in groups.values():
        assert {got.get(f, f) for f in g} == {min(g)}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(5, 5), (None, 3), (900, 901), (900, 901)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", None, None, 0), (None, None, None, None, None), (7, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(df).collect()), key=str)
    assert got == sorted([(None, 7), (None, 3), (7, 7), (7, 7), (3, 3)], key=str)
    assert simhash.near_groups(df.limit(0)).count() == 0
    assert linechunks.line_dedup(df).count() == 5 and linechunks.line_dedup(df.limit(0)).count() == 0
    assert packing.packed(df, path("byte_bpe_50k.json")).count() == 5
    mixed = mixing.mix(df).collect()
    assert len(mixed) == 5 and sum(r.taken for r in mixed if r.source is None) == 7   # of 27 words: 5 to 2 by weight, 7.7 for the null source
    assert mixing.mix(df.limit(0)).count() == 0


def passage(rng, lines=8):
    return [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(14)) for _ in range(lines)]


def test_repeated_passages_go_once(spark):
    rng = random.Random(1)
    shared = passage(rng, 14)
    texts = ["\n".join(passage(rng, 3) + shared + passage(rng, 4)) for _ in range(6)] + ["\n".join(passage(rng, 9)), "short\nlines\nonly", None, ""]
    got = {r.doc_id: r for r in linechunks.line_dedup(docs(spark, texts).withColumn("n_lines", simhash.F.lit("x"))).collect()}
    assert got[0].text == texts[0]
    for i in range(1, 6):
        kept = got[i].text.split("\n")
        assert len(set(kept) & set(shared)) <= 4 and not set(texts[i].split("\n")) - set(shared) - set(kept)
        assert got[i].n_removed == 21 - len(kept)
    for i in (6, 7, 8, 9):
        assert got[i].text == (texts[i] or "") and got[i].n_removed == 0


def test_line_dedup_with_and_without_broadcast(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    few, many = (sorted(map(repr, linechunks.line_dedup(table, n).collect())) for n in (10 ** 6, 0))
    assert few == many and any("n_removed=0" not in r for r in few)


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    texts = [" ".join("x" for _ in range(rng.randint(0, 90))) for _ in range(400)] + [None, ""]
    sources = [rng.choice(["a", "b", "c", "c", "c", None, "d"]) for _ in texts]
    rows = mixing.mix(docs(spark, texts, sources)).collect()
    size = Counter()
    for t, s in zip(texts, sources):
        size[s] += len((t or "").split())
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:   # clamp, share out again
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            goal[s], left = 2 * size[s], left - 2 * size[s]
            free.discard(s)
    goal |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order)
    again = mixing.mix(docs(spark, texts, sources).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_pieces_are_the_files_ids(spark):
    from tokenizers import Tokenizer
    table = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    texts = list(table["text"]) + [None, "", "<|endoftext|> in a <|endoftext|>text", "ß" * 5000, " \n\n  x\t", "\U0001f600 zero​width", "a" * 30000]
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = set()
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) - 1) % 2048 + 1 if k == 0 else 2048
            want.add((i, k, at, n, zlib.crc32(ids[at:at + n].tobytes())))
            at, k = at + n, k + 1
    rows = packing.packed(docs(spark, texts), path("byte_bpe_50k.json")).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for s in places.values():
        s.sort()
        assert [o for o, _ in s] == [0, *itertools.accumulate(n for _, n in s)][:-1] and sum(n for _, n in s) <= 2048
    assert len(places) <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


def test_exchanges_empty_bins():
    """Items that the first placing leaves in one bin too many; exchanges reach the bound."""
    rng = random.Random(9)
    sizes = []
    for _ in range(60):   # 60 bins cut into parts that fill them exactly
        cuts = sorted(rng.sample(range(1, 100), rng.randint(1, 3)))
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 100])]
    of = packing.pack(sizes, 100)
    fill = Counter()
    for s, b in zip(sizes, of):
        fill[b] += s
    assert max(fill.values()) <= 100 and len(fill) <= 61
    start = packing.pack(sizes, 100, tries=0)
    assert len(fill) <= len(set(start))
