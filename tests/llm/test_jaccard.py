"""Near-duplicate groups against brute-force Jaccard over five-word shingles."""

import itertools
import random

import pytest

import corpus_pipeline
from loftline.llm import jaccard
from test_near_and_mix import docs


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_roots(texts):
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def edited(rng):
    """Texts of 40 to 300 words, and copies with single words changed, of similarities on both sides of 0.8."""
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(9999)}" for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 35))):
                copy[at] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    return texts + [None, "", " \n", "one line", "One  LINE", texts[0]]


@pytest.mark.parametrize("block,few", [(512, 10 ** 6), (2, 0)])
def test_groups_equal_brute_force_jaccard(spark, block, few):
    texts = edited(random.Random(11))
    want = plain_roots(texts)
    got = {r.doc_id: r.root for r in jaccard.near_groups(docs(spark, texts), block=block, few_nodes=few).collect()}
    assert len(got) == len(texts) and len(set(want)) < len(texts) - 20
    assert len({(got[i], want[i]) for i in got}) == len(set(want)) == len(set(got.values()))


def test_stage_keeps_one_of_each_group(spark):
    texts = edited(random.Random(12))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(plain_roots(texts)))
    assert corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts[:1]).limit(0), "").count() == 0
