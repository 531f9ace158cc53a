"""Near-duplicate candidates of the pipeline stage that come through the fingerprint index."""

import random

from loftline.llm import jaccard, simhash


def test_fingerprints_link_what_min_hashes_are_not_asked_for(spark):
    rows = [(1, 0), (2, 0), (3, 0b1111), (4, -1), (5, (1 << 40) - 1), (6, -16)]
    got = {r.node: r._g for r in jaccard.linked_prints(spark.createDataFrame(rows, "node long, fp long")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: -16, 5: (1 << 40) - 1, 6: -16}


def test_close_copies_meet_by_fingerprint(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(10):
        words = [f"w{rng.randrange(9999)}" for _ in range(2000)]
        texts += [" ".join(words), " ".join(words[:1000] + ["other"] + words[1001:])]
    fps = [simhash.fingerprint(t, jaccard.WORDS) for t in texts]
    near = [k for k in range(0, 20, 2) if ((fps[k] ^ fps[k + 1]) & (2 ** 64 - 1)).bit_count() <= 4]
    got = {r.node: r._g for r in jaccard.linked_prints(spark.createDataFrame([(k, f) for k, f in enumerate(fps)], "node long, fp long")).collect()}
    assert len(near) >= 8 and all(got[k] == got[k + 1] for k in near) and len(set(got.values())) >= 10
