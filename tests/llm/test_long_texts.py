"""Twice the text takes about twice the time, and what is found does not change."""

import random
import time

from loftline.llm import linechunks, pii


def spans_text(n):
    rnd = random.Random(1)
    kinds = ["mail a%d@b%d.org now", "ssn 123-45-%04d x%d", "call (716) 555-%04d or %d", "host 10.0.%d.%d up"]
    return "  ".join(rnd.choice(kinds) % (rnd.randint(0, 255), rnd.randint(0, 255)) for _ in range(n))


def test_spans_do_not_touch_and_grow_in_proportion():
    base, both = pii.find(spans_text(3000))
    added = [s for s in both if s[:3] not in base]
    kept = sorted(base + [s[:3] for s in both if s[2] == "iban"])
    assert added and all(not (s < e2 and s2 < e) for s, e, *_ in added for s2, e2, _ in kept)
    took = []
    for n in (8000, 16000, 32000):   # 0.2, 0.4 and 0.8 MB
        t = time.process_time()
        pii.find(spans_text(n))
        took.append(time.process_time() - t)
    assert took[2] < 2.6 * took[1] < 7 * took[0] + 1


def test_many_lines(spark):
    def seconds(lines):
        rnd = random.Random(2)
        text = "\n".join(" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 99)) for _ in range(8)) for _ in range(lines))
        df = spark.createDataFrame([(b"k", 1, text)], "_key binary, doc_id long, _t string")
        t = time.time()
        n = linechunks.chunk_rows(df).count()
        return time.time() - t, n
    seconds(500)
    (short, n), (long, m) = seconds(16000), seconds(64000)
    assert 3.5 * n < m < 4.5 * n and long < 5.5 * short + 3
