"""An id with several vectors."""

import numpy as np
from pyspark.sql import functions as F

from loftline.llm import nearest


def test_an_id_with_two_vectors_is_two_candidates(spark):
    x = np.random.default_rng(5).normal(size=(12, 4))
    ids = [0, 0, 1, 1, 1, 1, 1, 1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest.nearest(df, F.col("vec_id") == 0).collect()]
    pairs = [(-float(nearest.cosine(x[q:q + 1], x[c:c + 1])[0]), ids[c]) for q in (0, 1) for c in range(2, 12)]
    assert sorted(got) == [(0, k + 1, c, -s) for k, (s, c) in enumerate(sorted(pairs)[:5])]
