"""Repeated documents in packing."""

from public_tokenizers import path
from pyspark.sql import functions as F

from loftline.llm import packing
from test_near_and_mix import docs


def test_repeats_of_a_row_are_dealt_over_all_groups(spark):
    df = docs(spark, ["some words here"] * 400).withColumn("doc_id", F.lit(None).cast("long"))
    rows = packing.packed(df, path("byte_bpe_50k.json"), group=40).collect()
    groups = [r.sequence_id >> 24 for r in rows]
    assert len(rows) == 400 and len(set(groups)) == 10 and max(map(groups.count, groups)) < 100
