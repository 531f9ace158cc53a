"""The registered stop matching takes every fix as a start."""

import __spark_entry__ as entry


def test_every_fix_can_be_a_start(spark):
    rows = entry.queries()["stop_match"](spark, "/root/testdata/sf0.001").collect()
    assert {r.shot_id % 3 for r in rows if r.shot_id is not None} == {0, 1, 2}
