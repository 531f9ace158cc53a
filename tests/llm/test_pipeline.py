"""The registered queries against their SQL, and every pipeline stage against a plain version on what it was given."""

import os
import tempfile
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from loftline.llm import linechunks, mixing, quality, queries
from loftline.llm.common import table
from test_near_and_mix import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it gave, in order."""
    root, docs, out = tempfile.mkdtemp(prefix="stages-"), table(spark, SF, "documents"), []
    extra = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", "en", "src0", 0), (9002, "", "en", "src0", 0), (9003, "one line", None, "src0", 8)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        after = spark.read.parquet(f"{root}/{name}")
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def test_quality_stage(spark, stages):
    before, after = stages[0]
    model = quality.fit(before, table(spark, SF, "labels"))
    score = model.scorer()
    assert sorted(map(repr, rows(after))) == sorted(repr(r) for r in rows(before) if score(r[1] or "") >= 0.3)
    assert len(rows(after)) > 0.8 * len(rows(before))


def test_line_stage(stages):
    before, after = stages[1]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    want = sorted((repr(a), t) for a, _, _, t in con.execute(linechunks.ORACLE).fetchall())
    assert sorted((repr(r[0]), r[1]) for r in rows(after)) == want
    assert all(r[4] == len(r[1]) for r in rows(after))


def test_near_stage(stages):
    before, after = stages[2]
    got, given = rows(after), rows(before)
    group = dict(zip(map(repr, given), plain_groups([plain_fingerprint(r[1]) for r in given])))
    assert set(map(repr, got)) <= set(group) and len(got) == len(set(map(repr, got)))
    least = defaultdict(list)
    for r in given:
        least[group[repr(r)]].append(r[0])
    assert sorted(r[0] for r in got) == sorted(min(v) for v in least.values())


def test_mixing_stage(stages):
    before, after = stages[3]
    times, given = Counter(map(repr, rows(after))), rows(before)
    goal = {r.source: (r.source_size, r.target) for r in mixing.targets(before.select("source", mixing.word_count(F.coalesce("text", F.lit(""))).alias("size"))).collect()}
    words, largest = Counter(), Counter()
    for r in given:
        n = len((r[1] or "").split())
        assert times[repr(r)] in range(int(goal[r[3]][1] // max(1, goal[r[3]][0])), 3)
        words[r[3]] += n * times[repr(r)]
        largest[r[3]] = max(largest[r[3]], n)
    assert set(times) <= set(map(repr, given))
    assert all(abs(words[s] - goal[s][1]) <= largest[s] / 2 + 1 for s in goal)
    again = mixing.mix(before.repartition(5), split=False).select("doc_id", "copies")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixing.mix(before, split=False).select("doc_id", "copies").collect()))


def test_packing_stage(stages):
    before, after = stages[4]
    got = after.collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows(before))
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2


def test_whole_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert os.path.isdir(SF)
