"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loftline.llm.common import settled, text_of, word_count
from loftline.operators.skew import carried_sums

#: Weights given to sources in code-point order, again and again.
WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, 11


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, place, source_size, target) by source, from rows (source, size).

    A level L is sought with sum(min(cap, L * weight)) = share * all sizes, cap = epochs * size: giving every source
    its part by weight, clamping those above their cap and sharing out what they leave until none is above comes
    to just that.  Sources are put in order of cap / weight, at which each is clamped; the level is found where the
    sources before are clamped and the next one is not.  The windows see one row a source, never a document.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = ranked.withColumns({"w": w, "cap": F.col("source_size") * epochs}).withColumn("at", F.col("cap") / F.col("w"))
    by = Window.orderBy("at", "place")
    s = s.withColumns({"clamped": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                       "open_w": F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)),
                       "goal": F.lit(share) * F.sum("source_size").over(Window.partitionBy())})
    s = s.withColumn("level", (F.col("goal") - F.col("clamped")) / F.col("open_w"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "place", "level"))).over(Window.partitionBy())["level"])
    full = F.col("level").isNull() | (F.col("level") * F.col("w") >= F.col("cap"))
    return s.select("source", "place", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        epochs: int = MAX_EPOCHS, seed: int = SEED, split: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, part_words, taken) of every row, and the columns in ``keep``.

    Each source is taken floor(target / size) times whole; for the fraction left, its documents stand in an order
    drawn from the seed and are taken from the front until the words suffice.  The document at the border gives its
    first ``part_words`` words, so the source meets its target to a word; with ``split`` off it is taken whole if that
    comes nearer.  The order follows id and text, so reruns agree; repeated rows are interchangeable.  Null text has
    size 0, a null source is a source, a source without words is taken 0 times.
    Running sums are carried over 256 hash buckets a source, so no task sorts a source that holds most rows.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text_of())))
    sized = docs.select("doc_id", F.col(source).alias("source"), word_count(text_of()).alias("size"), h.alias("h"), *keep)
    sized = sized if keep else settled(sized)   # small without texts; with them it is cheaper to read the table again
    goal = targets(sized.select("source", "size"), weights, share, epochs)
    placed = (sized.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
              .withColumn("bucket", F.substring("h", 1, 2)))
    run = carried_sums(placed, ["place"], "bucket", ["h", "size"], {"upto": F.col("size")})
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    due = F.floor(F.col("target") - F.col("copies") * F.col("source_size")).cast("long")
    before = F.col("upto") - F.col("size")
    if split:
        extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("due") - before))
    else:
        extra = F.when(F.col("upto") + before <= 2 * F.col("due"), F.col("size")).otherwise(F.lit(0))
    out = (run.withColumn("copies", rate).withColumn("due", due)
           .withColumn("part_words", extra.cast("long")))
    whole = (F.col("part_words") == F.col("size")) & (F.col("due") > 0) & (F.col("size") > 0)
    return out.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("copies") + whole.cast("long")).alias("copies"), F.when(whole, F.lit(0)).otherwise(F.col("part_words")).cast("long").alias("part_words"),
                      (F.col("copies") * F.col("size") + F.col("part_words")).alias("taken"), *keep)


_W = f"list_element([{', '.join(map(str, WEIGHTS))}], CAST((place - 1) % {len(WEIGHTS)} + 1 AS BIGINT))"
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS size,
        md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, {_W} AS w, source_size * {MAX_EPOCHS} AS cap FROM r),
a AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM w),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
        sum(w) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
        CAST({SHARE} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS goal FROM a),
v AS (SELECT *, (goal - CAST(clamped AS DOUBLE)) / CAST(open_w AS DOUBLE) AS own FROM l),
lv AS (SELECT first(own ORDER BY ratio, place) AS level FROM v WHERE own <= ratio),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * w >= cap THEN CAST(cap AS DOUBLE) ELSE level * w END AS target FROM v LEFT JOIN lv ON true),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS upto,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(0, least(size, CAST(floor(target - copies * source_size) AS BIGINT) - (upto - size))) AS part FROM c)
SELECT doc_id, size, source_size, target, CAST(copies * size + part AS BIGINT) AS taken FROM e
"""
