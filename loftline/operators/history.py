"""Per-player history: rolling differentials, as-of averages, season records, streaks, ledgers."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loftline.functions.numbers import r1
from loftline.operators.skew import carried_sums, with_halo

LAST_N = 5


def without_carded_days(pool: DataFrame) -> DataFrame:
    """J-16: a played round on a day that also has a card is dropped; the card stands for it."""
    carded = F.max(F.col("kind") == "card").over(Window.partitionBy("player_id", "day_no"))   # a day holds a few rounds
    return pool.withColumn("_carded", carded).filter((F.col("kind") == "card") | ~F.col("_carded")).drop("_carded")


def latest_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, out: str = "rn") -> DataFrame:
    """K-06: the most recent ``n`` rows per key; Spark limits each group before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= n)


def last5(pool: DataFrame) -> DataFrame:
    """Current last-five average per player with how many were cards and the series, oldest first."""
    top = latest_n(pool.filter(F.col("differential").isNotNull()), ["player_id"],
                   [F.col("day_no").desc(), F.col("round_id").desc()], LAST_N)
    return top.groupBy("player_id").agg(
        r1(F.sum("differential") / F.count(F.lit(1))).alias("diff"), F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("kind") == "card", 1)).alias("seeded"), F.max("day_no").alias("as_of"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day_no", "round_id", "differential"))),
                                 lambda s: F.format_string("%.1f", s["differential"])), ",").alias("series"))


def rolling5(pool: DataFrame) -> DataFrame:
    """W-07: the last-five average standing after each round.  Years are cut apart with a four-row halo."""
    rows = pool.filter(F.col("differential").isNotNull()).select("player_id", "round_id", "day_no", "yr", "kind", "differential")
    fed = with_halo(rows, ["player_id"], "yr", ["day_no", "round_id"], LAST_N - 1)
    w = Window.partitionBy("player_id", "yr").orderBy("day_no", "round_id").rowsBetween(-(LAST_N - 1), 0)
    return (fed.withColumn("_s", F.sum("differential").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
            .withColumn("seeded", F.count(F.when(F.col("kind") == "card", 1)).over(w))
            .withColumn("diff", r1(F.col("_s") / F.col("n"))).filter("_own").drop("_own", "_s"))


def as_of5(pool: DataFrame) -> DataFrame:
    """J-10: for every round, the last-five average over rounds on earlier days only."""
    rolled = rolling5(pool)
    days = rolled.groupBy("player_id", "yr", "day_no").agg(
        F.max_by(F.struct("diff", "n"), "round_id").alias("v"))
    fed = with_halo(days, ["player_id"], "yr", ["day_no"], 1)
    w = Window.partitionBy("player_id", "yr").orderBy("day_no")
    before = (fed.withColumn("p", F.lag("v").over(w)).filter("_own")
              .select("player_id", "day_no", F.col("p.diff").alias("diff_before"), F.col("p.n").alias("n_before")))
    return rolled.select("player_id", "round_id", "day_no").join(before, ["player_id", "day_no"])


def season(results: DataFrame) -> DataFrame:
    """A-24 and the current streak of W-03.  A tie ends any streak.

    The streak is the count of rounds after the last one that ended differently, so it needs two aggregates
    and no window over a player's whole history.
    """
    pos = F.struct("day_no", "round_id")
    latest = results.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("result") == "W", 1)).alias("w"),
        F.count(F.when(F.col("result") == "L", 1)).alias("l"), F.count(F.when(F.col("result") == "T", 1)).alias("t"),
        F.avg(F.col("you") - F.col("opp")).alias("margin"), F.max_by("result", pos).alias("last"),
        *[F.max(F.when(F.col("result") != k, pos)).alias(f"_not_{k}") for k in ("W", "L")])
    cut = F.when(F.col("last") == "W", F.col("_not_W")).when(F.col("last") == "L", F.col("_not_L"))
    latest = latest.withColumn("_cut", cut)
    run = (results.join(latest.select("player_id", "last", "_cut"), "player_id")
           .filter((F.col("last") != "T") & (F.col("_cut").isNull() | (pos > F.col("_cut"))))
           .groupBy("player_id").agg(F.count(F.lit(1)).alias("streak_n")))
    return (latest.join(run, "player_id", "left")
            .select("player_id", "n", "w", "l", "t", "margin",
                    F.when(F.col("streak_n").isNotNull(), F.col("last")).alias("streak"),
                    F.coalesce("streak_n", F.lit(0)).alias("streak_n")))


def running_record(results: DataFrame) -> DataFrame:
    """Wins, losses and ties standing after each round, oldest first."""
    is_ = lambda k: F.when(F.col("result") == k, 1).otherwise(0)
    return carried_sums(results, ["player_id"], "yr", [F.col("day_no"), F.col("round_id")],
                        {"w": is_("W"), "l": is_("L"), "t": is_("T")})


def ledger(rounds: DataFrame, cards: DataFrame) -> DataFrame:
    """K-05: rounds and cards in one list with a kind tag and a sort time; a bare date stands for noon."""
    a = rounds.withColumn("kind", F.lit("round")).withColumn("time_s", F.col("played_s"))
    b = cards.withColumn("kind", F.lit("card")).withColumn("time_s", F.col("day_no") * 86400 + 43200)
    return a.unionByName(b, allowMissingColumns=True)
