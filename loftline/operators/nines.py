"""Courses of more than one eighteen: which mapped hole is which hole of which nine (J-13, J-20, S-04).

Nines of a course are numbered 1 to 3 in the order in which the club names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.operators.skew import evaluated_once


def _label(w: Column) -> Column:
    return w.isin("1", "2", "3")


def _has_word(text: Column, w: Column) -> Column:
    """Whether a name stands in a text with no letter beside it."""
    letters = F.split(F.lower(text), "[^\\p{L}]+")
    parts = F.filter(F.split(F.lower(w), "[^\\p{L}]+"), lambda p: p != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.array_contains(letters, p)) & F.contains(F.lower(text), F.lower(w))


def _full(map_: DataFrame, play: str) -> DataFrame:
    """Courses on which both nines played have each of their nine holes just once."""
    n = map_.filter(F.array_contains(play, F.col("nine"))).groupBy("course_id", "nine").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("hole").alias("d"))
    ok = n.filter("n = 9 AND d = 9").groupBy("course_id").agg(F.count(F.lit(1)).alias("c"))
    return ok.filter("c = 2").select("course_id")


def nine_map(holes: DataFrame, routings: DataFrame) -> DataFrame:
    """J-13: (course_id, key, nine, hole) of the courses whose nines can be read off for sure.

    Holes: course_id, key, ref, name.  Routings, one a course: club array<string> (its nines), play array<string>
    (two of them), ordered (the club's order is that of the numbers).  Either the holes' names hold the names of
    nines, one each, or their numbers are 1 to 27, each once; and both nines played must be whole.
    """
    h = evaluated_once(holes.join(routings, "course_id").withColumns({
        "_word": F.filter("club", lambda w: ~_label(w) & _has_word(F.coalesce("name", F.lit("")), w)),
        "_words": F.size(F.filter("club", lambda w: ~_label(w))),
        "_ref": F.when(F.col("ref").between(1, 27), F.col("ref")),
        "_digit": F.nullif(F.regexp_extract(F.coalesce("name", F.lit("")), "(?:^|\\D)([1-9])(?:\\D|$)", 1), F.lit("")).cast("int")}))
    nine_of = lambda w: F.array_position("club", w).cast("int")
    h = h.withColumn("hole", F.coalesce((F.col("_ref") - 1) % 9 + 1, "_digit").cast("int"))
    named = h.filter((F.size("_word") == 1) & (F.col("_words") >= 2)).withColumn("nine", nine_of(F.get("_word", F.lit(0)))).filter("hole IS NOT NULL AND nine <= 3")
    named = named.withColumn("_play", F.transform("play", nine_of))
    named = named.join(_full(named, "_play"), "course_id", "left_semi").select("course_id", "key", "nine", "hole")
    sure = h.groupBy("course_id").agg((F.count("_ref") == F.count(F.lit(1))).alias("all"), (F.count_distinct("ref") == F.count(F.lit(1))).alias("once")).filter("all AND once")
    by_no = F.when(F.forall("play", _label), F.transform("play", lambda w: w.cast("int"))).when(F.col("ordered") & (F.size("club") == 3), F.transform("play", nine_of))
    numbered = h.join(sure, "course_id", "left_semi").join(named.select("course_id").distinct(), "course_id", "left_anti")
    numbered = numbered.withColumns({"nine": F.ceil(F.col("_ref") / 9).cast("int"), "_play": by_no}).filter("_play IS NOT NULL")
    numbered = numbered.join(_full(numbered, "_play"), "course_id", "left_semi").select("course_id", "key", "nine", "hole")
    return named.unionByName(numbered)


def first_guess(holes: DataFrame) -> DataFrame:
    """J-20: a nine map to start from: a number up to 27 that no other hole has counts through; one up to 9 that repeats
    is that hole of the nine it is met in; any other takes the next free place in order."""
    course = Window.partitionBy("course_id")
    h = holes.withColumns({"_same": F.count(F.lit(1)).over(Window.partitionBy("course_id", "ref")),
                           "_i": F.row_number().over(course.orderBy(F.coalesce(F.nullif("ref", F.lit(0)), F.lit(99)), F.col("key").cast("string"))) - 1})
    h = h.withColumn("_nth", F.row_number().over(Window.partitionBy("course_id", "ref").orderBy("_i")))
    alone = F.col("ref").between(1, 27) & (F.col("_same") == 1)
    again = F.col("ref").between(1, 9)
    nine = F.when(alone, F.ceil(F.col("ref") / 9)).when(again, F.least(F.lit(3), F.col("_nth"))).otherwise(F.least(F.lit(3), F.floor(F.col("_i") / 9) + 1))
    hole = F.when(alone, (F.col("ref") - 1) % 9 + 1).when(again, F.col("ref")).otherwise(F.col("_i") % 9 + 1)
    return h.select("course_id", "key", nine.cast("int").alias("nine"), hole.cast("int").alias("hole"))


def card_hole_keys(courses: DataFrame, holes: DataFrame, map_: DataFrame) -> DataFrame:
    """J-20: (course_id, card_hole, key) for holes 1 to 18 of a card; null where the map has no such hole.

    ``courses``: course_id, play array<int> (the two nines in order), null on a course of one eighteen, whose holes are
    known by their number.
    """
    n = F.col("card_hole")
    card = courses.select("course_id", "play", F.explode(F.sequence(F.lit(1), F.lit(18))).alias("card_hole"))
    card = card.withColumns({"nine": F.get("play", F.when(n <= 9, 0).otherwise(1)), "hole": ((n - 1) % 9 + 1).cast("int")})
    of_nine = map_.groupBy("course_id", "nine", "hole").agg(F.min("key").alias("_a")).join(holes.select("course_id", F.col("key").alias("_a")).distinct(), ["course_id", "_a"], "left_semi")
    plain = holes.select("course_id", F.col("key").alias("_b")).distinct().withColumn("_no", F.col("_b"))
    j = card.join(of_nine, ["course_id", "nine", "hole"], "left").withColumn("_no", n.cast("string")).join(plain, ["course_id", "_no"], "left")
    return j.select("course_id", "card_hole", F.when(F.col("play").isNull(), F.col("_b")).otherwise(F.col("_a")).alias("key"))


def next_in_order(keys: DataFrame) -> DataFrame:
    """S-04: (course_id, key, next_key) in the order of the card, the last hole before the first; gaps are stepped over."""
    w = Window.partitionBy("course_id").orderBy("card_hole")   # eighteen rows
    k = keys.filter("key IS NOT NULL")
    first = F.first("key").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return k.select("course_id", "key", F.coalesce(F.lead("key").over(w), first).alias("next_key"))
