"""Course cards: nested JSON of tees and holes (O-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEE = ("array<struct<tee_name:string,course_rating:double,slope_rating:int,par_total:int,"
        "holes:array<struct<par:int,handicap:int,yardage:int>>>>")
CARD = f"id long, club_name string, course_name string, location struct<city:string,state:string,latitude:double,longitude:double>, tees struct<male:{_TEE},female:{_TEE}>"


def parse_cards(docs: DataFrame, column: str) -> DataFrame:
    c = F.from_json(column, CARD)
    return docs.select(c.alias("c")).select(F.col("c.id").alias("course_id"), "c.club_name", "c.course_name", "c.location", "c.tees")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """A folder of card files, each one JSON object or one wrapped in ``{"course": {...}}``."""
    raw = spark.read.schema(f"{CARD}, course struct<{CARD.replace(' long', ':long', 1).replace('club_name string', 'club_name:string').replace('course_name string', 'course_name:string').replace('location struct', 'location:struct').replace('tees struct', 'tees:struct')}>").json(path, multiLine=True)
    pick = lambda f: F.coalesce(F.col(f"course.{f}"), F.col(f))
    return raw.select(pick("id").alias("course_id"), pick("club_name").alias("club_name"), pick("course_name").alias("course_name"), pick("location").alias("location"), pick("tees").alias("tees"))
