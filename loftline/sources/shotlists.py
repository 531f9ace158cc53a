"""Per-round shot lists: folder scan, flattening, vocabulary, signs, bundle, export and tolerant re-read (O-01 .. O-06, O-16, O-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loftline.functions.numbers import r1
from loftline.operators.shots import miss_signs
from loftline.settings import lookup

_ROW = "struct<hole:int,club:string,yds:double,startYds:double,startLie:string,endLie:string,offlineYds:double,side:string,missDist:string,missLat:string,missNote:string,missTotalFt:double,missTotalYds:double,toHoleFt:double,holed:boolean,startFt:double,result:string,sg:double>"
ROUND = ("schema int, complete boolean, round struct<date:string,course:string,score:int,scores:array<int>,yardsPerHoleSP:array<double>>, "
         + ", ".join(f"{k} array<{_ROW}>" for k in ("driving", "approach", "shortGame", "putting")))
# fixed values: club names and lie words as transcribed
CLUBS = {"dr": "Dr", "driver": "Dr", "2i": "2i", "2hy": "2Hy", "4hy": "4Hy", "5i": "5i", "6i": "6i", "7i": "7i", "8i": "8i", "9i": "9i",
         "pw": "PW", "gw": "GW", "sw": "SW", "lw": "LW", "putter": "Putter"}
LIES = {"tee": "tee", "fairway": "fairway", "rough": "rough", "recovery": "recovery", "penalty": "penalty", "green": "green", "sand": "sand",
        "bunker": "sand", "deep rough": "rough"}


def read_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """O-01: every ``<folder>/<key>/shots.json``; the directory name is the round key."""
    df = spark.read.schema(ROUND).option("multiLine", True).json(f"{folder}/*/shots.json").select("*", F.col("_metadata.file_path").alias("_f"))
    return df.withColumn("key", F.regexp_extract("_f", "([^/]+)/shots\\.json$", 1)).drop("_f")


def map_club(name) -> Column:
    """O-03: null for a blank or unknown club; a name nobody has fails loudly."""
    k = F.lower(F.trim(name))
    return F.when(k.isNull() | k.isin("", "unknown", "unknown club"), None).otherwise(
        F.coalesce(lookup(k, CLUBS), F.raise_error(F.concat(F.lit("unknown club: "), name)).cast("string")))


def map_lie(word) -> Column:
    k = F.lower(F.trim(word))
    return F.when(k.isNull(), None).otherwise(F.coalesce(lookup(k, LIES), F.raise_error(F.concat(F.lit("unknown lie: "), word)).cast("string")))


def flatten(rounds: DataFrame) -> DataFrame:
    """O-02/O-05: one row per shot with its place in the hole and round, signs and miss totals.

    The four arrays a round holds are opened together, so that a round is read once; the only windows are within a round and hole.
    """
    def named(cat: str, rank: int) -> Column:
        rows = F.coalesce(cat, F.array().cast(rounds.schema[cat].dataType))
        return F.transform(rows, lambda s, i: F.struct(F.lit(cat).alias("category"), F.lit(rank).alias("_rank"), i.alias("_i"), s.alias("s")))

    opened = F.concat(*[named(cat, rank) for rank, cat in enumerate(("driving", "approach", "shortGame", "putting"))])
    s = rounds.select("key", F.col("round.date").alias("date"), F.col("round.yardsPerHoleSP").alias("_yds"), F.inline(opened)).select("key", "date", "_yds", "category", "_rank", "_i", "s.*")
    w = Window.partitionBy("key", "hole").orderBy("_rank", "_i")
    wr = Window.partitionBy("key").orderBy("hole", "_rank", "_i")
    s = s.withColumn("shot_no", F.row_number().over(w)).withColumn("_n", F.row_number().over(wr) - 1)
    s = s.withColumn("club_id", F.when(F.col("category") == "putting", "Putter").otherwise(map_club(F.col("club"))))
    putt = (F.col("category") == "putting") | (F.col("club_id") == "Putter")
    start = F.when(F.col("category") == "driving", "tee").otherwise(map_lie(F.col("startLie")))
    dist_w, lat_w = miss_signs("missNote")
    drive_lat = F.when(F.col("category") == "driving", F.when(F.col("side") == "left", -F.col("offlineYds")).otherwise(F.col("offlineYds")))
    dist = F.when(F.col("category") == "driving", None).otherwise(F.coalesce(F.when(F.col("missDist") == "long", 1).when(F.col("missDist") == "short", -1), dist_w))
    lat = F.when(F.col("category") == "driving", F.signum(drive_lat).cast("int")).otherwise(F.coalesce(F.when(F.col("missLat") == "right", 1).when(F.col("missLat") == "left", -1), lat_w))
    made = F.when(F.col("category") == "putting", F.col("result") == "make").otherwise(F.coalesce("holed", F.lit(False)))
    total = F.when(F.col("category") == "approach", F.coalesce("missTotalYds", r1(F.col("missTotalFt") / 3))).when(F.col("category") == "shortGame", r1(F.col("toHoleFt") / 3))
    kind = (F.when(putt, "putt").when(start == "recovery", "recovery").when((F.col("category") == "shortGame") & (F.col("startYds") < 50), "finesse").otherwise("full"))
    return s.select("key", "hole", "shot_no", F.concat_ws(":", F.lit("sp"), "date", "hole", "shot_no").alias("id"), "category",
                    F.timestamp_seconds(F.unix_timestamp(F.concat("date", F.lit(" 12:00:00"))) + F.col("_n")).alias("ts"), "club_id", start.alias("start_lie"), map_lie(F.col("endLie")).alias("end_lie"),
                    F.when(F.lower("startLie") == "deep rough", "deep").alias("lie_detail"), kind.alias("shot_type"),
                    F.when(F.col("category") == "driving", F.get("_yds", F.col("hole") - 1)).otherwise(F.col("startYds")).alias("start_yds"),
                    F.coalesce("startFt", F.when(putt, F.col("startYds") * 3)).alias("putt_ft"), made.alias("made"), drive_lat.alias("lateral_miss_yds"),
                    F.when(putt & made, 0).otherwise(dist).alias("dist_sign"), F.when(putt & made, 0).otherwise(lat).alias("lat_sign"), total.alias("miss_total_yds"), "sg")


def write_bundle(shots: DataFrame, path: str) -> None:
    """O-06: the flattened rounds, clustered by round key and in playing order inside each file."""
    shots.repartitionByRange("key").sortWithinPartitions("key", "hole", "shot_no").write.mode("overwrite").parquet(path)


def stale(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """O-06 check: rows in one build and not in the other; empty means up to date."""
    return fresh.exceptAll(stored.select(*fresh.columns)).unionByName(stored.select(*fresh.columns).exceptAll(fresh))


def migrate(shots: DataFrame) -> DataFrame:
    """O-17: a missing schema is 1; any other version stops the job."""
    v = F.coalesce("schema", F.lit(1))
    return shots.withColumn("schema", F.when(v == 1, v).otherwise(F.raise_error(F.concat(F.lit("unknown schema "), v.cast("string"))).cast("int")))


def to_backup(rows: DataFrame, key: str, exported_at: str) -> DataFrame:
    """O-16: one ``{schema, exportedAt, key, row}`` JSON line per row, so an export scales with its files."""
    return rows.select(F.col(key).alias("key"), F.to_json(F.struct(F.lit(1).alias("schema"), F.lit(exported_at).alias("exportedAt"), F.array(F.struct(*rows.columns)).alias("rounds"))).alias("value"))


def from_backup(lines: DataFrame, row_schema: str) -> DataFrame:
    """Reads a wrapped object or a bare array; lines that are neither, or rows without an id, are dropped."""
    obj = F.from_json("value", f"struct<rounds:array<struct<{row_schema}>>>")
    arr = F.from_json("value", f"array<struct<{row_schema}>>")
    return lines.select(F.explode(F.coalesce(obj["rounds"], arr)).alias("r")).select("r.*").filter("id IS NOT NULL")
