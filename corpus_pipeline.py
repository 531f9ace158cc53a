"""Documents to packed sequences: quality, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loftline.llm import jaccard, linechunks, mixing, packing, quality
from loftline.llm.common import shared_folder, table
from loftline.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores 0.3 or more; texts are unchanged."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, out="_score").filter("_score >= 0.3").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without repeated chunks of lines."""
    return _documents(linechunks.line_dedup(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a Jaccard similarity of 0.8 or more: the smallest id, null last; of repeated ids the least checksum."""
    keyed = docs.select(*COLUMNS, F.md5(F.coalesce("text", F.lit(""))).alias("_key"))
    groups = jaccard.near_groups(keyed, keep=("_key",))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")).alias("f"))
    chosen = first.select(F.col("f.doc_id").alias("_id"), F.col("f._key").alias("_k"))
    kept = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left_semi")
    once = kept.groupBy("doc_id", "_key").agg(F.min(F.struct(*COLUMNS[1:])).alias("r"))   # rows that repeat id and text
    return once.select("doc_id", "r.*").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it whole."""
    mixed = mixing.mix(docs.select(*COLUMNS), split=False, keep=("text", "lang", "n_chars")).filter("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_n")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its sequence and place there."""
    return packing.packed(docs, VOCABULARY)


STAGES = [("quality", keep_quality), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates),
          ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is kept as Parquet beside the checkpoints and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier is trained and has no SQL; tests hold the pipeline against a plain version of every later stage.
ORACLE_SQL = None
