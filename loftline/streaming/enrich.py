"""Weather for a stream of questions from a table that others keep writing to (S-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.operators.weather import as_of
from loftline.settings import DEFAULTS, Settings

#: Seconds that an empty answer stands before it is asked for again.
EMPTY_TTL_S = 7 * 86400
ANSWER = "course_id long, fetched_s long, temp_f double"


def enriched(questions: DataFrame, answers: DataFrame, key: str = "course_id", empty_ttl_s: int = EMPTY_TTL_S, cfg: Settings = DEFAULTS) -> DataFrame:
    """The questions (q_id, key, asof_s, ...) with the latest good answer at or before them, and whether to ask again.

    Answers: key, fetched_s, temp_f; an empty one has no temperature.  ``fetched_s``, ``stale`` and ``temp_f`` are those of
    :func:`weather.as_of`.  ``due``: never (no answer yet), stale (the latest is good but too old), empty (the latest is
    empty and has expired), else null: an empty answer keeps a course from being asked until then.
    """
    good = as_of(questions, answers.filter("temp_f IS NOT NULL"), key, cfg=cfg)
    always = cfg.merged({"weather_fresh_min": 1 << 40})
    full = F.col("temp_f").isNotNull().cast("double")
    last = as_of(questions, answers.select(key, "fetched_s", full.alias("temp_f")), key, cfg=always).select("q_id", F.col("fetched_s").alias("_last"), (F.col("temp_f") > 0).alias("_full"))
    out = questions.join(good, "q_id", "left").join(last, "q_id", "left")
    age = F.col("asof_s") - F.col("_last")
    due = (F.when(F.col("_last").isNull(), "never").when(F.col("_full") & (age >= cfg.weather_fresh_min * 60), "stale").when(~F.col("_full") & (age > empty_ttl_s), "empty"))
    return out.withColumn("due", due).drop("_last", "_full")


def weather_sink(answers_path: str, target: str, key: str = "course_id", empty_ttl_s: int = EMPTY_TTL_S, cfg: Settings = DEFAULTS):
    """S-09: a ``foreachBatch`` sink that enriches a micro-batch from the answers that are there when it runs.

    The table is listed and read anew for each micro-batch, so answers that came in between count.  A batch has a folder
    of its own under ``target``, written whole, so that a retry changes nothing.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        answers = spark.read.schema(ANSWER.replace("course_id", key)).option("recursiveFileLookup", "true").parquet(answers_path)
        enriched(batch, answers, key, empty_ttl_s, cfg).write.mode("overwrite").parquet(f"{target}/batch={epoch}")
    return write
