"""Weather: rain windows, night figures, course conditions, as-of enrichment (O-14, O-35, A-27, J-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.functions.numbers import c, r1
from loftline.settings import DEFAULTS, Settings, lookup

TO_MPH = {"mph": 1.0, "km/h": 0.621371, "m/s": 2.236936, "kn": 1.150779}   # fixed values: unit factors


def to_mph(v, unit) -> Column:
    return c(v) * lookup(c(unit), TO_MPH, 1.0)


def to_f(v, unit) -> Column:
    metric = c(unit).contains("C") & ~c(unit).contains("F")
    return F.when(F.coalesce(metric, F.lit(False)), c(v) * 9 / 5 + 32).otherwise(c(v))


def parse_hours(docs: DataFrame, column: str) -> DataFrame:
    """O-14: the hourly arrays of a response as rows, in millimetres, Fahrenheit and miles an hour."""
    schema = ("course_id long, units struct<t:string,w:string>, hourly struct<time:array<long>,precipitation:array<double>,"
              "temperature_2m:array<double>,dew_point_2m:array<double>,cloud_cover:array<double>,wind_speed_10m:array<double>>")
    d = docs.select(F.from_json(column, schema).alias("d"))
    h = d.select("d.course_id", "d.units", F.explode(F.arrays_zip("d.hourly.time", "d.hourly.precipitation", "d.hourly.temperature_2m", "d.hourly.dew_point_2m",
                                                               "d.hourly.cloud_cover", "d.hourly.wind_speed_10m")).alias("h"))
    return h.select("course_id", F.col("h.time").alias("t_s"), F.col("h.precipitation").alias("rain_mm"), to_f("h.temperature_2m", "units.t").alias("temp_f"),
                    to_f("h.dew_point_2m", "units.t").alias("dew_f"), F.col("h.cloud_cover").alias("cloud"), to_mph("h.wind_speed_10m", "units.w").alias("wind"))


def parse_current(docs: DataFrame, column: str) -> DataFrame:
    """O-14: the current block of a response: wind, where it blows from, temperature, dew point, cloud, rain; to a tenth.

    A response without a current wind and its direction has no row.
    """
    schema = ("course_id long, current_units struct<wind_speed_10m:string,temperature_2m:string>, utc_offset_seconds long, current struct<time:long,wind_speed_10m:double,"
              "wind_direction_10m:double,temperature_2m:double,dew_point_2m:double,cloud_cover:double,precipitation:double>")
    d = docs.select(F.from_json(column, schema).alias("d")).select("d.*").filter("current.wind_speed_10m IS NOT NULL AND current.wind_direction_10m IS NOT NULL")
    deg = F.coalesce(F.col("current_units.temperature_2m"), F.lit(""))
    mph = to_mph("current.wind_speed_10m", F.coalesce(F.col("current_units.wind_speed_10m"), F.lit("mph")))
    return d.select("course_id", F.col("current.time").alias("as_of_s"), r1(mph).alias("wind_mph"), F.pmod("current.wind_direction_10m", F.lit(360.0)).alias("wind_from_deg"),
                    r1(to_f("current.temperature_2m", deg)).alias("temp_f"), r1(to_f("current.dew_point_2m", deg)).alias("dew_f"), F.col("current.cloud_cover").alias("cloud"),
                    F.col("current.precipitation").alias("rain_mm"), F.col("utc_offset_seconds").alias("utc_offset_s"))


def parse_daily(docs: DataFrame, column: str, before: int = 5) -> DataFrame:
    """O-14: (course_id, sunrise_s, rain_days, tmax_days) from the daily block: the sunrise of the day that the current time
    lies in, or of the last day, and rain and highest temperature of the up to ``before`` days ahead of it, to a tenth."""
    schema = ("course_id long, current struct<time:long>, daily_units struct<temperature_2m_max:string>, daily struct<time:array<long>,precipitation_sum:array<double>,temperature_2m_max:array<double>,sunrise:array<long>>")
    d = docs.select(F.from_json(column, schema).alias("d")).select("d.*")
    days, now = F.col("daily.time"), F.col("current.time")
    today = F.coalesce(F.array_max(F.filter(F.transform(days, lambda t, i: F.when((t <= now) & (now < t + 86400), i)), lambda i: i.isNotNull())), F.size(days) - 1)
    d = d.withColumn("_t", F.when(F.size(days) > 0, today))
    n = F.least(F.lit(before), F.col("_t"))
    past = lambda a: F.when(F.col("_t") > 0, F.slice(a, F.col("_t") - n + 1, n)).otherwise(F.slice(a, 1, 0))
    unit = F.coalesce(F.col("daily_units.temperature_2m_max"), F.lit(""))
    return d.select("course_id", F.get("daily.sunrise", F.col("_t")).alias("sunrise_s"), F.transform(past(F.col("daily.precipitation_sum")), r1).alias("rain_days"),
                    F.transform(past(F.col("daily.temperature_2m_max")), lambda v: r1(to_f(v, unit))).alias("tmax_days"))


def by_hour(hours: DataFrame) -> DataFrame:
    """Readings of one course and time put together, so that a question meets a time once however many readings it has."""
    return hours.groupBy("course_id", "t_s").agg(
        F.sum("rain_mm").alias("rain"), F.min(F.col("temp_f") - F.col("dew_f")).alias("spread"),
        F.sum("cloud").alias("cloud"), F.count("cloud").alias("cloud_n"), F.sum("wind").alias("wind"), F.count("wind").alias("wind_n"))


def _asked(hours: DataFrame, asof: DataFrame, after: Column, upto: Column, span_s: int) -> DataFrame:
    """(q_id, readings' figures) of the readings in (after, upto] of each question; a window is at most ``span_s`` long.

    A window is cut at the multiple of the largest power of two in it.  What lies before the cut is the end of one bucket of
    that width, what lies after it the beginning of the next; figures run up from the beginnings of buckets and down from their
    ends, and a question reads one of each.  So readings and questions are never paired, however many share a day.
    Each question has one or two rows here, to be added up.
    """
    top = max(span_s - 1, 1).bit_length()
    lo, hi = F.floor(after), F.floor(upto)
    q = asof.select("q_id", "course_id", lo.alias("_lo"), hi.alias("_hi")).filter("course_id IS NOT NULL AND _lo < _hi")
    apart = F.col("_lo").bitwiseXOR(F.col("_hi"))
    q = q.withColumn("_k", F.when(apart < 0, top).otherwise(F.least(F.lit(top), F.length(F.bin(apart)) - 1)).cast("int"))
    bucket = lambda v: F.call_function("shiftright", v, F.col("_k"))
    # places on one scale: a reading stands at an even number, a question between two; buckets are walked from their ends with negative places
    ends = F.array(F.struct(F.lit(0).alias("side"), bucket(F.col("_hi")).alias("b"), (F.col("_hi") * 2 + 1).alias("o")),
                   F.struct(F.lit(1).alias("side"), (bucket(F.col("_hi")) - 1).alias("b"), (F.col("_lo") * -2 - 1).alias("o")))
    q = q.select("q_id", "course_id", "_k", F.inline(ends)).withColumn("_q", F.lit(True))
    h = by_hour(hours).filter("course_id IS NOT NULL AND t_s IS NOT NULL")
    figures = [k for k in h.columns if k not in ("course_id", "t_s")]
    h = h.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("b", bucket(F.col("t_s")))
    # below the top only every second bucket comes after a cut, and the others before one
    half = F.struct(F.pmod(F.col("b") + 1, F.lit(2)).cast("int").alias("side"), F.when(F.pmod("b", F.lit(2)) == 1, F.col("t_s") * 2).otherwise(F.col("t_s") * -2).alias("o"))
    both = F.array(F.struct(F.lit(0).alias("side"), (F.col("t_s") * 2).alias("o")), F.struct(F.lit(1).alias("side"), (F.col("t_s") * -2).alias("o")))
    h = h.select("course_id", "_k", "b", *figures, F.inline(F.when(F.col("_k") < top, F.array(half)).otherwise(both)))
    least = q.select("_k").distinct()
    u = h.join(F.broadcast(least), "_k").unionByName(q, allowMissingColumns=True)
    w = Window.partitionBy("course_id", "_k", "b", "side").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    run = [(F.min if k == "spread" else F.sum)(k).over(w).alias(k) for k in figures]
    return u.select("q_id", "_q", *run).filter("_q").drop("_q")


def _means() -> list[Column]:
    return [F.min("spread").alias("spread"), (F.sum("cloud") / F.nullif(F.sum("cloud_n"), F.lit(0))).alias("cloud"), (F.sum("wind") / F.nullif(F.sum("wind_n"), F.lit(0))).alias("wind")]


def rain_windows(hours: DataFrame, asof: DataFrame) -> DataFrame:
    """A-27: rain over (asOf - 12 h, asOf] and (asOf - 24 h, asOf] per question, and spread, cloud and wind of the 24 hours."""
    last = F.col("asof_s")
    late = _asked(hours, asof, last - 43200, last, 43200).select("q_id", F.col("rain").alias("late"))
    day = _asked(hours, asof, last - 86400, last, 86400)
    g = day.unionByName(late, allowMissingColumns=True).groupBy("q_id").agg(F.sum("late").alias("rain12"), F.sum("rain").alias("rain24"), *_means())
    return asof.join(g, "q_id", "left")


def night_block(hours: DataFrame, asof: DataFrame) -> DataFrame:
    """A-27: least spread, mean cloud and mean wind of the night: the 8 hours before ``sunrise_s``, cut at the question.

    To a tenth; null where the night has no reading of a kind.
    """
    g = _asked(hours, asof, F.col("sunrise_s") - 28800, F.least("sunrise_s", "asof_s"), 28800).groupBy("q_id").agg(*_means())
    return asof.join(g, "q_id", "left").withColumns({c_: r1(F.col(c_) + 1e-9) for c_ in ("spread", "cloud", "wind")})


def conditions(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """O-35: the first rule that fires: rain, dew, irrigation, firm; else normal.  A missing input fails its rule.

    Columns: rain12, rain24, spread, cloud, wind, since_sunrise_h, month, hour (course-local), dry_days, day_mm_max, tmax.
    """
    no = F.lit(False)
    rain = F.coalesce(F.col("rain12") >= cfg.rain_mm_12h, no) | F.coalesce(F.col("rain24") >= cfg.rain_mm_24h, no)
    dew = ((F.col("since_sunrise_h") < cfg.dew_hours_after_sunrise) & (F.col("spread") <= cfg.dew_spread_f) & (F.col("cloud") <= cfg.dew_cloud_pct) & (F.col("wind") <= cfg.dew_wind_mph))
    irrigated = F.col("month").isin(*cfg.irrigation_months) & (F.col("hour") < cfg.irrigation_before_hour)
    firm = ((F.col("dry_days") >= cfg.firm_dry_days) & (F.col("day_mm_max") < cfg.firm_day_mm) & (F.col("rain24") < cfg.firm_day_mm) & (F.col("tmax") >= cfg.firm_tmax_f))
    return df.withColumn("conditions", F.when(rain, "wet").when(F.coalesce(dew, no), "wet").when(F.coalesce(irrigated, no), "wet").when(F.coalesce(firm, no), "firm").otherwise("normal"))


def as_of(questions: DataFrame, reports: DataFrame, key: str, bucket_s: int = 86400, cfg: Settings = DEFAULTS) -> DataFrame:
    """J-09: the latest good report at or before each question, stale past 15 minutes; temperature only when fresh.

    Both sides go through one window per (key, day); what stands at the end of earlier days comes in as one
    carried row per day, so a busy course's history is never sorted in one task.
    """
    a = reports.select(key, F.col("fetched_s").alias("t"), F.lit(0).alias("_q"), F.lit(None).cast("long").alias("q_id"), F.struct(F.col("fetched_s").alias("f"), F.col("temp_f").alias("temp")).alias("r"))
    b = questions.select(key, F.col("asof_s").alias("t"), F.lit(1).alias("_q"), "q_id", F.lit(None).cast("struct<f:bigint,temp:double>").alias("r"))
    u = a.unionByName(b).withColumn("_b", F.floor(F.col("t") / bucket_s))
    last = u.groupBy(key, "_b").agg(F.max_by("r", F.when(F.col("_q") == 0, F.struct("t", "r"))).alias("_last"))
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(key, "_b", F.last("_last", ignorenulls=True).over(wb).alias("_carry"))
    w = Window.partitionBy(key, "_b").orderBy("t", "_q", "r").rowsBetween(Window.unboundedPreceding, 0)
    j = u.join(carry, [key, "_b"]).withColumn("_r", F.coalesce(F.last("r", ignorenulls=True).over(w), F.col("_carry"))).filter("_q = 1")
    stale = F.col("t") - F.col("_r.f") >= cfg.weather_fresh_min * 60
    return j.select("q_id", F.col("_r.f").alias("fetched_s"), stale.alias("stale"), F.when(~stale, F.col("_r.temp")).alias("temp_f"))
