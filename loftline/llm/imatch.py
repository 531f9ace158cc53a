"""Document fingerprints by I-Match: distinct terms inside a band of inverse document frequency, sorted and hashed,
over the whole lexicon and over several randomised parts of it.  Only native column functions are used.

The band keeps terms found in at least LOW and at most HIGH of all documents.  Documents of T distinct terms on
average have at most T / LOW such terms, whatever their number, so the lexicon stays small while a corpus grows.  It
is counted, and broadcast only while it has at most MOST terms; beyond that the join is left to Spark.

A part of the lexicon is drawn by a hash of the term with a seed: one term in 4, 16, 64 and so on.  Thin parts hold a
term or two of a long document, thick ones those of a short document, and a part stays equal as long as none of its
terms goes or comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.llm.common import settled, text_of

LOW, HIGH, MOST = 1 / 2000, 1 / 4, 2_000_000
SEEDS, LEVELS = 12, (4, 16, 64, 256, 1024)
#: Documents in a range of ids, which one task sorts, and least and greatest number of ranges.
RANGE, RANGES = 20_000, (256, 8192)


def _words(text: Column) -> Column:
    """Distinct lower-case words, and always the empty one, which stands for the document itself."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(text), "[^\\p{L}\\p{N}]+", -1)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term) hashes of the words of column ``t`` in the band.  All documents count; counts are combined map-side."""
    n = docs.count()
    terms = docs.select(F.explode(_words(F.col("t"))).alias("w")).select(F.xxhash64("w").alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = df.filter(F.col("df").between(max(2.0, low * n), max(2.0, high * n)) & (F.col("term") != _every()))
    return settled(kept.select("term"))


def _every() -> Column:
    return F.xxhash64(F.lit(""))


def _drawn(seed: int, share: int):
    return lambda x: F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(share)) == 0


def _signed(df: DataFrame) -> DataFrame:
    """Adds ``sigs``: the hash of all sorted ``terms`` (of the text where there are none), then of each part, level by
    level and seed by seed; null where a part has no term."""
    df = df.withColumns({f"_p{s}_{LEVELS[0]}": F.filter("terms", _drawn(s, LEVELS[0])) for s in range(SEEDS)})
    for a, b in zip(LEVELS, LEVELS[1:]):   # parts are nested, so each is drawn from the one before
        df = df.withColumns({f"_p{s}_{b}": F.filter(f"_p{s}_{a}", _drawn(s, b)) for s in range(SEEDS)})
    mark = lambda c: F.when(F.size(c) > 0, F.xxhash64(c))
    parts = [f"_p{s}_{m}" for m in LEVELS for s in range(SEEDS)]
    return df.withColumn("sigs", F.array(F.coalesce(mark("terms"), F.col("hx")), *[mark(p) for p in parts])).drop(*parts)


def likeness(a: str, b: str) -> Column:
    """1 where all terms agree; else the largest share, over the levels, of parts with terms that are equal.

    A level in which few parts have terms says little: its share is of half the seeds at least.
    """
    levels = []
    for k in range(len(LEVELS)):
        at = F.sequence(F.lit(1 + k * SEEDS), F.lit((k + 1) * SEEDS))
        same = F.size(F.filter(at, lambda i: F.get(a, i) == F.get(b, i)))
        some = F.size(F.filter(at, lambda i: F.coalesce(F.get(a, i), F.get(b, i)).isNotNull()))
        levels.append(same / F.greatest(some, F.lit(SEEDS // 2)).cast("double"))
    return F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), F.lit(1.0)).otherwise(F.greatest(*levels))


def _printed(sigs: str) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.coalesce(F.lower(F.right(F.lpad(F.hex(x), F.lit(16), F.lit("0")), F.lit(8))), F.lit("-"))), ".")


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows with their range ``b`` in descending doc_id; null ids come last.

    The borders are at most ``ranges`` quantiles, in order; a row looks among every 64th of them first and then among
    the 64 that are left, so it compares with few whatever their number.
    """
    q = [k / ranges for k in range(1, ranges)]
    borders = sorted(set(docs.select(F.percentile_approx("doc_id", q, max(20000, 4 * ranges))).first()[0] or []))
    row = docs.select("doc_id", "t", F.bitwise_not("doc_id").alias("o1"), F.md5("t").alias("o2"))
    if not borders:
        return row.withColumn("b", F.lit(0))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    over = lambda xs: F.size(F.filter(xs, lambda x: x > F.col("doc_id")))
    heads = borders[::64]
    row = row.withColumn("_j", F.lit(len(heads)) - over(longs(heads)))   # blocks that do not begin above the id
    rest = F.when(F.col("_j") > 0, over(F.slice(longs(borders), (F.col("_j") - 1) * 64 + 1, 64))).otherwise(0)
    above = F.lit(len(borders)) - F.least(F.col("_j") * 64, F.lit(len(borders))) + rest
    return row.withColumn("b", F.when(F.col("doc_id").isNull(), F.lit(len(borders) + 1)).otherwise(above)).drop("_j")


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(b, rn, halo, doc_id, t, nt): nt is the text of the next document in descending doc_id, of the first after the last.

    Each range is ordered by itself; a copy of the next range's first row (``halo``) closes it.  Of rows that repeat an
    id, the one whose text has the smaller checksum comes first.
    """
    own = _in_ranges(docs, ranges)
    first = own.groupBy("b").agg(F.min(F.struct(F.col("o1").isNull(), "o1", "o2")).alias("f"))   # a row for each range
    by = Window.orderBy("b")
    heads = first.select("b", F.col("f.o1").alias("o1"), F.col("f.o2").alias("o2"),
                         F.coalesce(F.lag("b").over(by), F.max("b").over(Window.partitionBy())).alias("to"))
    h = F.broadcast(heads.select(*[F.col(c).alias(f"_{c}") for c in heads.columns]))   # at most ranges + 2 rows
    halo = (own.join(h, (F.col("b") == F.col("_b")) & F.col("o1").eqNullSafe(F.col("_o1")) & (F.col("o2") == F.col("_o2")))
            .groupBy("_to").agg(F.first("t").alias("t"), F.first("doc_id").alias("doc_id"), F.first("o1").alias("o1"), F.first("o2").alias("o2")))
    rows = own.withColumn("halo", F.lit(False)).unionByName(halo.withColumnRenamed("_to", "b").withColumn("halo", F.lit(True)))
    w = Window.partitionBy("b").orderBy("halo", F.col("o1").asc_nulls_last(), "o2")
    return rows.select("b", F.row_number().over(w).alias("rn"), "halo", "doc_id", "t", F.lead("t").over(w).alias("nt"))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", low: float = LOW, high: float = HIGH,
                 ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last half replaced by the start of the next document's.  Null text counts as empty.  A text
    without terms in the band is known by the hash of the whole text.  Equal texts have equal fingerprints; repeated
    rows follow one another.  A single row is its own next.  No other columns are read.  Documents are put in order in
    ``ranges`` of ids, by default as many as hold RANGE documents each.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t"))
    terms = lexicon(base, low, high)
    small = terms.count() <= MOST
    words = terms.unionByName(docs.sparkSession.range(1).select(_every().alias("term")))
    half = F.col("n") - F.expr("n div 2").cast("int")
    ranges = ranges or min(RANGES[1], max(RANGES[0], base.count() // RANGE))
    x = with_next(base, ranges).withColumn("n", F.length("t")).withColumn(
        "ed", F.when(~F.col("halo"), F.concat(F.substr("t", F.lit(1), half), F.substr("nt", F.lit(1), F.col("n") - half))))
    key = ["b", "rn", "halo", "doc_id", "n", "sha"]
    both = x.select("b", "rn", "halo", "doc_id", "n", F.sha2("ed", 256).alias("sha"), F.explode(F.filter(F.array(
        F.struct(F.lit(0).alias("which"), F.col("t").alias("txt")), F.struct(F.lit(1).alias("which"), F.col("ed").alias("txt"))),
        lambda e: e["txt"].isNotNull())).alias("e"))
    split = both.select(*key, "e.which", F.xxhash64("e.txt").alias("hx"), F.explode(_words(F.col("e.txt"))).alias("w"))
    kept = split.withColumn("term", F.xxhash64("w")).drop("w").join(F.broadcast(words) if small else words, "term")
    sets = kept.groupBy(*key, "which", "hx").agg(F.sort_array(F.collect_list("term")).alias("terms"))   # at most the band of one text
    signed = _signed(sets.withColumn("terms", F.array_remove("terms", _every())))
    one = signed.groupBy(*key).agg(*[F.first(F.when(F.col("which") == k, F.col("sigs")), ignorenulls=True).alias(c) for k, c in ((0, "own"), (1, "edited"))])
    following = one.withColumn("next", F.lead("own").over(Window.partitionBy("b").orderBy("rn"))).filter(~F.col("halo"))
    return following.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"),
                            _printed("own").alias("fingerprint"), _printed("edited").alias("edited_fingerprint"),
                            likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"))
