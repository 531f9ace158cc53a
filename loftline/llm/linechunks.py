"""Line dedup: content-defined chunks of lines, repeated ones removed after comparing their bytes.

Lines are hashed; two rolling hashes over neighbouring line hashes decide where a text is cut: before a line by the
pair that it begins, after a line by the pair that it ends.  Either pair lies inside a passage whose first or last
line it is, so the cuts move with the passage wherever it stands.  Several seeds cut the same text differently; what
one cutting tears the next may hold together.  In one more cutting every line stands alone, and long lines count.  Only native column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.llm.common import settled, text_of

SEEDS = 6
#: A pair of lines is a cut if its hash digit for the seed and side is below this, 5 times in 16.
CUT = "5"
MIN_LINES, MIN_CHARS = 2, 150
#: A line of more words than this is a passage of its own.
LONG_WORDS = 50
#: Repeated hashes that are broadcast at most: 50 bytes each.
BROADCAST = 500_000


def _starts(seed: int) -> Column:
    """First lines of the runs between the cuts of one seed, counted from 0, from the pair hashes ``_p``."""
    below = lambda at, digit: F.coalesce(F.substring(F.get("_p", at), digit, 1) < CUT, F.lit(False))
    return F.filter(F.sequence(F.lit(0), F.size("_l") - 1),
                    lambda i: (i == 0) | below(i, 2 * seed + 1) | below(i - 2, 2 * seed + 2))


def _places(starts: str) -> Column:
    """The runs of at least MIN_LINES between the cuts of one seed, each as one number: first line and line after it."""
    runs = F.transform(starts, lambda s, k: F.struct(s.alias("start"), F.coalesce(F.get(starts, k + 1), F.size("_l")).alias("end")))
    return F.transform(F.filter(runs, lambda r: r["end"] - r["start"] >= MIN_LINES), lambda r: F.shiftleft(r["start"].cast("long"), 32) + r["end"])


def _long_lines() -> Column:
    """The last cutting: every line alone, and of those the long ones, in the form of :func:`_places`."""
    gaps = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    long = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: gaps(F.element_at("_l", i + 1)) >= LONG_WORDS)
    return F.transform(long, lambda i: F.shiftleft(i.cast("long"), 32) + i + 1)


def _chunk(place: Column, with_text: bool) -> Column:
    """(start, end, hash, chars, chunk) of a place; the hash is that of the hashes of the lines."""
    start, end = F.shiftright(place, 32).cast("int"), place.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    part = lambda of: F.slice(of, start + 1, end - start)
    text = F.array_join(part("_l"), "\n")
    return F.struct(start.alias("start"), end.alias("end"), F.unhex(F.md5(F.array_join(part("_h"), ":"))).alias("hash"), F.length(text).alias("chars"),
                    *([text.alias("chunk")] if with_text else []))


def chunk_rows(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(_key, doc_id, start, end, hash): each chunk of MIN_LINES lines and MIN_CHARS characters of each cutting, and each
    long line; its text if asked for.

    A chunk that several cuttings have is one; places are compared as numbers, which Spark does by hashing, so that a
    text of any number of lines takes time in proportion.
    """
    lined = docs.select("_key", "doc_id", F.split("_t", "\n", -1).alias("_l")).filter(F.size("_l") >= MIN_LINES)
    hashed = lined.withColumn("_h", F.transform("_l", lambda x: F.substring(F.md5(x), 1, 16)))
    pairs = hashed.withColumn("_p", F.transform(F.slice("_h", 1, F.size("_h") - 1), lambda h, i: F.md5(F.concat(h, F.lit(":"), F.get("_h", i + 1)))))
    starts = pairs.select("_key", "doc_id", "_l", "_h", *[_starts(k).alias(f"_s{k}") for k in range(SEEDS)])
    places = starts.select("_key", "doc_id", "_l", "_h", F.array_distinct(F.concat(*[_places(f"_s{k}") for k in range(SEEDS)], _long_lines())).alias("_c"))
    # chunks are cut before the rows are made, so that no row carries the lines of its whole document
    rows = places.select("_key", "doc_id", F.inline(F.transform("_c", lambda c: _chunk(c, with_text))))
    return rows.filter(F.col("chars") >= MIN_CHARS).drop("chars")


def line_dedup(docs: DataFrame, few_hashes: int = BROADCAST) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from ``text``; (n_lines, n_removed) are added.

    A chunk is repeated if the same bytes are a chunk of another place.  Its first place, the least (doc_id, start),
    keeps it; null ids are last.  Chunks with one hash but other bytes are left alone.  A document's lines that lie
    in any removed chunk go; the others stay in order.  Null text counts as empty; texts of a single line, and short
    chunks, are never cut: a whole text that repeats is no passage of another.  Rows that repeat both id and text are one place and are treated alike.

    Hashes and places come first; texts are read again only for hashes met more than once and compared by their least
    and greatest bytes.  Counts and texts are combined map-side and joined back, so a passage that many documents share
    is a skewed join, which Spark splits.  The repeated hashes are counted and broadcast while there are at most
    ``few_hashes``; beyond that both joins are Spark's, and rows come out the same.
    """
    identity = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of()))
    keyed = docs.drop("n_lines", "n_removed").withColumns({"_t": text_of(), "_key": F.unhex(identity)})
    cut = keyed.select("_key", "doc_id", "_t")
    chunks = settled(chunk_rows(cut))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key", "start")
    twice = settled(chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
                    .select("hash", F.col("first._key").alias("_fk"), F.col("first.start").alias("_fs")))
    few = twice.count() <= few_hashes
    sent = F.broadcast if few else (lambda df: df)
    met = chunks.join(sent(twice), "hash")
    if few:
        texts = chunk_rows(cut, with_text=True).select("hash", "chunk").join(sent(twice.select("hash")), "hash")
    else:   # by document: the texts that hold such a chunk are dealt once, not every chunk of every cutting
        spans = met.groupBy("_key").agg(F.collect_set(F.struct("start", "end", "hash")).alias("_s"))
        size = lambda r: F.least(r["end"], F.size("_l")) - r["start"]
        texts = (cut.join(spans, "_key").withColumn("_l", F.split("_t", "\n", -1))
                 .select(F.inline(F.transform("_s", lambda r: F.struct(r["hash"], F.array_join(F.slice("_l", r["start"] + 1, size(r)), "\n").alias("chunk"))))))
    differ = texts.groupBy("hash").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).filter("lo <> hi").select("hash")
    gone = (met.filter((F.col("_key") != F.col("_fk")) | (F.col("start") != F.col("_fs")))
            .join(differ, "hash", "left_anti").groupBy("_key").agg(F.collect_set(F.struct("start", "end")).alias("_runs")))
    lines, n = F.split("_t", "\n", -1), F.size(F.split("_t", "\n", -1))
    removed = F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.sequence(r["start"], r["end"] - 1))))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), removed)
    out = keyed.drop("text").join(gone, "_key", "left").withColumns({"_l": lines, "_kept": kept})
    text = F.array_join(F.transform("_kept", lambda i: F.element_at("_l", i + 1)), "\n")
    return (out.withColumns({"text": F.when(F.col("_runs").isNull(), F.col("_t")).otherwise(text), "n_lines": F.size("_l").cast("long"),
                             "n_removed": F.when(F.col("_runs").isNull(), F.lit(0)).otherwise(F.size("_l") - F.size("_kept")).cast("long")})
            .select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"))


#: The same rows in DuckDB, by numbering lines and summing cuts.
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS k FROM documents),
l AS (SELECT k, doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM d),
h AS (SELECT *, substr(md5(line), 1, 16) AS h FROM l),
n AS (SELECT *, md5(h || ':' || lead(h) OVER (PARTITION BY k ORDER BY i)) AS p FROM h),
q AS (SELECT *, lag(p, 2) OVER (PARTITION BY k ORDER BY i) AS p2 FROM n),
s AS (SELECT q.*, seed, (i = 0 OR seed = {SEEDS} OR coalesce(substr(p, 2 * seed + 1, 1) < '{CUT}', false) OR coalesce(substr(p2, 2 * seed + 2, 1) < '{CUT}', false)) AS cut
      FROM q, (SELECT unnest(range({SEEDS} + 1)) AS seed)),
g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY k, seed ORDER BY i) AS c FROM s),
c AS (SELECT DISTINCT k, doc_id, a, b, chunk FROM (
        SELECT k, any_value(doc_id) AS doc_id, min(i) AS a, max(i) AS b, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS m, count(*) OVER (PARTITION BY k, seed) AS parts, seed FROM g GROUP BY k, seed, c)
      WHERE length(chunk) >= {MIN_CHARS} AND CASE WHEN seed = {SEEDS} THEN length(chunk) - length(replace(chunk, ' ', '')) >= {LONG_WORDS} AND parts >= {MIN_LINES} ELSE m >= {MIN_LINES} END),
f AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS LAST, k, a) AS r FROM c),
x AS (SELECT DISTINCT k, unnest(range(a, b + 1)) AS i FROM f WHERE r > 1),
o AS (SELECT l.k, count(*) AS n_lines, count(x.i) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL), '') AS text
      FROM l LEFT JOIN x ON l.k = x.k AND l.i = x.i GROUP BY l.k)
SELECT q.doc_id, o.n_lines, o.n_removed, o.text FROM documents q
JOIN o ON o.k = md5(concat(coalesce(CAST(q.doc_id AS VARCHAR), ''), ':', coalesce(q.text, '')))
"""
