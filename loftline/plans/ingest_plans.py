"""Registered queries for sources, weather and trails (O-01 .. O-17, O-35, A-27, J-09, J-14, J-15, W-09, S-01 .. S-11)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from loftline.functions.numbers import half_up
from loftline.operators import nines as N
from loftline.operators import weather as W
from loftline.operators.skew import evaluated_once
from loftline.plans.registry import HU, ORACLES, query
from loftline.session import work_folder
from loftline.settings import DEFAULTS
from loftline.sources import maps as M
from loftline.sources import reports as R
from loftline.sources import shotlists as L
from loftline.streaming import enrich
from loftline.streaming import trails as T

# gps_v is sparse in time, so limits are rescaled: 20 m and 12 h
SPARSE = DEFAULTS.merged({"thin_m": 20.0, "thin_s": 43200.0, "stop_radius_m": 25.0, "stop_min_s": 3600.0, "stop_match_yds": 12.0})

#: Parts that a file of the map snapshot tells about, some 1 KB each.
FILE_PARTS = 2_000


@query("report_lines", r"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN regexp_matches(line, '[0-9]+') THEN 1 ELSE 0 END) AS BIGINT) AS with_number, CAST(max(length(line)) AS INT) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def report_lines(d):
    """O-07: whole texts to numbered lines, then one pattern per layout."""
    ls = R.lines(d.documents, "doc_id", F.col("text"))
    return ls.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.when(F.col("line").rlike("[0-9]+"), 1).otherwise(0)).alias("with_number"), F.max(F.length("line")).alias("longest"))


@query("stitched_rows", """WITH l AS (SELECT doc_id, line, line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)-1 AS line_no FROM documents)), w AS (SELECT *, lead(line,1) OVER v AS l1, lead(line,2) OVER v AS l2 FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(length(concat_ws(' ', line, l1, l2)) AS INT) AS row_len FROM w WHERE regexp_matches(line, '^[A-Z]')""")
def stitched_rows(d):
    s = R.stitched(R.lines(d.documents, "doc_id", F.col("text")), "doc_id", "^[A-Z]", 2)
    return s.select("doc_id", "line_no", F.length("row").alias("row_len"))


CLUBS = R.Layout("clubs", "B A G  M A P P I N G", "P U T T I N G", (r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)$",), (("club", "text"), ("shots", "num"), ("miss", "num"), ("straight", "pct")))
PUTTS = R.Layout("putting", "P U T T I N G", None, (r"^(\S+)$", r"^(\d+)-(\d+) ft\s+(\S+)\s+(\S+)$", r"^(\d+) / (\d+)$"),
                 (("three", "pct"), ("from_ft", "num"), ("to_ft", "num"), ("n", "num"), ("leave", "feet"), ("three_n", "num"), ("of_n", "num")))


def _cells(name):
    """Every seventh row's cell is spoilt, every fifth has no value; both by the row's count."""
    return lambda v: F.when(F.col(name) % 7 == 0, "?!").when(F.col(name) % 5 == 0, "N/A").otherwise(F.replace(v.cast("string"), F.lit("-"), F.lit("−")))


def reports(d):
    """A printed report for each player: a table of clubs and one of putts with three lines a row."""
    c = d.shots.groupBy("player_id", "club").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("dist_miss_yds"), 1).alias("miss"), half_up(F.avg(F.when(F.abs("lat_miss_yds") <= 5, 100.0).otherwise(0.0)), 1).alias("st"))
    line = F.concat_ws("  ", "club", F.format_number("n", 0), _cells("n")(F.col("miss")), F.concat(F.col("st").cast("string"), F.lit("%")))
    clubs = c.groupBy("player_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n\n").alias("clubs"))
    p = d.shots.filter("shot_type = 'putt'").groupBy("player_id", F.floor(F.col("putt_ft") / 10).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("made")).alias("three"), F.max(F.col("putt_ft") % 12).cast("int").alias("inch"))
    b = F.col("b") * 10
    rows = F.concat_ws("\n", F.concat(half_up(F.col("three") * 100.0 / F.col("n"), 1).cast("string"), F.lit("%")),
                       F.concat(b, F.lit("-"), b + 10, F.lit(" ft  "), F.col("n"), F.lit("  "), F.when(F.col("n") % 7 == 0, "?!").otherwise(F.concat(F.col("b"), F.lit("'"), F.col("inch"), F.lit('"')))),
                       F.concat(F.col("three"), F.lit(" / "), F.col("n")))
    putts = p.groupBy("player_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", rows.alias("r")))), lambda x: x["r"]), "\nsee the notes\n").alias("putts"))
    return clubs.join(putts, "player_id").select("player_id", F.concat(F.lit("Report\n"), F.lit(CLUBS.start), F.lit("\nclub shots miss\n"), "clubs", F.lit("\n" + PUTTS.start + "\nby distance\n"), "putts").alias("text"))


@query("report_clubs", f"""SELECT player_id, club, CAST(n AS DOUBLE) AS shots, CASE WHEN n%7<>0 AND n%5<>0 THEN miss END AS miss, st/100 AS straight, CAST(n%7=0 AS INT) AS bad FROM (SELECT player_id, club, count(*) AS n, {HU('avg(dist_miss_yds)', 1)} AS miss,
 {HU('avg(CASE WHEN abs(lat_miss_yds)<=5 THEN 100.0::DOUBLE ELSE 0 END)', 1)} AS st FROM shots_v GROUP BY ALL) WHERE player_id IN (SELECT player_id FROM shots_v WHERE shot_type='putt')""", ("shots_v",))
def report_clubs(d):
    """O-07, rows of one line: what was printed is read back."""
    r = R.report_rows(reports(d), "player_id", "text", [CLUBS, PUTTS]).filter("section = 'clubs'")
    return r.select("player_id", F.col("texts")["club"].alias("club"), *[F.col("numbers")[k].alias(k) for k in ("shots", "miss", "straight")], F.size("bad").alias("bad"))


@query("report_putts", f"""SELECT player_id, CAST(b*10 AS DOUBLE) AS from_ft, CAST(b*10+10 AS DOUBLE) AS to_ft, CAST(n AS DOUBLE) AS n, {HU('th*100.0::DOUBLE/n', 1)}/100 AS three, CASE WHEN n%7<>0 THEN b+inch/12.0::DOUBLE END AS leave, CAST(th AS DOUBLE) AS three_n, CAST(row_number() OVER (PARTITION BY player_id ORDER BY b) AS INT) AS row_no, CAST(n%7=0 AS INT) AS bad
 FROM (SELECT player_id, floor(putt_ft/10) AS b, count(*) AS n, count(*) FILTER (NOT made) AS th, CAST(max(putt_ft%12) AS INT) AS inch FROM shots_v WHERE shot_type='putt' GROUP BY ALL)""", ("shots_v",))
def report_putts(d):
    """O-07, rows of three lines with lines of prose between them."""
    r = R.report_rows(reports(d), "player_id", "text", [CLUBS, PUTTS]).filter("section = 'putting'")
    return r.select("player_id", "row_no", *[F.col("numbers")[k].alias(k) for k in ("from_ft", "to_ft", "n", "three", "leave", "three_n")], F.size("bad").alias("bad"))


@query("vocabulary", """SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN 'Dr' WHEN 1 THEN '7i' WHEN 2 THEN NULL WHEN 3 THEN 'PW' ELSE 'Putter' END AS club, CASE p_size%4 WHEN 0 THEN 'rough' WHEN 1 THEN 'sand' WHEN 2 THEN 'tee' ELSE NULL END AS lie FROM part""")
def vocabulary(d):
    k, s = F.col("p_partkey") % 5, F.col("p_size") % 4
    name = F.when(k == 0, " Driver").when(k == 1, "7I").when(k == 2, "Unknown Club").when(k == 3, "pw ").otherwise("putter")
    lie = F.when(s == 0, "Deep Rough").when(s == 1, "bunker").when(s == 2, "TEE")
    return d.part.select("p_partkey", L.map_club(name).alias("club"), L.map_lie(lie).alias("lie"))


CATS = {"driving": "lie='tee' AND shot_type<>'putt'", "approach": "lie<>'tee' AND shot_type IN ('full','finesse')", "shortGame": "lie<>'tee' AND shot_type='shortGame'", "putting": "shot_type='putt'"}


@query("flatten_rounds", f"""WITH c AS (SELECT *, CASE {' '.join(f"WHEN {w} THEN {i}" for i, w in enumerate(CATS.values()))} END AS rank FROM shots_v),
 w AS (SELECT *, CAST(row_number() OVER (PARTITION BY round_id, hole ORDER BY rank, shot_id) AS INT) AS no FROM c),
 m AS (SELECT *, part_no%3 AS note FROM w)
SELECT CAST(round_id AS VARCHAR) AS key, CAST(hole AS INT) AS hole, no AS shot_no, CASE rank WHEN 0 THEN 'driving' WHEN 1 THEN 'approach' WHEN 2 THEN 'shortGame' ELSE 'putting' END AS category,
 CASE WHEN rank=3 THEN 'Putter' ELSE club END AS club_id, CASE rank WHEN 0 THEN 'tee' WHEN 3 THEN 'green' ELSE lie END AS start_lie, coalesce(end_lie, 'rough') AS end_lie,
 CASE WHEN rank=3 THEN 'putt' WHEN rank=2 AND to_pin_yds<50 THEN 'finesse' ELSE 'full' END AS shot_type,
 CASE WHEN rank=0 THEN CAST(300+hole*10 AS DOUBLE) WHEN rank=3 THEN NULL ELSE CAST(to_pin_yds AS DOUBLE) END AS start_yds, CASE WHEN rank=3 THEN CAST(putt_ft AS DOUBLE) END AS putt_ft,
 rank=3 AND part_no%2=0 AS made,
 CASE WHEN rank=0 THEN NULL WHEN rank=3 AND part_no%2=0 THEN 0 WHEN note=0 THEN -1 WHEN note=1 THEN 1 END AS dist_sign,
 CASE WHEN rank=0 THEN CAST(sign(lat_miss_yds) AS INT) WHEN rank=3 AND part_no%2=0 THEN 0 WHEN note=0 THEN -1 WHEN note=2 THEN 1 END AS lat_sign FROM m""", ("shots_v",))
def flatten_rounds(d):
    """O-02/O-05: round documents of all four categories built from the tables, parsed back and flattened."""
    rank = F.expr("CASE " + " ".join(f"WHEN {w} THEN '{c}'" for c, w in CATS.items()) + " END")
    note = F.when(F.col("part_no") % 3 == 0, "short left").when(F.col("part_no") % 3 == 1, "long").otherwise("right")
    row = {"hole": F.col("hole").cast("int"), "club": F.lower("club"), "startYds": F.col("to_pin_yds").cast("double"), "startLie": F.col("lie"), "endLie": F.coalesce("end_lie", F.lit("rough")),
           "offlineYds": F.abs("lat_miss_yds"), "side": F.when(F.col("lat_miss_yds") < 0, "left").otherwise("right"), "missNote": note, "startFt": F.col("putt_ft").cast("double"),
           "result": F.when(F.col("part_no") % 2 == 0, "make").otherwise("miss")}
    bare = {"driving": ["startFt", "startYds", "missNote"], "approach": ["startFt"], "shortGame": ["startFt"], "putting": ["startYds", "startLie"]}
    said = lambda c: F.struct(*[v.alias(k) for k, v in row.items() if k not in bare[c] and (c == "putting" or k != "result")])
    of = lambda c: F.sort_array(F.collect_list(F.when(F.col("_c") == c, F.struct("shot_id", said(c).alias("r")))))["r"]
    s = d.shots.withColumn("_c", rank).groupBy("round_id").agg(*[of(c).alias(c) for c in CATS])
    head = F.struct(F.lit("2026-01-05").alias("date"), F.transform(F.sequence(F.lit(1), F.lit(18)), lambda h: (h * 10 + 300).cast("double")).alias("yardsPerHoleSP"))
    doc = s.select(F.col("round_id").cast("string").alias("key"), F.to_json(F.struct(F.lit(1).alias("schema"), head.alias("round"), *CATS)).alias("j"))
    f = L.flatten(evaluated_once(doc.select("key", F.from_json("j", L.ROUND).alias("r"))).select("key", "r.*"))
    return f.select("key", "hole", "shot_no", "category", "club_id", F.coalesce("start_lie", F.when(F.col("category") == "putting", "green")).alias("start_lie"), "end_lie", "shot_type", "start_yds", "putt_ft", "made", "dist_sign", "lat_sign")


@query("bundle_roundtrip", ORACLES["flatten_rounds"])
def bundle_roundtrip(d):
    """O-06: the flattened rounds written as a bundle and read again."""
    fresh, folder = flatten_rounds(d), work_folder(d.spark)
    L.write_bundle(fresh, folder)
    stored = d.spark.read.parquet(folder)
    return stored.select(*fresh.columns)


@query("bundle_stale", f"SELECT key, CAST(count(*) AS BIGINT) AS n FROM ({ORACLES['flatten_rounds']}) WHERE shot_no=1 GROUP BY key")
def bundle_stale(d):
    """O-06 check: first shots are missing from the stored bundle, and are what it finds."""
    fresh = flatten_rounds(d)
    return L.stale(fresh, fresh.filter("shot_no > 1")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("backup_roundtrip", "SELECT o_orderkey AS id, o_orderstatus AS body FROM orders")
def backup_roundtrip(d):
    rows = d.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("body"))
    return L.from_backup(L.to_backup(rows, "id", "2026-01-01T00:00:00Z"), "id:long,body:string")


@query("migrate_schema", "SELECT o_orderkey AS id, CAST(1 AS INT) AS schema FROM orders")
def migrate_schema(d):
    return L.migrate(d.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, 1).alias("schema")))


@query("map_features", """SELECT p_partkey AS id, CASE p_partkey%5 WHEN 0 THEN 'green' WHEN 1 THEN 'trees' WHEN 2 THEN 'water' WHEN 3 THEN 'bunker' END AS kind, CAST(4 AS INT) AS points FROM part WHERE p_partkey%5<>4""")
def map_features(d):
    k = F.col("p_partkey") % 5
    tags = F.map_filter(F.create_map(F.lit("golf"), F.when(k == 0, "green").when(k == 3, "bunker").when(k == 4, "cartpath"), F.lit("natural"), F.when(k.isin(1, 3, 4), "wood").when(k == 2, "water")), lambda a, v: v.isNotNull())
    p = lambda a, b: F.struct((F.lit(34.0) + a).alias("lat"), (F.lit(-84.0) + b).alias("lon"))
    e = F.struct(F.col("p_partkey").alias("id"), F.lit("way").alias("type"), tags.alias("tags"), F.array(p(0.0, 0.0), p(0.1, 0.0), p(0.1, 0.1), p(0.0, 0.1), p(0.0, 0.0)).alias("geometry"))
    doc = d.part.select(F.to_json(F.struct(F.array(e).alias("elements"))).alias("j"))
    return M.features(M.parse_elements(doc, "j")).select("id", "kind", F.size("ring").alias("points"))


def snapshot(d):
    """The path of an OSM XML snapshot with a relation for each part: an outer ring of two ways, one of them against the
    ring's direction and missing for every fourth part, and a clearing."""
    p = F.col("p_partkey")
    at = lambda k, la, lo: F.format_string('<node id="%d" lat="%.6f" lon="%.6f"/>', p * 100 + k, F.lit(34.0) + p * 0.001 + la * 0.0001, F.lit(-84 + lo * 0.0001))
    way = lambda k, *nodes: F.concat(F.format_string('<way id="%d">', p * 10 + k), *[F.format_string('<nd ref="%d"/>', p * 100 + n) for n in nodes], F.lit('<tag k="source" v="trace"/></way>'))
    member = lambda k, role: F.format_string(f'<member type="way" ref="%d" role="{role}"/>', p * 10 + k)
    tag = F.when(p % 3 == 0, '<tag k="natural" v="wood"/>').when(p % 3 == 1, '<tag k="golf" v="fairway"/>').otherwise('<tag k="highway" v="path"/>')
    rel = F.concat(F.format_string('<relation id="%d">', p), member(1, "outer"), member(3, "inner"), F.format_string('<member type="node" ref="%d" role="label"/>', p * 100), member(2, "outer"), tag, F.lit("</relation>"))
    corners = [at(k, *c) for k, c in enumerate([(0, 0), (0, 8), (8, 8), (8, 0), (2, 2), (2, 4), (4, 4), (4, 2)])]
    lines = F.array(*corners, way(1, 0, 1, 2), F.when(p % 4 != 0, way(2, 0, 3, 2)), way(3, 4, 5, 6, 7, 4), rel)

    def framed(batches):   # every file is a document
        lines = lambda text: pa.RecordBatch.from_arrays([text], ["value"])
        yield lines(pa.array(["<osm>"]))
        for batch in batches:
            yield lines(batch.column(0))
        yield lines(pa.array(["</osm>"]))
    folder = work_folder(d.spark)
    # a file is parsed by one task
    d.part.repartition(max(1, d.part.count() // FILE_PARTS)).select(F.explode(F.array_compact(lines)).alias("value")).mapInArrow(framed, "value string").write.text(folder)
    return folder


@query("osm_relations", f"""SELECT p_partkey AS id, CASE WHEN p_partkey%3=0 THEN 'trees' ELSE 'fairway' END AS kind, CAST(4 AS INT) AS points, CAST(1 AS INT) AS clearings, {HU('34+p_partkey*0.001::DOUBLE+0.0004::DOUBLE+1e-9', 6)} AS lat, {HU('-84+0.0004::DOUBLE+1e-9', 6)} AS lon FROM part WHERE p_partkey%4<>0 AND p_partkey%3<2""")
def osm_relations(d):
    """O-11: an XML snapshot written from the table, its relations resolved over ways and nodes, rings stitched."""
    f = M.relation_features(M.osm_elements(d.spark, snapshot(d)))
    mean = lambda v: half_up(F.aggregate("ring", F.lit(0.0), lambda s, q: s + q[v]) / F.size("ring") + 1e-9, 6)
    return f.select("id", "kind", F.size("ring").alias("points"), F.size("inner").alias("clearings"), mean("lat").alias("lat"), mean("lon").alias("lon"))


@query("hole_keys", """SELECT p_partkey AS id, CASE WHEN row_number() OVER (PARTITION BY p_partkey%20, p_partkey%18 ORDER BY p_partkey)=1 THEN CAST(p_partkey%18+1 AS VARCHAR) ELSE (p_partkey%18+1)||'@'||p_partkey END AS key FROM part""")
def hole_keys(d):
    h = d.part.select((F.col("p_partkey") % 20).alias("course_id"), (F.col("p_partkey") % 18 + 1).alias("ref"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"))
    return M.hole_keys(h).select("id", "key")


@query("feature_twins", """WITH l AS (SELECT p_partkey%20 AS course_id, p_partkey AS feature_id, p_partkey%18+1 AS hole FROM part), h AS (SELECT DISTINCT course_id, hole FROM l WHERE (course_id+hole)%5<>0)
SELECT * FROM l UNION SELECT l.course_id, feature_id, h.hole FROM l JOIN h ON h.course_id=l.course_id AND h.hole=CASE WHEN l.hole>9 THEN l.hole-9 ELSE l.hole+9 END""")
def feature_twins(d):
    k = F.col("p_partkey")
    links = d.part.select((k % 20).alias("course_id"), k.alias("feature_id"), (k % 18 + 1).alias("hole"))
    holes = links.select("course_id", "hole").distinct().filter("(course_id + hole) % 5 <> 0")
    return M.mirror_links(links, holes, 9)


HOLES27 = """nh AS (SELECT p_partkey%60 AS course_id, CAST(CAST(floor(p_partkey/60) AS INT)%27+1 AS INT) AS ref, CAST(CASE WHEN p_partkey%60<50 THEN CAST(floor(p_partkey/60) AS INT)%27+1 ELSE p_partkey END AS VARCHAR) AS key,
  CASE WHEN p_partkey%3=0 THEN CASE CAST(floor(CAST(floor(p_partkey/60) AS INT)%27/9) AS INT) WHEN 0 THEN 'Village ' WHEN 1 THEN 'School ' ELSE 'Mill-pond ' END || CAST(CAST(floor(p_partkey/60) AS INT)%9+1 AS VARCHAR) END AS name, min(p_partkey) AS id FROM part GROUP BY ALL)"""


def holes27(d):
    k = F.floor(F.col("p_partkey") / 60).cast("int") % 27
    word = F.when(F.floor(k / 9) == 0, "Village ").when(F.floor(k / 9) == 1, "School ").otherwise("Mill-pond ")
    h = d.part.select((F.col("p_partkey") % 60).alias("course_id"), (k + 1).alias("ref"), F.when(F.col("p_partkey") % 60 < 50, k + 1).otherwise(F.col("p_partkey")).cast("string").alias("key"),
                      F.when(F.col("p_partkey") % 3 == 0, F.concat(word, (k % 9 + 1).cast("string"))).alias("name"))
    return h.distinct()


def routings27(d):
    ids = d.part.select((F.col("p_partkey") % 60).alias("course_id")).distinct()
    named = F.col("course_id") % 3 == 0
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return ids.select("course_id", F.when(named, words("Village", "School", "Mill-pond")).when(F.col("course_id") % 3 == 1, words("1", "2", "3")).otherwise(words("Oak", "Elm", "Ash")).alias("club"),
                      F.when(named, words("School", "Mill-pond")).when(F.col("course_id") % 3 == 1, words("3", "1")).otherwise(words("Elm", "Ash")).alias("play"), (F.col("course_id") % 2 == 0).alias("ordered"))


MAP27 = f"""{HOLES27}, nine AS (SELECT course_id, key, CASE WHEN course_id%3=0 THEN CASE split_part(name, ' ', 1) WHEN 'Village' THEN 1 WHEN 'School' THEN 2 WHEN 'Mill-pond' THEN 3 END ELSE CAST(ceil(ref/9.0) AS INT) END AS nine, (ref-1)%9+1 AS hole, count(*) OVER (PARTITION BY course_id, ref) AS same FROM nh),
 whole AS (SELECT course_id, nine FROM nine WHERE nine=ANY(CASE course_id%3 WHEN 0 THEN [2,3] WHEN 1 THEN [3,1] ELSE [2,3] END) GROUP BY ALL HAVING count(*)=9 AND count(DISTINCT hole)=9),
 good AS (SELECT course_id FROM whole GROUP BY 1 HAVING count(*)=2), dup AS (SELECT DISTINCT course_id FROM nine WHERE same>1),
 mp AS (SELECT course_id, key, CAST(nine AS INT) AS nine, CAST(hole AS INT) AS hole FROM nine WHERE course_id IN (SELECT course_id FROM good) AND (course_id%3=0 OR (course_id NOT IN (SELECT course_id FROM dup) AND (course_id%3=1 OR course_id%2=0))))"""


@query("nine_map", f"WITH {MAP27} SELECT course_id, key, nine, hole FROM mp")
def nine_map(d):
    return N.nine_map(holes27(d), routings27(d))


@query("card_hole_key", f"""WITH {MAP27}, c AS (SELECT DISTINCT course_id, CASE WHEN course_id IN (SELECT course_id FROM mp) THEN CASE course_id%3 WHEN 1 THEN [3,1] ELSE [2,3] END END AS play FROM nh), n AS (SELECT *, unnest(range(1,19)) AS card_hole FROM c),
 f AS (SELECT course_id, nine, hole, min(key) AS k FROM mp GROUP BY ALL)
SELECT n.course_id, CAST(card_hole AS INT) AS card_hole, CASE WHEN play IS NULL THEN (SELECT min(key) FROM nh WHERE nh.course_id=n.course_id AND nh.key=CAST(card_hole AS VARCHAR)) ELSE f.k END AS key FROM n LEFT JOIN f ON f.course_id=n.course_id AND f.nine=play[CASE WHEN card_hole<=9 THEN 1 ELSE 2 END] AND f.hole=(card_hole-1)%9+1""")
def card_hole_key(d):
    h, r = holes27(d), routings27(d)
    m = N.nine_map(h, r)
    play = F.when(F.col("course_id") % 3 == 1, F.array(F.lit(3), F.lit(1))).otherwise(F.array(F.lit(2), F.lit(3)))
    c = r.select("course_id").join(m.select("course_id", F.lit(1).alias("_m")).distinct(), "course_id", "left").select("course_id", F.when(F.col("_m").isNotNull(), play).alias("play"))
    return N.card_hole_keys(c, h, m)


@query("coverage_check", """WITH m AS (SELECT p_partkey%40 AS course_id, CAST(p_partkey%18+1 AS INT) AS hole, bool_or(p_size%7=0) AS g FROM part GROUP BY ALL) SELECT c.course_id, CAST(h AS INT) AS hole, CASE WHEN m.g IS NULL THEN 'no line' ELSE 'no green' END AS reason FROM (SELECT DISTINCT p_partkey%40 AS course_id FROM part) c CROSS JOIN (SELECT unnest(range(1,19)) AS h) LEFT JOIN m ON m.course_id=c.course_id AND m.hole=h WHERE m.g IS NULL OR NOT m.g""")
def coverage_check(d):
    k = F.col("p_partkey")
    m = d.part.groupBy((k % 40).alias("course_id"), (k % 18 + 1).cast("int").alias("hole")).agg(F.max(F.col("p_size") % 7 == 0).alias("has_green")).withColumn("has_line", F.lit(True))
    return M.coverage(d.part.select((k % 40).alias("course_id")).distinct().withColumn("n_holes", F.lit(18)), m)


HRS = "h AS (SELECT user_id%20 AS course_id, CAST(floor(epoch(ts)) AS BIGINT) AS t_s, value/10 AS rain_mm, 50+value AS temp_f, 45+value*0.9 AS dew_f, CAST(event_id%100 AS DOUBLE) AS cloud, CAST(event_id%12 AS DOUBLE) AS wind, event_id FROM events)"


def hours(d):
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    v = F.col("value")
    return d.events.select((F.col("user_id") % 20).alias("course_id"), t.alias("t_s"), (v / 10).alias("rain_mm"), (v + 50).alias("temp_f"), (v * 0.9 + 45).alias("dew_f"),
                           (F.col("event_id") % 100).cast("double").alias("cloud"), (F.col("event_id") % 12).cast("double").alias("wind"), "event_id")


@query("weather_current", f"""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS as_of_s, {HU("event_id%12*CASE event_id%3 WHEN 0 THEN 1 WHEN 1 THEN 0.621371::DOUBLE ELSE 2.236936::DOUBLE END", 1)} AS wind_mph, CAST(event_id*37%360 AS DOUBLE) AS wind_from_deg,
 {HU("CASE WHEN event_id%2=0 THEN value*9/5+32 ELSE value END", 1)} AS temp_f, CASE WHEN event_id%5<>0 THEN CAST(event_id%100 AS DOUBLE) END AS cloud FROM events WHERE event_id%7<>0""")
def weather_current(d):
    """O-14: a response for each event, in three units of wind and two of heat; one in seven has no wind and no reading."""
    e = F.col("event_id")
    cur = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), F.when(e % 7 != 0, (e % 12).cast("double")).alias("wind_speed_10m"), (e * 37).cast("double").alias("wind_direction_10m"),
                   F.col("value").alias("temperature_2m"), F.when(e % 5 != 0, (e % 100).cast("double")).alias("cloud_cover"))
    units = F.struct(F.when(e % 3 == 0, F.lit(None)).when(e % 3 == 1, "km/h").otherwise("m/s").alias("wind_speed_10m"), F.when(e % 2 == 0, "°C").otherwise("°F").alias("temperature_2m"))
    docs = d.events.select(F.to_json(F.struct(e.alias("course_id"), cur.alias("current"), units.alias("current_units"))).alias("j"))
    return W.parse_current(docs, "j").select(F.col("course_id").alias("event_id"), "as_of_s", "wind_mph", "wind_from_deg", "temp_f", "cloud")


@query("weather_daily", f"""WITH e AS (SELECT user_id%20 AS course_id, CAST(floor(epoch(ts)/86400) AS BIGINT)*86400 AS day, value FROM events), dd AS (SELECT course_id, day, {HU('sum(value)/10+1e-9', 1)} AS rain, {HU('max(value)*9/5+32+1e-9', 1)} AS tmax FROM e GROUP BY course_id, day), rk AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY day DESC) AS rn FROM dd)
SELECT course_id, max(day) FILTER (rn=1)+21600+course_id*60 AS sunrise_s, coalesce(list(rain ORDER BY day) FILTER (rn BETWEEN 2 AND 6), []) AS rain_days, coalesce(list(tmax ORDER BY day) FILTER (rn BETWEEN 2 AND 6), []) AS tmax_days FROM rk GROUP BY course_id""")
def weather_daily(d):
    """O-14: a response for each course with all its days, asked on the last one."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = d.events.select((F.col("user_id") % 20).alias("course_id"), t.alias("t"), (F.floor(t / 86400) * 86400).alias("day"), "value")
    days = e.groupBy("course_id", "day").agg((F.sum("value") / 10 + 1e-9).alias("rain"), (F.max("value") + 1e-9).alias("tmax"), F.max("t").alias("t"))
    g = days.groupBy("course_id").agg(F.max("t").alias("now"), F.array_sort(F.collect_list(F.struct("day", "rain", "tmax"))).alias("a"))
    daily = F.struct(F.col("a.day").alias("time"), F.col("a.rain").alias("precipitation_sum"), F.col("a.tmax").alias("temperature_2m_max"), F.transform("a.day", lambda x: x + 21600 + F.col("course_id") * 60).alias("sunrise"))
    docs = g.select(F.to_json(F.struct("course_id", F.struct(F.col("now").alias("time")).alias("current"), F.struct(F.lit("°C").alias("temperature_2m_max")).alias("daily_units"), daily.alias("daily"))).alias("j"))
    return W.parse_daily(docs, "j")


RAIN = f"{HRS}, q AS (SELECT event_id AS q_id, course_id, t_s AS asof_s FROM h), w AS (SELECT q.q_id, sum(rain_mm) FILTER (t_s>asof_s-43200) AS rain12, sum(rain_mm) AS rain24, min(temp_f-dew_f) AS spread, avg(cloud) AS cloud, avg(wind) AS wind FROM q JOIN h ON h.course_id=q.course_id AND t_s<=asof_s AND t_s>asof_s-86400 GROUP BY q.q_id)"


def rain(d):
    h = hours(d)
    return W.rain_windows(h.drop("event_id"), h.select(F.col("event_id").alias("q_id"), "course_id", F.col("t_s").alias("asof_s")))


@query("rain_windows", f"WITH {RAIN} SELECT q_id, {HU('rain12+1e-9', 4)} AS rain12, {HU('rain24+1e-9', 4)} AS rain24, {HU('spread+1e-9', 4)} AS spread FROM w")
def rain_windows(d):
    return rain(d).select("q_id", *[half_up(F.col(f) + 1e-9, 4).alias(f) for f in ("rain12", "rain24", "spread")])


NIGHT = f"{RAIN}, nq AS (SELECT *, asof_s-asof_s%86400+18000+q_id%3*3600 AS rise FROM q), nt AS (SELECT nq.q_id, floor((min(temp_f-dew_f)+1e-9)*10+0.5)/10 AS spread, floor((avg(cloud)+1e-9)*10+0.5)/10 AS cloud, floor((avg(wind)+1e-9)*10+0.5)/10 AS wind FROM nq LEFT JOIN h ON h.course_id=nq.course_id AND t_s>rise-28800 AND t_s<=least(rise, asof_s) GROUP BY nq.q_id)"


def night(d):
    h = hours(d)
    rise = F.col("t_s") - F.col("t_s") % 86400 + 18000 + F.col("event_id") % 3 * 3600
    return W.night_block(h.drop("event_id"), h.select(F.col("event_id").alias("q_id"), "course_id", F.col("t_s").alias("asof_s"), rise.alias("sunrise_s")))


@query("night_block", f"WITH {NIGHT} SELECT q_id, spread, cloud, wind FROM nt")
def night_block(d):
    """A-27: every reading asks about the night before it, and every reading answers."""
    return night(d).select("q_id", "spread", "cloud", "wind")


@query("course_conditions", f"""WITH {NIGHT} SELECT q_id, CASE WHEN rain12>=5 OR rain24>=10 THEN 'wet' WHEN q_id%7<3 AND spread<=3 AND cloud<=40 AND wind<=5 THEN 'wet' WHEN q_id%12+1 IN (6,7,8,9) AND q_id%24<10 THEN 'wet' WHEN q_id%5>=3 AND q_id%3<2.5 AND rain24<2.5 AND q_id%50+50>=85 THEN 'firm' ELSE 'normal' END AS conditions FROM (SELECT q_id, rain12, rain24 FROM w) JOIN nt USING (q_id)""")
def course_conditions(d):
    k = F.col("q_id")
    r = rain(d).drop("spread", "cloud", "wind").join(night(d).select("q_id", "spread", "cloud", "wind"), "q_id").withColumn("since_sunrise_h", (k % 7).cast("double")).withColumn("month", k % 12 + 1).withColumn("hour", k % 24).withColumn("dry_days", k % 5).withColumn("day_mm_max", (k % 3).cast("double")).withColumn("tmax", (k % 50 + 50).cast("double"))
    return W.conditions(r).select("q_id", "conditions")


@query("weather_asof", f"""WITH {HRS}, r AS (SELECT course_id, t_s, max(temp_f) AS temp FROM h GROUP BY ALL), q AS (SELECT event_id AS q_id, course_id, t_s+event_id%4*600 AS t_s FROM h)
SELECT q_id, r.t_s AS fetched_s, q.t_s-r.t_s>=900 AS stale, CASE WHEN q.t_s-r.t_s<900 THEN {HU('temp', 6)} END AS temp_f FROM q ASOF LEFT JOIN r ON q.course_id=r.course_id AND q.t_s>=r.t_s""")
def weather_asof(d):
    """J-09: every reading is a report, and asks again up to half an hour later."""
    h = hours(d)
    rep = h.select("course_id", F.col("t_s").alias("fetched_s"), "temp_f")
    q = h.select(F.col("event_id").alias("q_id"), "course_id", (F.col("t_s") + F.col("event_id") % 4 * 600).alias("asof_s"))
    return W.as_of(q, rep, "course_id").withColumn("temp_f", half_up("temp_f", 6))


@query("weather_due", f"""WITH {HRS}, r AS (SELECT course_id, t_s, max(CASE WHEN event_id%3<>0 THEN temp_f END) AS temp FROM h GROUP BY ALL), g AS (SELECT * FROM r WHERE temp IS NOT NULL), q AS (SELECT event_id AS q_id, course_id, t_s+event_id%4*600 AS t_s FROM h),
 a AS (SELECT q_id, q.course_id, q.t_s, g.t_s AS good FROM q ASOF LEFT JOIN g ON q.course_id=g.course_id AND q.t_s>=g.t_s), b AS (SELECT a.*, r.t_s AS lst, r.temp IS NOT NULL AS ful FROM a ASOF LEFT JOIN r ON a.course_id=r.course_id AND a.t_s>=r.t_s)
SELECT q_id, good AS fetched_s, CASE WHEN lst IS NULL THEN 'never' WHEN ful AND t_s-lst>=900 THEN 'stale' WHEN NOT ful AND t_s-lst>21600 THEN 'empty' END AS due FROM b""")
def weather_due(d):
    """S-09, one trigger over all readings; every third answer was empty and is kept for six hours."""
    h = hours(d)
    answers = h.select("course_id", F.col("t_s").alias("fetched_s"), F.when(F.col("event_id") % 3 != 0, F.col("temp_f")).alias("temp_f"))
    answers = answers.groupBy("course_id", "fetched_s").agg(F.max("temp_f").alias("temp_f"))
    q = h.select(F.col("event_id").alias("q_id"), "course_id", (F.col("t_s") + F.col("event_id") % 4 * 600).alias("asof_s"))
    return enrich.enriched(q, answers, empty_ttl_s=6 * 3600).select("q_id", "fetched_s", "due")


def fixes(d):
    return d.gps.select("player_id", F.to_date("ts").alias("day"), "event_id", "t_s", "lat", "lng", F.col("acc_m").cast("double").alias("acc_m"))


@query("trail_thin", """WITH RECURSIVE f AS (SELECT event_id, player_id, t_s, lat, lng, row_number() OVER w AS rn, min(event_id) OVER (PARTITION BY player_id, CAST(ts AS DATE)) AS g FROM gps_v WINDOW w AS (PARTITION BY player_id, CAST(ts AS DATE) ORDER BY t_s, event_id)),
 k AS (SELECT event_id, player_id, t_s, g, rn, t_s AS kt, lat AS kla, lng AS kln, true AS kept FROM f WHERE rn=1
  UNION ALL SELECT event_id, player_id, t_s, g, rn, CASE WHEN ok THEN t_s ELSE kt END, CASE WHEN ok THEN lat ELSE kla END, CASE WHEN ok THEN lng ELSE kln END, ok FROM (
   SELECT f.*, kt, kla, kln, f.t_s-kt>=43200 OR 2*6371008.8::DOUBLE*asin(least(1, sqrt(pow(sin(radians(lat-kla)/2),2)+cos(radians(kla))*cos(radians(lat))*pow(sin(radians(lng-kln)/2),2))))>=20 AS ok FROM k JOIN f ON f.g=k.g AND f.rn=k.rn+1))
 SELECT event_id, player_id, t_s FROM k WHERE kept""", ("gps_v",))
def trail_thin(d):
    """S-01: a fold over kept fixes; the stream form must keep the same rows (tests)."""
    return T.thin(fixes(d), SPARSE).select("event_id", "player_id", "t_s")


@query("trail_stops")
def trail_stops(d):
    return T.stops(fixes(d), SPARSE).select("player_id", "t0", "t1", "n", half_up("lat", 7).alias("lat"), half_up("lng", 7).alias("lng"), "acc_m")


@query("stop_match")
def stop_match(d):
    """P-19: every fix stands for a recorded shot; the greedy pairing is checked against a plain loop in the tests."""
    st = T.stops(fixes(d), SPARSE)
    starts = fixes(d).select("player_id", "day", "lat", "lng", F.col("event_id").alias("shot_id"), (F.col("event_id") % 18 + 1).cast("int").alias("shot_no"))
    return T.match_stops(st, starts, SPARSE).select("player_id", "t0", "shot_id", "shot_no", "dist_yds")


@query("next_shot", """SELECT player_id, round_id, hole, CAST(coalesce(min(CASE WHEN contact IS NULL AND shot_id%2=0 THEN shot_no END), max(shot_no)+1) AS INT) AS shot_no FROM shots_v GROUP BY ALL""", ("shots_v",))
def next_shot(d):
    return T.next_shot_no(d.shots.select("player_id", "round_id", "hole", "shot_no", F.col("contact").alias("lat"), (F.col("shot_id") % 2 == 1).alias("placed")))


@query("window_counts", """SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def window_counts(d):
    e = d.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return T.counts_per_window(e, "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("session_rounds", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts)-epoch(lag(ts) OVER w)<21600 THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS player_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS t0, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_rounds(d):
    e = d.events.select(F.col("user_id").alias("player_id"), F.col("ts").cast("timestamp").alias("ts"))
    return T.sessions(e, "6 hours").select("player_id", F.unix_seconds("start").alias("t0"), "n")
