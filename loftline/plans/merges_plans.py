"""Registered queries for merges and course lookups (M-01 .. M-08, J-01 .. J-03, J-11, J-12, J-19, O-15, O-28, O-29, O-48, A-34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loftline.operators import courses as K
from loftline.operators import merges as M
from loftline.plans.registry import query

ROWS = """lo AS (SELECT o_orderkey AS id, (o_orderkey*7919)%1009 AS stamp, o_orderstatus AS body FROM orders WHERE o_orderkey%3<>0), cl AS (SELECT o_orderkey AS id, (o_orderkey*104729)%1009 AS stamp, 'c'||o_orderstatus AS body FROM orders WHERE o_orderkey%4<>0 UNION ALL SELECT o_orderkey, (o_orderkey*7919)%1009, 'tie' FROM orders WHERE o_orderkey%10=1),
 tb AS (SELECT o_orderkey AS id, (o_orderkey*7919)%1009 AS stamp FROM orders WHERE o_orderkey%11=0)"""


def sides(d):
    k = F.col("o_orderkey")
    s1, s2 = (k * 7919 % 1009).alias("stamp"), (k * 104729 % 1009).alias("stamp")
    lo = d.orders.filter(k % 3 != 0).select(k.alias("id"), s1, F.col("o_orderstatus").alias("body"))
    cl = d.orders.filter(k % 4 != 0).select(k.alias("id"), s2, F.concat(F.lit("c"), F.col("o_orderstatus")).alias("body")).unionByName(
        d.orders.filter(k % 10 == 1).select(k.alias("id"), s1, F.lit("tie").alias("body")))
    return lo, d.orders.filter(k % 11 == 0).select(k.alias("id"), s1), cl


@query("lww_merge", f"""WITH {ROWS}, a AS (SELECT id, stamp, body, 0 AS p FROM cl UNION ALL SELECT id, stamp, body, 1 FROM lo UNION ALL SELECT id, stamp, NULL, 2 FROM tb),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stamp DESC, p DESC) AS rn FROM a) SELECT id, stamp, p=2 AS deleted, body, CASE WHEN p=0 THEN 'cloud' ELSE 'local' END AS source, p>0 AS push FROM r WHERE rn=1""")
def lww_merge(d):
    return M.last_write_wins(*sides(d))


@query("import_upsert", f"""WITH {ROWS}, c AS (SELECT id, max(stamp) AS stamp, arg_max(body, stamp) AS body FROM (SELECT * FROM cl WHERE body<>'tie') GROUP BY id)
SELECT coalesce(l.id, c.id) AS id, CASE WHEN c.id IS NULL OR c.stamp<=l.stamp THEN l.stamp ELSE c.stamp END AS stamp, CASE WHEN c.id IS NULL OR c.stamp<=l.stamp THEN l.body ELSE c.body END AS body,
 CASE WHEN c.id IS NULL THEN 'kept' WHEN l.id IS NULL THEN 'added' WHEN c.stamp>l.stamp THEN 'updated' ELSE 'unchanged' END AS action FROM lo l FULL JOIN c ON l.id=c.id""")
def import_upsert(d):
    lo, _, cl = sides(d)
    return M.import_upsert(lo, cl.filter("body <> 'tie'"))


NAME = "CASE o_custkey%4 WHEN 0 THEN 'Maple Links Golf Club' WHEN 1 THEN 'The Cedar Course at Oak Hill' WHEN 2 THEN 'Maple & Pine CC' ELSE 'Birch' END"
INAME = "CASE o_custkey%5 WHEN 0 THEN 'Maple' WHEN 1 THEN 'Oak Hill Cedar' WHEN 2 THEN 'pine maple golf' WHEN 3 THEN 'Golf Club' ELSE 'Birch GC' END"
WORDS = lambda c: f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w<>'' AND NOT list_contains(['golf','club','course','country','cc','gc','the','links','and','at','of'], w))"
MATCH = f"""pl AS (SELECT o_custkey%300 AS player_id, o_orderkey AS round_id, {NAME} AS course, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))%60 AS ud, o_orderkey%40+70 AS total FROM orders WHERE o_orderkey%2=0),
 im AS (SELECT o_custkey%300 AS player_id, o_orderkey AS key, {INAME} AS course, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))%60 AS day, o_orderkey%40+70 AS score FROM orders WHERE o_orderkey%2=1),
 h AS (SELECT im.key, pl.round_id, row_number() OVER (PARTITION BY im.key ORDER BY CASE WHEN total=score THEN 0 ELSE 1 END, pl.round_id) AS rn FROM im JOIN pl ON pl.player_id=im.player_id AND (im.day=ud OR im.day=ud-round_id%3%2)
  WHERE len({WORDS('pl.course')})>0 AND len({WORDS('im.course')})>0 AND CASE WHEN len({WORDS('pl.course')})<=len({WORDS('im.course')}) THEN list_has_all({WORDS('im.course')}, {WORDS('pl.course')}) ELSE list_has_all({WORDS('pl.course')}, {WORDS('im.course')}) END),
 mt AS (SELECT im.*, round_id AS matched, coalesce(CAST(round_id AS VARCHAR), 'sp:'||im.key) AS target_id FROM im LEFT JOIN h ON h.key=im.key AND rn=1)"""


def matched(d):
    k, day = F.col("o_orderkey"), F.datediff("o_orderdate", F.to_date(F.lit("1990-01-01"))) % 60
    base = d.orders.withColumn("player_id", F.col("o_custkey") % 300)
    pl = base.filter(k % 2 == 0).select("player_id", k.alias("round_id"), F.expr(NAME).alias("course"), day.alias("utc_day"), (day - k % 3 % 2).cast("int").alias("local_day"), (k % 40 + 70).alias("total"), k.alias("pos"))
    im = base.filter(k % 2 == 1).select("player_id", k.alias("key"), F.expr(INAME).alias("course"), day.alias("day"), (k % 40 + 70).alias("score"))
    return M.match_rounds(im, pl)


@query("round_match", f"WITH {MATCH} SELECT key, matched, target_id FROM mt")
def round_match(d):
    return matched(d).select("key", "matched", "target_id")


@query("seed_records", f"""WITH {MATCH}, st AS (SELECT key AS id, CASE WHEN key%3=0 THEN 'sp:'||key ELSE 'r'||key END AS att FROM im WHERE key%5<>0)
SELECT mt.key AS id, CASE WHEN att IS NULL THEN 'added' WHEN att='sp:'||mt.key AND target_id<>'sp:'||mt.key THEN 'moved' ELSE 'kept' END AS action, CASE WHEN att IS NULL OR (att='sp:'||mt.key AND target_id<>'sp:'||mt.key) THEN target_id ELSE att END AS round_id FROM mt LEFT JOIN st ON st.id=mt.key""")
def seed_records(d):
    b = matched(d).select(F.col("key").alias("id"), "target_id", F.concat(F.lit("sp:"), F.col("key").cast("string")).alias("fallback_id"))
    st = b.filter("id % 5 <> 0").select("id", F.when(F.col("id") % 3 == 0, F.col("fallback_id")).otherwise(F.concat(F.lit("r"), F.col("id").cast("string"))).alias("round_id"))
    return M.seed_records(st, b).select("id", "action", "round_id")


@query("teach_switch", """WITH t AS (SELECT s.round_id, shot_id, CASE WHEN s.round_id%7=0 THEN NULL WHEN s.round_id%7=1 THEN false ELSE teach END AS teach FROM shots_v s)
SELECT round_id, NOT bool_or(coalesce(NOT teach, false)) AS teaches, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY round_id""", ("shots_v",))
def teach_switch(d):
    sw = d.rounds.filter("round_id % 7 < 2").select("round_id", (F.col("round_id") % 7 == 0).alias("on"))
    s = M.set_teaching(d.shots.select("round_id", "shot_id", "teach"), sw)
    return M.round_teaches(s).join(s.groupBy("round_id").agg(F.count(F.lit(1)).alias("n")), "round_id")


@query("batch_replace", """WITH b AS (SELECT l_suppkey AS club, l_linenumber AS lie, l_orderkey AS batch, max(l_partkey) AS v FROM lineitem GROUP BY ALL), l AS (SELECT club, lie, arg_max(v, batch) AS v, max(batch) AS batch FROM b GROUP BY ALL), s AS (SELECT *, v%5<2 AS sparse FROM l)
SELECT club, lie, batch, v, sparse FROM s a WHERE NOT sparse OR NOT EXISTS (SELECT 1 FROM s b WHERE b.club=a.club AND NOT b.sparse)""")
def batch_replace(d):
    b = d.lineitem.groupBy(F.col("l_suppkey").alias("club"), F.col("l_linenumber").alias("lie"), F.col("l_orderkey").alias("batch")).agg(F.max("l_partkey").alias("v"))
    return M.replace_batches(b.withColumn("sparse", F.col("v") % 5 < 2), ["club", "lie"], "batch", "sparse", ["club"])


LOG = "lg AS (SELECT event_id%3000 AS id, event_id AS seq, CASE WHEN event_id%7=3 THEN 'delete' ELSE 'save' END AS op, value FROM events)"


@query("log_compact", f"WITH {LOG} SELECT id, seq, op, value FROM lg QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC)=1 AND op<>'delete'")
def log_compact(d):
    lg = d.events.select((F.col("event_id") % 3000).alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 3, "delete").otherwise("save").alias("op"), "value")
    return M.compact(lg)


@query("changed_rows", f"WITH {ROWS} SELECT id, stamp FROM lo WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.id=lo.id AND cl.stamp=lo.stamp)")
def changed_rows(d):
    lo, _, cl = sides(d)
    return M.changed_since(lo, cl).select("id", "stamp")


# ---- course and card lookups --------------------------------------------------------------------------
@query("same_course", f"""WITH n AS (SELECT p_partkey, p_name||' Golf Club' AS a, CASE p_partkey%3 WHEN 0 THEN split_part(p_name,' ',1)||' links' WHEN 1 THEN split_part(p_name,' ',2)||' & '||split_part(p_name,' ',1) ELSE 'The Course' END AS b FROM part)
SELECT p_partkey, len({WORDS('a')})>0 AND len({WORDS('b')})>0 AND CASE WHEN len({WORDS('a')})<=len({WORDS('b')}) THEN list_has_all({WORDS('b')}, {WORDS('a')}) ELSE list_has_all({WORDS('a')}, {WORDS('b')}) END AS same FROM n""")
def same_course(d):
    w = F.split("p_name", " ")
    a, m = F.concat(F.col("p_name"), F.lit(" Golf Club")), F.col("p_partkey") % 3
    b = F.when(m == 0, F.concat(w[0], F.lit(" links"))).when(m == 1, F.concat(F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.lit(" & "), w[0])).otherwise("The Course")
    return d.part.select("p_partkey", K.same_course(a, b).alias("same"))


CLUBS = "c AS (SELECT c_custkey AS id, c_custkey AS pos, CASE WHEN c_custkey%13=0 THEN '  ' ELSE '  '||CASE WHEN c_custkey%2=0 THEN upper(c_mktsegment) ELSE c_mktsegment END||'   Club '||(c_custkey%9)||' ' END AS club_name, CASE WHEN c_nationkey%3=0 THEN '' ELSE 'S'||c_nationkey END AS state FROM customer)"


def clubs(d):
    k = F.col("c_custkey")
    seg = F.when(k % 2 == 0, F.upper("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return d.customer.select(k.alias("id"), k.alias("pos"), F.when(k % 13 == 0, "  ").otherwise(F.concat(F.lit("  "), seg, F.lit("   Club "), k % 9, F.lit(" "))).alias("club_name"),
                             F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("S"), F.col("c_nationkey"))).alias("state"))


CK = "CASE WHEN trim(club_name)='' THEN NULL WHEN state='' THEN lower(regexp_replace(trim(club_name),'\\s+',' ','g')) ELSE lower(regexp_replace(trim(club_name),'\\s+',' ','g'))||'|'||lower(state) END"


@query("club_key", f"WITH {CLUBS} SELECT id, {CK} AS key FROM c")
def club_key(d):
    return clubs(d).select("id", K.club_key("club_name", "state").alias("key"))


@query("club_groups", f"WITH {CLUBS} SELECT coalesce({CK}, 'id:'||id) AS key, min(id) AS club_id, min(pos) AS first_pos, CAST(count(*) AS BIGINT) AS entries, arg_min(club_name, pos) AS club_name FROM c GROUP BY 1")
def club_groups(d):
    return K.group_results(clubs(d))


@query("club_entries", f"WITH {CLUBS} SELECT coalesce({CK}, 'id:'||id) AS key, min(id) AS club_id, min(pos) AS first_pos, list(id ORDER BY pos, id) AS ids FROM c GROUP BY 1")
def club_entries(d):
    """A-34 with the entries of each club."""
    return K.group_entries(clubs(d)).select("key", "club_id", "first_pos", F.col("entries.id").alias("ids"))


LBL = "n AS (SELECT p_partkey, p_brand AS club, CASE p_partkey%5 WHEN 0 THEN p_brand||' - '||p_type||'/'||split_part(p_name,' ',1) WHEN 1 THEN p_brand WHEN 2 THEN upper(p_brand)||': '||p_name WHEN 3 THEN '' ELSE p_name||'/x/y' END AS course FROM part)"
STRIP = "CASE WHEN club<>'' AND starts_with(lower(course), lower(club)) AND length(course)>length(club) THEN trim(regexp_replace(course[length(club)+1:], '^[\\s\\-–—:|,·]+', '')) ELSE course END"


def labels(d):
    m = F.col("p_partkey") % 5
    co = (F.when(m == 0, F.concat("p_brand", F.lit(" - "), "p_type", F.lit("/"), F.split("p_name", " ")[0])).when(m == 1, F.col("p_brand"))
          .when(m == 2, F.concat(F.upper("p_brand"), F.lit(": "), "p_name")).when(m == 3, "").otherwise(F.concat("p_name", F.lit("/x/y"))))
    return d.part.select("p_partkey", F.col("p_brand").alias("club"), co.alias("course"))


@query("routing_label", f"WITH {LBL}, s AS (SELECT *, {STRIP} AS raw FROM n), q AS (SELECT *, list_filter(list_transform(string_split(raw,'/'), lambda z: trim(z)), lambda z: z<>'') AS pt FROM s) SELECT p_partkey, CASE WHEN contains(raw,'/') AND len(pt)=2 THEN pt[1]||' / '||pt[2] WHEN raw<>'' THEN raw ELSE club END AS label FROM q")
def routing_label(d):
    return labels(d).select("p_partkey", K.routing_label("course", "club").alias("label"))


@query("routing_lookup", f"WITH {LBL}, s AS (SELECT *, string_split_regex(lower({STRIP}), '[^a-z0-9]+') AS w FROM n) SELECT p_partkey, list_contains(w, 'economy') AND list_contains(w, 'small') AS both_names FROM s")
def routing_lookup(d):
    return labels(d).select("p_partkey", K.names_both("course", "club", F.lit("Economy"), F.lit(" small ")).alias("both_names"))


@query("card_lookup", """SELECT s_suppkey, CASE WHEN regexp_matches(s_name,'1[0-9]$') AND (st='' OR regexp_matches(st,'^(?i)(in|s1)$')) THEN 'card-a' WHEN regexp_matches(s_name,'0$') AND (ct='' OR regexp_matches(ct,'(?i)town')) THEN 'card-b' WHEN regexp_matches(s_name,'[05]$') THEN 'card-c' END AS card
FROM (SELECT s_suppkey, s_name, CASE s_nationkey%3 WHEN 0 THEN '' WHEN 1 THEN 'S1' ELSE 'S2' END AS st, CASE s_nationkey%2 WHEN 0 THEN '' ELSE 'Village' END AS ct FROM supplier)""")
def card_lookup(d):
    pats = d.spark.createDataFrame([("card-a", "1[0-9]$", "^(?i)(in|s1)$", None, 1), ("card-b", "0$", None, "(?i)town", 2), ("card-c", "[05]$", None, None, 3)], "card string, name_re string, state_re string, city_re string, priority int")
    n = F.col("s_nationkey")
    c = d.supplier.select("s_suppkey", F.col("s_name").alias("club_name"), F.when(n % 3 == 0, "").when(n % 3 == 1, "S1").otherwise("S2").alias("state"), F.when(n % 2 == 0, "").otherwise("Village").alias("city"))
    return K.card_for(c, pats).select("s_suppkey", "card")


NINE = "t AS (SELECT s_suppkey, i, CASE i WHEN 0 THEN 'Red' WHEN 1 THEN 'White' ELSE 'Blue' END AS label, k, CASE (k+i+s_suppkey)%4 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 4 END AS par FROM supplier CROSS JOIN (SELECT unnest(range(0,3)) AS i) CROSS JOIN (SELECT unnest(range(1,10)) AS k)), p AS (SELECT s_suppkey, i, label, sum(par) AS par FROM t GROUP BY ALL)"


def three_nines(d):
    def one(i, label):
        return F.struct(F.lit(label).alias("label"), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.when((k + i + F.col("s_suppkey")) % 4 == 0, 5).when((k + i + F.col("s_suppkey")) % 4 == 1, 3).otherwise(4)).alias("pars"))
    return d.supplier.select("s_suppkey", F.array(one(0, "Red"), one(1, "White"), one(2, "Blue")).alias("nines"))


@query("nine_combos", f"WITH {NINE} SELECT a.s_suppkey, a.label||' / '||b.label AS label, CAST(a.par+b.par AS INT) AS par FROM p a JOIN p b ON a.s_suppkey=b.s_suppkey AND a.i<b.i")
def nine_combos(d):
    c = three_nines(d).select("s_suppkey", "nines", F.explode(K.nine_combos("nines")).alias("c"))
    par = lambda i: F.aggregate(F.get("nines", i)["pars"], F.lit(0), lambda t, v: t + v)
    return c.select("s_suppkey", "c.label", (par(F.col("c.i")) + par(F.col("c.j"))).alias("par"))


@query("composed_tee", f"""WITH {NINE}, h AS (SELECT *, (k*2+s_suppkey)%9+1 AS si, 100+20*k+i AS yds FROM t), c AS (SELECT a.s_suppkey, a.label||' / '||b.label AS label, a.i AS i, b.i AS j, CAST(a.par+b.par AS INT) AS par_total FROM p a JOIN p b ON a.s_suppkey=b.s_suppkey AND a.i<b.i)
SELECT c.s_suppkey, c.label, CAST(k AS INT) AS hole, CAST(par AS INT) AS par, CAST(yds AS INT) AS yards, CAST(2*si-1 AS INT) AS si, par_total FROM c JOIN h ON h.s_suppkey=c.s_suppkey AND h.i=c.i UNION ALL SELECT c.s_suppkey, c.label, CAST(k+9 AS INT), CAST(par AS INT), CAST(yds AS INT), CAST(2*si AS INT), par_total FROM c JOIN h ON h.s_suppkey=c.s_suppkey AND h.i=c.j""")
def composed_tee(d):
    """M-06: the 18 holes of every two nines of a card."""
    n = F.transform("nines", lambda x, i: F.struct(x["label"].alias("label"), x["pars"].alias("pars"), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: k * 20 + 100 + i).alias("yards"),
                                                   F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: ((k * 2 + F.col("s_suppkey")) % 9 + 1).cast("int")).alias("si")))
    c = three_nines(d).select("s_suppkey", n.alias("nines")).withColumn("c", F.explode(K.nine_combos("nines")))
    t = c.select("s_suppkey", K.composed_tee("nines", "c", F.lit(71.0), F.lit(120)).alias("t"))
    at = lambda f: F.get(f"t.{f}", F.col("p")).alias(f.rstrip("s") if f == "pars" else f)
    return t.select("s_suppkey", "t", F.posexplode("t.pars").alias("p", "par")).select("s_suppkey", "t.label", (F.col("p") + 1).alias("hole"), "par", at("yards"), at("si"), "t.par_total")


@query("doubled_nine", f"WITH {NINE} SELECT s_suppkey, CAST(2*par AS INT) AS par, CAST(18 AS INT) AS holes, floor((30+s_suppkey%9/10.0::DOUBLE)*2*10+0.5)/10 AS rating FROM p WHERE i=0")
def doubled_nine(d):
    t = three_nines(d).withColumn("n", F.get("nines", F.lit(0)))
    t = t.withColumn("x", K.twice_around("n.pars", "n.pars", "n.pars", F.lit(30.0) + F.col("s_suppkey") % 9 / F.lit(10.0)))
    return t.select("s_suppkey", F.aggregate("x.pars", F.lit(0), lambda a, v: a + v).alias("par"), F.size("x.pars").alias("holes"), "x.rating")


@query("record_nines", """WITH r AS (SELECT round_id, CASE round_id%4 WHEN 0 THEN ' red /WHITE' WHEN 1 THEN 'Blue/Red' WHEN 2 THEN 'Green/Red' ELSE 'Red' END AS routing FROM rounds_v),
 q AS (SELECT *, CASE lower(trim(split_part(routing,'/',1))) WHEN 'red' THEN 0 WHEN 'white' THEN 1 WHEN 'blue' THEN 2 END AS i, CASE lower(trim(split_part(routing,'/',2))) WHEN 'red' THEN 0 WHEN 'white' THEN 1 WHEN 'blue' THEN 2 END AS j FROM r)
SELECT round_id, CAST(CASE WHEN i<>j THEN i END AS INT) AS first_nine, CAST(CASE WHEN i<>j THEN j END AS INT) AS second_nine FROM q""", ("rounds_v",))
def record_nines(d):
    m = F.col("round_id") % 4
    r = d.rounds.select("round_id", F.when(m == 0, " red /WHITE").when(m == 1, "Blue/Red").when(m == 2, "Green/Red").otherwise("Red").alias("routing"))
    p = K.nine_pair("routing", F.array(F.lit("Red"), F.lit("White"), F.lit("Blue")))
    return r.select("round_id", p["i"].alias("first_nine"), p["j"].alias("second_nine"))


@query("tee_options", """SELECT s_suppkey AS course_id, g AS gender, g||':'||CAST(p AS VARCHAR) AS tee_key, CAST(CASE WHEN s_suppkey%3=0 THEN 27 ELSE 18 END AS INT) AS n_holes FROM supplier CROSS JOIN (VALUES ('male',0),('male',1),('female',0)) t(g,p) WHERE NOT (p=1 AND s_suppkey%5=0)""")
def tee_options(d):
    """Course cards as nested JSON, parsed back and flattened to the tees that can be played."""
    k = F.col("s_suppkey")
    n = F.when(k % 3 == 0, 27).otherwise(18)
    tee = lambda name, size: F.struct(F.lit(name).alias("tee_name"), F.lit(70.1).alias("course_rating"), F.lit(121).alias("slope_rating"), F.transform(
        F.sequence(F.lit(1), size), lambda h: F.struct((h % 3 + 3).alias("par"), h.alias("handicap"), (h * 10 + 100).alias("yardage"))).alias("holes"))
    doc = d.supplier.select(F.to_json(F.struct(k.alias("id"), F.struct(F.array(tee("Blue", n), tee("Nine", F.when(k % 5 == 0, 9).otherwise(n))).alias("male"), F.array(tee("Red", n)).alias("female")).alias("tees"))).alias("doc"))
    from loftline.sources.cards import parse_cards
    return K.tee_options(parse_cards(doc, "doc")).select("course_id", "gender", "tee_key", "n_holes")
