"""Map extracts: element JSON to features, ring stitching, hole keys (O-09 .. O-11, J-14, J-15, W-09)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loftline.session import work_folder

_PT = "array<struct<lat:double,lon:double>>"
ELEMENT = f"id long, type string, tags map<string,string>, geometry {_PT}, members array<struct<type:string,role:string,geometry:{_PT}>>"
TROUBLE = ("bunker", "water_hazard", "lateral_water_hazard", "out_of_bounds")


def parse_elements(docs: DataFrame, column: str) -> DataFrame:
    t = ELEMENT.replace("id long", "id:long").replace("type string, tags map<string,string>, geometry ", "type:string,tags:map<string,string>,geometry:").replace(", members ", ",members:")
    return docs.select(F.explode(F.from_json(column, f"struct<elements:array<struct<{t}>>>")["elements"]).alias("e")).select("e.*")


def feature_kind() -> Column:
    """O-09: the golf tag wins over natural and landuse tags."""
    golf, nat, use = F.col("tags")["golf"], F.col("tags")["natural"], F.col("tags")["landuse"]
    return (F.when(golf.isin("fairway", "tee", "rough", "green", "hole", *TROUBLE), golf).when(golf.isNotNull(), None)
            .when((nat == "wood") | (use == "forest"), "trees").when(nat == "water", "water").when(F.col("tags")["leisure"] == "golf_course", "course"))


def features(elements: DataFrame) -> DataFrame:
    """Ways with their kind and open ring; a closing point equal to the first is dropped; too few points fall out."""
    g = F.col("geometry")
    n = F.size(g)
    closed = (n >= 4) & (g[0] == F.element_at(g, -1))
    e = elements.filter("type = 'way' AND geometry IS NOT NULL").withColumn("kind", feature_kind()).filter("kind IS NOT NULL")
    e = e.withColumn("ring", F.when(closed & (F.col("kind") != "hole"), F.slice(g, 1, n - 1)).otherwise(g))
    return e.filter(F.when(F.col("kind") == "hole", F.size("ring") >= 2).otherwise(F.size("ring") >= 3)).select("id", "kind", F.col("tags")["ref"].alias("ref"), F.col("tags")["name"].alias("name"), "ring")


def _rings(members: list[list[tuple]]) -> list[list[tuple]]:
    """Rings of ways that share end points.

    Each way is two arcs, one for each direction, filed under the point where it begins; an arc goes on with the first
    arc of another way filed under its end.
    """
    arcs = [pts for way in members for pts in (way, way[::-1])]
    begins: dict[tuple, list[int]] = {}
    for a, pts in enumerate(arcs):
        begins.setdefault(pts[0], []).append(a)
    used, out = set(), []
    for way in range(len(members)):
        if way in used:
            continue
        used.add(way)
        chain = [2 * way]
        while arcs[chain[-1]][-1] != arcs[chain[0]][0]:
            on = next((a for a in begins.get(arcs[chain[-1]][-1], ()) if a // 2 not in used), None)
            if on is None:
                break
            used.add(on // 2)
            chain.append(on)
        out.append([arcs[chain[0]][0], *(p for a in chain for p in arcs[a][1:])])
    return out


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rings of many relations at a time."""
    point = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])
    shape = pa.schema([("relation_id", pa.int64()), ("role", pa.string()), ("ring_no", pa.int32()), ("ring", pa.list_(point))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            ways = [[(p["lat"], p["lon"]) for p in w["pts"]] for w in r["ways"] if len(w["pts"]) >= 2]
            out += [{"relation_id": r["relation_id"], "role": r["role"], "ring_no": k, "ring": [{"lat": a, "lon": b} for a, b in ring]} for k, ring in enumerate(_rings(ways))]
        yield pa.RecordBatch.from_pylist(out, shape)


def stitch_rings(segments: DataFrame) -> DataFrame:
    """O-10: member ways of one relation joined end to end until each ring closes; a relation has a bounded list of members.

    Columns: relation_id, role, pos, pts array<struct<lat,lon>>.
    """
    ways = segments.groupBy("relation_id", "role").agg(F.array_sort(F.collect_list(F.struct("pos", "pts"))).alias("ways"))
    shape = f"relation_id long, role string, ring_no int, ring {_PT}"
    return ways.mapInArrow(_stitched, shape)


def relation_features(elements: DataFrame) -> DataFrame:
    """O-09/O-10: relations with their kind, a row for each closed outer ring, with the closed inner rings of the relation.

    Rings come without the point that closes them; a relation none of whose outer rings closes falls out.
    """
    r = elements.filter("type = 'relation'").withColumn("kind", feature_kind()).filter("kind IS NOT NULL")
    seg = r.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("pos", "m")).filter("m.geometry IS NOT NULL")
    seg = seg.select("relation_id", F.when(F.col("m.role") == "inner", "inner").otherwise("outer").alias("role"), "pos", F.col("m.geometry").alias("pts"))
    g = F.col("ring")
    rings = stitch_rings(seg).filter((F.size(g) >= 4) & (g[0] == F.element_at(g, -1))).withColumn("ring", F.slice(g, 1, F.size(g) - 1))
    inner = rings.filter("role = 'inner'").groupBy("relation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_no", "ring"))), lambda x: x["ring"]).alias("inner"))
    out = rings.filter("role = 'outer'").join(inner, "relation_id", "left").join(r.select(F.col("id").alias("relation_id"), "kind", "tags"), "relation_id")
    return out.select(F.col("relation_id").alias("id"), "ring_no", "kind", F.col("tags")["name"].alias("name"), "ring", "inner")


_XML_TAG = "tag array<struct<_k:string,_v:string>>"


def _tags() -> Column:
    return F.coalesce(F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"]))), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def _parsed(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of one name; they are read again by several joins, so what the parser finds is kept as Parquet."""
    folder = work_folder(spark)
    spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).write.parquet(folder)
    return spark.read.parquet(folder)


def read_osm_xml(spark: SparkSession, path: str) -> DataFrame:
    """O-11: ways of an OSM XML snapshot with their node references resolved, in order."""
    nodes = _parsed(spark, path, "node", "_id long, _lat double, _lon double")
    ways = _parsed(spark, path, "way", f"_id long, nd array<struct<_ref:long>>, {_XML_TAG}")
    refs = ways.select(F.col("_id").alias("id"), F.posexplode("nd").alias("pos", "n")).select("id", "pos", F.col("n._ref").alias("_nid"))
    pts = refs.join(nodes.select(F.col("_id").alias("_nid"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")), "_nid")
    ring = pts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("geometry"))
    tags = ways.select(F.col("_id").alias("id"), _tags().alias("tags"))
    return tags.join(ring, "id", "left")


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """O-11: ways and relations of an OSM XML snapshot in the form of :func:`parse_elements`.

    The snapshot is parsed three times, for nodes, ways and relations; a way's nodes and a relation's member ways are resolved by joins and stand
    in their order.  Nodes that the snapshot lacks are left out of a way, a way without any has no geometry; members it
    lacks, and members that are no ways, stay with a null geometry.
    """
    ways = read_osm_xml(spark, path)
    rel = _parsed(spark, path, "relation", f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {_XML_TAG}")
    m = rel.select(F.col("_id").alias("id"), F.posexplode("member").alias("pos", "m")).select("id", "pos", "m._type", "m._role", F.when(F.col("m._type") == "way", F.col("m._ref")).alias("_way"))
    m = m.join(ways.select(F.col("id").alias("_way"), "geometry"), "_way", "left")
    member = F.struct("pos", F.col("_type").alias("type"), F.col("_role").alias("role"), "geometry")
    m = m.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(member)), lambda x: F.struct(x["type"].alias("type"), x["role"].alias("role"), x["geometry"].alias("geometry"))).alias("members"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kinds = dict(zip(("geometry", "members"), (_PT, f"array<struct<type:string,role:string,geometry:{_PT}>>")))
    r = rel.select(F.col("_id").alias("id"), F.lit("relation").alias("type"), _tags().alias("tags"), none(kinds["geometry"], "geometry")).join(m, "id", "left")
    w = ways.select("id", F.lit("way").alias("type"), "tags", "geometry", none(kinds["members"], "members"))
    return w.unionByName(r)


def hole_keys(holes: DataFrame) -> DataFrame:
    """W-09: the first way of a hole number keeps it as key; repeats are ``ref@id``."""
    w = Window.partitionBy("course_id", "ref").orderBy("pos")
    return holes.withColumn("_n", F.row_number().over(w)).withColumn("key", F.when(F.col("_n") == 1, F.col("ref").cast("string")).otherwise(F.concat_ws("@", "ref", "id"))).drop("_n")


def mirror_links(links: DataFrame, holes: DataFrame, loop: int) -> DataFrame:
    """J-14: a nine played twice: every feature of hole n also belongs to n +- loop, where that hole exists."""
    twin = links.withColumn("hole", F.when(F.col("hole") > loop, F.col("hole") - loop).otherwise(F.col("hole") + loop))
    return links.unionByName(twin.join(holes.select("course_id", "hole"), ["course_id", "hole"], "left_semi").select(*links.columns)).distinct()


def coverage(courses: DataFrame, mapped: DataFrame) -> DataFrame:
    """J-15: expected holes 1..n without a line or a green, with the reason."""
    want = courses.select("course_id", F.explode(F.sequence(F.lit(1), F.col("n_holes"))).alias("hole"))
    j = want.join(mapped, ["course_id", "hole"], "left")
    return j.withColumn("reason", F.when(F.col("has_line").isNull(), "no line").when(~F.coalesce("has_green", F.lit(False)), "no green")).filter("reason IS NOT NULL").select("course_id", "hole", "reason")
