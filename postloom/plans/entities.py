"""Joins, set operations, geography and per-user entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions import text
from postloom.operators import entities, fuzzy, geo
from postloom.plans.registry import query
from postloom.session import table
from postloom.sources.readers import lookup

#: Areas: a square, one with a notch, a triangle, in the plane of an embedding's first two components.
AREAS = [(1, [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]), (2, [(0.1, 0.0), (0.5, 0.0), (0.5, 0.5), (0.3, 0.2), (0.1, 0.5)]), (3, [(-0.5, -0.5), (0.0, -0.5), (-0.5, 0.0)])]


def _areas(spark):
    return spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in ring]) for i, ring in AREAS], "area_id int, ring array<struct<x: double, y: double>>")


def _edges_sql() -> str:
    return "VALUES " + ", ".join(f"({i}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, ring in AREAS for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


_IN_SQL = f"""
WITH e(area_id, x1, y1, x2, y2) AS ({_edges_sql()}),
     p AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
     hit AS (SELECT p.point_id, e.area_id FROM p JOIN e ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY p.point_id, e.area_id HAVING count(*) % 2 = 1)
"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def join_inner_location(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup(table(spark, sf_dir, "customer"), nations, "c_nationkey").select("c_custkey", "n_name")


@query("SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 45")
def join_inner_id(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey")


@query("SELECT a.user_id, a.event_type, a.n, b.v FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) a JOIN (SELECT user_id, event_type, max(value) AS v FROM events WHERE value > 300 GROUP BY ALL) b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def join_multi_key(spark, sf_dir):
    events, keys = table(spark, sf_dir, "events"), ["user_id", "event_type"]
    return events.groupBy(*keys).agg(F.count("*").alias("n")).join(events.filter("value > 300").groupBy(*keys).agg(F.max("value").alias("v")), keys)


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events) SELECT event_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank IN (1, 2, 5, 10, 50, 100, 500)")
def join_rank_list(spark, sf_dir):
    from postloom.operators.retrieval import ranked

    wanted = spark.createDataFrame([(r,) for r in (1, 2, 5, 10, 50, 100, 500)], "rank long")
    return lookup(ranked(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id"), wanted, "rank").select("event_id", "rank")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join_left_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_broadcast_anti(spark, sf_dir):
    taken = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), taken, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT conv_id FROM conversations)")
def join_iterative_anti(spark, sf_dir):
    labels, conversations = table(spark, sf_dir, "labels"), table(spark, sf_dir, "conversations")
    taken = [labels.filter("quality = 0").select("doc_id"), labels.filter("toxic = 1").select("doc_id"), conversations.select(F.col("conv_id").alias("doc_id"))]
    return entities.without(table(spark, sf_dir, "documents").select("doc_id"), taken, "doc_id")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS chosen FROM documents")
def join_left_outer_isnull(spark, sf_dir):
    chosen, rest = entities.split(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    return chosen.withColumn("chosen", F.lit(True)).unionByName(rest.withColumn("chosen", F.lit(False)))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality")


@query("SELECT user_id, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def join_wide_scores(spark, sf_dir):
    return entities.wide_scores(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["view", "click", "purchase"])


@query("SELECT v.user_id, v.m AS view, c.m AS click, p.m AS purchase FROM (SELECT user_id, max(value) AS m FROM events WHERE event_type = 'view' GROUP BY 1) v JOIN (SELECT user_id, max(value) AS m FROM events WHERE event_type = 'click' GROUP BY 1) c ON v.user_id = c.user_id JOIN (SELECT user_id, max(value) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) p ON v.user_id = p.user_id")
def join_nway_reduce(spark, sf_dir):
    names = ["view", "click", "purchase"]
    return entities.wide_scores(table(spark, sf_dir, "events"), "user_id", "event_type", "value", names).na.drop(subset=names)


@query(_IN_SQL + "SELECT point_id, area_id FROM hit")
def join_spatial(spark, sf_dir):
    return geo.spatial_join(_points(spark, sf_dir), _areas(spark), 0.1).select("point_id", "area_id")


@query("""
SELECT point_id, area_id FROM (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), (VALUES (1), (2)) a(area_id)
WHERE CASE area_id WHEN 1 THEN x BETWEEN -0.25 AND 0.25 AND y BETWEEN -0.25 AND 0.25 AND NOT (x > -0.125 AND x < 0.125 AND y > -0.125 AND y < 0.125) ELSE x BETWEEN 0.25 AND 0.5 AND y BETWEEN 0 AND 0.5 OR x BETWEEN -0.5 AND -0.375 AND y BETWEEN -1 AND 1 END
""")
def join_spatial_wkt(spark, sf_dir):
    """Areas from their texts: one with a hole, one of two parts."""
    shapes = [
        (1, "POLYGON ((-0.25 -0.25, 0.25 -0.25, 0.25 0.25, -0.25 0.25, -0.25 -0.25), (-0.125 -0.125, 0.125 -0.125, 0.125 0.125, -0.125 0.125, -0.125 -0.125))"),
        (2, "MULTIPOLYGON (((0.25 0, 0.5 0, 0.5 0.5, 0.25 0.5, 0.25 0)), ((-0.5 -1, -0.375 -1, -0.375 1, -0.5 1, -0.5 -1)))"),
    ]
    areas = spark.createDataFrame(shapes, "area_id int, wkt string").select("area_id", geo.rings_of(F.col("wkt")).alias("rings"))
    return geo.spatial_join(_points(spark, sf_dir), areas, 0.1).select("point_id", "area_id")


@query(_IN_SQL + "SELECT a.area_id, count(hit.point_id) AS n FROM (SELECT DISTINCT area_id FROM e) a LEFT JOIN hit ON a.area_id = hit.area_id GROUP BY a.area_id")
def join_spatial_left_dissolve(spark, sf_dir):
    counts = geo.spatial_join(_points(spark, sf_dir), _areas(spark), 0.1).groupBy("area_id").agg(F.count("*").alias("n"))
    return _areas(spark).select("area_id").join(counts, "area_id", "left").select("area_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH p AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
     d AS (SELECT p.point_id, c.point_id AS place_id, pow(p.x - c.x, 2) + pow(p.y - c.y, 2) AS d2 FROM p JOIN p c ON c.point_id % 10 = 0)
SELECT point_id, CAST(arg_min(place_id, (d2, place_id)) AS BIGINT) AS place_id, round(sqrt(min(d2)), 9) AS distance FROM d GROUP BY point_id
""")
def join_nearest_plane(spark, sf_dir):
    """Places are every tenth point."""
    points = _points(spark, sf_dir)
    places = points.filter("point_id % 10 = 0").select(F.col("point_id").alias("place_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return geo.nearest(points, places, 0.05).select("point_id", "place_id", F.round("distance", 9).alias("distance"))


@query("""
WITH p AS (SELECT vec_id AS point_id, greatest(-90, least(90, CAST(embedding[1] AS DOUBLE) * 250)) AS lat, (CAST(embedding[2] AS DOUBLE) * 600 + 5400) % 360 - 180 AS lon FROM embeddings),
     d AS (SELECT p.point_id, c.point_id AS place_id, 2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)))) AS km FROM p JOIN p c ON c.point_id % 10 = 0)
SELECT point_id, CAST(arg_min(place_id, (km, place_id)) AS BIGINT) AS place_id, round(min(km), 6) AS distance FROM d GROUP BY point_id
""")
def join_nearest_geocode(spark, sf_dir):
    """Places are every tenth point, on all longitudes and up to the poles."""
    lat, lon = (F.col("embedding")[i].cast("double") for i in range(2))
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat * 250)).alias("lat"), ((lon * 600 + 5400) % 360 - 180).alias("lon"))
    places = points.filter("point_id % 10 = 0").withColumnRenamed("point_id", "place_id")
    return geo.nearest_on_sphere(points, places).select("point_id", "place_id", F.round("distance", 6).alias("distance"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'v.tar' WHEN 'click' THEN 'c.tar' END AS tar FROM events")
def join_dict_lookup(spark, sf_dir):
    names = spark.createDataFrame([("view", "v.tar"), ("click", "c.tar")], "event_type string, tar string")
    return lookup(table(spark, sf_dir, "events").select("event_id", "event_type"), names, "event_type", "left").select("event_id", "tar")


#: Names with letters left out or words added, and names with their types.
_NAMES = """
n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'l', '') WHEN 2 THEN p_name || ', ' || lower(p_brand) ELSE upper(replace(p_name, 'o', 'oo')) END AS a, p_type || ' ' || p_name AS b FROM part),
w AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(lower(a), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: x <> ''))) AS x, list_sort(list_distinct(list_filter(string_split_regex(lower(b), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: x <> ''))) AS y FROM n)
"""


def _ratio_sql(pairs: str) -> str:
    """Ratios of all rows of ``pairs`` (x and y, lists of words): the subsequence by rows of its table."""
    row = "list_transform(range(0, len(old)), lambda j: CASE WHEN j = 0 THEN 0 ELSE greatest(old[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: q[k] = c), lambda k: old[k] + 1)), 0)) END)"
    return f"""
r AS (SELECT DISTINCT x, y, list_sort(list_intersect(x, y)) AS s, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ' ') AS p, array_to_string(list_sort(list_filter(y, lambda v: NOT list_contains(x, v))), ' ') AS q FROM {pairs}),
l AS (SELECT *, length(array_to_string(s, ' ')) AS n0, list_last(list_reduce(list_concat([list_transform(range(0, length(q) + 1), lambda j: 0)], list_transform(string_split(p, ''), lambda c: [ord(c)])), lambda old, ch: {row.replace("q[k] = c", "ord(q[k]) = ch[1]")})) AS shared FROM r),
f AS (SELECT *, n0 + length(p) + CAST(n0 > 0 AND p <> '' AS INTEGER) AS n1, n0 + length(q) + CAST(n0 > 0 AND q <> '' AS INTEGER) AS n2 FROM l),
g AS (SELECT x, y, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE 100 * greatest(CASE WHEN n0 > 0 THEN 2.0 * n0 / (n0 + n1) ELSE 0 END, CASE WHEN n0 > 0 THEN 2.0 * n0 / (n0 + n2) ELSE 0 END, 2.0 * (n0 + CAST(n0 > 0 AND p <> '' AND q <> '' AS INTEGER) + CASE WHEN p = '' OR q = '' THEN 0 ELSE shared END) / (n1 + n2)) END AS ratio FROM f)
"""


def _names(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    spoilt = F.when(k == 0, name).when(k == 1, F.replace(name, F.lit("l"), F.lit(""))).when(k == 2, F.concat(name, F.lit(", "), F.lower("p_brand"))).otherwise(F.upper(F.replace(name, F.lit("o"), F.lit("oo"))))
    return table(spark, sf_dir, "part").select("p_partkey", spoilt.alias("a"), F.concat_ws(" ", "p_type", "p_name").alias("b"))


@query(f"WITH {_NAMES}, {_ratio_sql('w')} SELECT p_partkey, round(ratio, 9) AS ratio FROM w JOIN g USING (x, y)")
def join_fuzzy(spark, sf_dir):
    """Similarity of two texts of each row by their sets of words."""
    return _names(spark, sf_dir).select("p_partkey", F.round(fuzzy.token_set_ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


@query(f"WITH {_NAMES}, c AS (SELECT DISTINCT one.x, two.y FROM (SELECT DISTINCT x FROM w) one, (SELECT DISTINCT y FROM w) two), {_ratio_sql('c')} SELECT array_to_string(x, ' ') AS left_key, array_to_string(y, ' ') AS right_key, round(ratio, 9) AS ratio FROM g WHERE ratio >= 85 - 1e-9")
def join_fuzzy_tables(spark, sf_dir):
    """All pairs of names at 85 percent or over, found by rare words and letters."""
    names = _names(spark, sf_dir)
    return fuzzy.similar_keys(names, names, "a", "b", 85.0).select("left_key", "right_key", F.round("ratio", 9).alias("ratio"))


@query("SELECT doc_id, min(kind) AS kind FROM (SELECT doc_id, 'a' AS kind FROM documents UNION ALL SELECT doc_id, 'b' FROM labels) GROUP BY doc_id")
def set_union_by_name(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", F.lit("a").alias("kind")).unionByName(table(spark, sf_dir, "labels").select(F.lit("b").alias("kind"), "doc_id"))
    return entities.dedupe(both, ["doc_id"], ["kind"])


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def set_union_positional(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name").union(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def set_concat_shards(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    shards = [events.filter(F.col("event_id") % 4 == k) for k in range(4)]
    return reduce(DataFrame.unionByName, shards).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, coalesce(CAST(len(list_distinct(list_intersect(list(user_id) FILTER (value > 400), list(user_id) FILTER (value < 5)))) AS INTEGER), 0) AS n_both FROM events GROUP BY event_type")
def set_array_intersect(spark, sf_dir):
    flags = (F.max((F.col("value") > 400).cast("int")).alias("high"), F.max((F.col("value") < 5).cast("int")).alias("low"))
    users = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(*flags)  # a hot type is many users, not one array
    return users.groupBy("event_type").agg(F.count_if(F.col("user_id").isNotNull() & (F.col("high") + F.col("low") == 2)).cast("int").alias("n_both"))


@query("SELECT DISTINCT user_id FROM events EXCEPT (SELECT user_id FROM events WHERE event_type = 'error' AND value > 450 UNION SELECT c_custkey FROM customer WHERE c_custkey < 10)")
def set_difference(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    taken = [events.filter("event_type = 'error' AND value > 450").select("user_id"), table(spark, sf_dir, "customer").filter("c_custkey < 10").select(F.col("c_custkey").alias("user_id"))]
    return entities.without(events.select("user_id").distinct(), taken, "user_id")


@query(r"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY regexp_replace(text, 'http\S+', '', 'g')")
def set_dedupe(spark, sf_dir):
    """One document for each text without its links: the least id."""
    return table(spark, sf_dir, "documents").groupBy(text.drop_links(F.col("text")).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("t")


@query("SELECT user_id, event_id, ts FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC) AS r FROM events) WHERE r = 1")
def agg_latest_per_user(spark, sf_dir):
    """All of a user's events of the latest day: ties are kept."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.date_trunc("day", "ts").alias("day"))
    return entities.latest(rows, "user_id", "day").select("user_id", "event_id", "ts")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1")
def agg_mode_location(spark, sf_dir):
    return entities.mode(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("WITH m AS (SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1) SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM m GROUP BY event_type")
def agg_mode_admin(spark, sf_dir):
    from pyspark.sql.window import Window

    units = entities.mode(table(spark, sf_dir, "events"), "user_id", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))
    return units.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a unit


@query("SELECT c_nationkey, list_sort(list(DISTINCT c_custkey)) AS users FROM customer GROUP BY c_nationkey")
def agg_collect_set(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_custkey")).alias("users"))


@query("SELECT c_nationkey, count(DISTINCT c_custkey) AS n_users, count(DISTINCT c_custkey) FILTER (c_acctbal > 0) AS n_good FROM customer GROUP BY c_nationkey")
def agg_array_sizes(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n_users"), F.count_distinct(F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))).alias("n_good"))


@query("SELECT event_type, count(*) AS n_users FROM (SELECT user_id, min(event_type) AS event_type FROM events WHERE value > 250 GROUP BY user_id HAVING count(DISTINCT event_type) = 1) GROUP BY event_type")
def agg_location_users(spark, sf_dir):
    """Users with exactly one place, by place."""
    one = table(spark, sf_dir, "events").filter("value > 250").groupBy("user_id").agg(F.count_distinct("event_type").alias("k"), F.min("event_type").alias("event_type")).filter("k = 1")
    return one.groupBy("event_type").agg(F.count("*").alias("n_users"))


@query("SELECT source, arg_min(lang, doc_id) AS lang, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def agg_first_multi(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("lang", "doc_id").alias("lang"), F.sum("n_chars").alias("chars"))
