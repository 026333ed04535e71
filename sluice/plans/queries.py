"""Queries over the driver's tables as a network (see sluice.sources.tables), with SQL over the tables themselves.

Every query goes through triples; its SQL never does, so that the two sides share no mistake.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice import terms as T
from sluice.functions import gml, scalars
from sluice.functions.plane import Polygon
from sluice.operators import clip, domain, hierarchy, isomorphism, network, restrictions
from sluice.operators.domain import Reader
from sluice.operators.fixpoint import kept, shared_folder
from sluice.operators.graph import Graph
from sluice.operators.grid import Grid
from sluice.operators.hierarchy import Hierarchy
from sluice.session import measured
from sluice.sources import encoding, sink, tables, turtle
from sluice.sources.tables import NET, TERMS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BASE = TERMS.base


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(measured(spark), sf_dir)
        if sql is not None:
            SQL[f.__name__] = sql.replace("{net}", NET).replace("{base}", BASE).replace("{nc}", "(SELECT count(*) FROM customer)").replace("{ns}", "(SELECT count(*) FROM supplier)")
        return f

    return add


def short(column: str):
    return scalars.short_name(F.col(column))


def _reader(spark: SparkSession, sf_dir: str, items: bool = False) -> Reader:
    return Reader(tables.graph(spark, sf_dir, items), Hierarchy.of(tables.class_graph(spark, sf_dir)))


def _nodes(r: Reader) -> DataFrame:
    return kept(r.nodes())


def _ends(r: Reader) -> DataFrame:
    """Of nodes what binding the ends of conduits asks."""
    return kept(r.nodes().select("uri", "orientation", "orientation_types", "ord"))


# SQL of the projection: every node, with its class and its places.
_NODE = """node AS (
  SELECT '{net}c' || c_custkey AS uri, c_custkey AS k, 'Seg_' || c_mktsegment AS cls, 'c' AS kind FROM customer
  UNION ALL SELECT '{net}s' || s_suppkey, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Hulpstuk' ELSE 'Compartiment' END, 's' FROM supplier)"""
_CLOSURE = """edge(sub, sup) AS (
  VALUES ('Putorientatie','Knooppunt'), ('Compartimentorientatie','Knooppunt'), ('Hulpstukorientatie','Knooppunt'), ('Leidingorientatie','Verbinding'),
    ('Put','Bouwwerk'), ('Compartiment','Bouwwerk'), ('Hulpstuk','Bouwwerk'), ('ZwaarDeksel','Putdeksel'), ('Gebied','Reg_0'),
    ('Flag_A','Kenmerk'), ('Flag_N','Kenmerk'), ('Flag_R','Kenmerk'), ('HoogtePut','Kenmerk'), ('WIBONThema','Kenmerk'), ('LengteLeiding','Kenmerk')
  UNION SELECT 'Reg_' || r_regionkey, 'Gebied' FROM region
  UNION SELECT 'Nat_' || n_nationkey, 'Reg_' || n_regionkey FROM nation
  UNION SELECT 'Seg_' || c_mktsegment, 'Put' FROM customer
  UNION SELECT 'Prio_' || left(o_orderpriority, 1), 'Leiding' FROM orders
), closure(root, class) AS (
  SELECT sup, sub FROM edge UNION SELECT sup, sup FROM edge
  UNION SELECT c.root, e.sub FROM closure c JOIN edge e ON e.sup = c.class)"""
_ENDS = """ends AS (
  SELECT o_orderkey AS k, o_custkey AS a, (o_custkey * 7 + 13) % {nc} AS b, o_orderkey % {ns} AS s,
    CASE WHEN o_orderkey % 9 = 4 THEN '{net}s' || (o_orderkey % {ns}) ELSE '{net}c' || o_custkey END AS start_node,
    CASE WHEN o_orderkey % 11 <> 0 THEN '{net}c' || ((o_custkey * 7 + 13) % {nc})
      WHEN (o_orderkey % {ns}) % 3 = 0 THEN '{net}s' || (o_orderkey % {ns}) END AS end_node
  FROM orders)"""


@query("""SELECT 'Put' AS root, count(*) AS n FROM customer UNION ALL SELECT 'Compartiment', count(*) FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT 'Hulpstuk', count(*) FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'Bouwwerk', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'Leiding', count(*) FROM orders UNION ALL SELECT 'Seg_BUILDING', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'""")
def selected_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: objects per class, subclasses included."""
    g = tables.graph(spark, sf_dir, items=False)
    h = Hierarchy.of(tables.class_graph(spark, sf_dir))
    held = g.aspects().join(g.types().select(F.col("s").alias("member"), F.col("type").alias("class")).join(h.hint(h.below(T.NODE_ROLE).unionAll(h.below(T.EDGE_ROLE))), "class", "left_semi"), "member", "left_semi").select(F.col("holder").alias("s")).distinct()
    roots = h.below_all(["Put", "Compartiment", "Hulpstuk", "Bouwwerk", "Leiding", "Seg_BUILDING"])
    hits = g.types().join(held, "s", "left_semi").withColumnRenamed("type", "class").join(F.broadcast(roots), "class")
    return hits.groupBy(short("root").alias("root")).agg(F.countDistinct("s").alias("n"))


@query("""SELECT 'hasPart' AS predicate, (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) + (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0)
  + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 1) + (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 10 <> 5)
  + (SELECT count(*) FILTER (o_orderkey % 3 <> 0) + count(*) FILTER (o_orderkey % 3 <> 1) FROM orders) AS n
UNION ALL SELECT 'isPartOf', (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 1) + (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 5 = 0)
  + (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 10 <> 5) + (SELECT count(*) FILTER (o_orderkey % 3 = 0) + count(*) FILTER (o_orderkey % 3 = 1) FROM orders)
UNION ALL SELECT 'hasConnection', (SELECT count(*) FROM customer) + 2 * (SELECT count(*) FROM orders)
UNION ALL SELECT 'subClassOf', 15 + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(DISTINCT c_mktsegment) FROM customer) + (SELECT count(DISTINCT left(o_orderpriority, 1)) FROM orders)""")
def triple_count_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.graph(spark, sf_dir, items=False)
    wanted = [TERMS.has_part, TERMS.is_part_of, TERMS.has_connection, T.SUBCLASS]
    return g.with_predicates(*wanted).groupBy(short("p").alias("predicate")).agg(F.count("*").alias("n"))


@query("SELECT '{net}c' || c_custkey AS s, '{base}Seg_' || c_mktsegment AS first_type FROM customer UNION ALL SELECT '{net}s' || s_suppkey, '{base}' || CASE WHEN s_suppkey % 3 = 0 THEN 'Hulpstuk' ELSE 'Compartiment' END FROM supplier")
def first_value_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.graph(spark, sf_dir, items=False)
    return g.value(T.TYPE).filter(F.col("s").rlike(f"^{NET}[cs][0-9]+$")).select("s", F.col("o").alias("first_type"))


@query("SELECT '{net}c' || c_custkey AS s, 'Seg_' || c_mktsegment || CASE WHEN c_custkey % 7 = 0 THEN ',Put' ELSE '' END AS objects FROM customer")
def objects_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.graph(spark, sf_dir, items=False)
    own = g.of(T.TYPE).filter(F.col("s").rlike(f"^{NET}c[0-9]+$"))
    return own.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "o"))), lambda x: scalars.short_name(x["o"])), ",").alias("objects"))


@query("SELECT 'Prio_' || left(o_orderpriority, 1) AS class, count(*) AS n_subjects, '{net}o' || min(o_orderkey) AS first_subject FROM orders GROUP BY ALL")
def subjects_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.graph(spark, sf_dir, items=False)
    own = g.of(T.TYPE).filter(F.col("o").startswith(BASE + "Prio_"))
    return own.groupBy(short("o").alias("class")).agg(F.count("*").alias("n_subjects"), F.min_by("s", "pos").alias("first_subject"))


@query("SELECT '{net}c' || c_custkey AS s, c_custkey % 7 = 0 AS is_plain FROM customer")
def member_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.graph(spark, sf_dir, items=False)
    asked = tables.read(spark, sf_dir, "customer").select(tables.iri("c", F.col("c_custkey")).alias("s"), F.lit(T.TYPE).alias("p"), F.lit(BASE + "Put").alias("o"))
    hit = g.contains(asked).select("s", F.lit(True).alias("hit"))
    return g.known_subjects(asked).select("s").join(hit, "s", "left").select("s", F.coalesce("hit", F.lit(False)).alias("is_plain"))


@query("SELECT '{net}n' || c_nationkey AS holder, '{net}c' || c_custkey AS member FROM customer UNION ALL SELECT '{net}r' || n_regionkey, '{net}n' || n_nationkey FROM nation")
def parts_both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.graph(spark, sf_dir, items=False).parts().filter(F.col("holder").rlike(f"^{NET}[nr]")).select("holder", "member")


@query("SELECT '{net}c' || c_custkey || '_o' AS member, '{net}c' || c_custkey AS carrier, '{net}n' || c_nationkey AS holder FROM customer")
def holders_both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.graph(spark, sf_dir, items=False)
    carriers = g.aspects().filter(F.col("member").rlike(f"^{NET}c[0-9]+_o$")).select("member", F.col("holder").alias("carrier"))
    return carriers.join(g.parts().select("holder", F.col("member").alias("carrier")), "carrier").select("member", "carrier", "holder")


@query("""WITH """ + _ENDS + """ SELECT '{net}c' || c_custkey || '_o' AS a, 1 + (SELECT count(*) FROM ends WHERE a = c_custkey AND k % 9 <> 4) + (SELECT count(*) FROM ends WHERE b = c_custkey AND k % 11 <> 0) AS n FROM customer""")
def neighbours_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = tables.graph(spark, sf_dir, items=False).neighbours().filter(F.col("a").rlike(f"^{NET}c[0-9]+_o$"))
    return near.groupBy("a").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE " + _CLOSURE + " SELECT DISTINCT root, class FROM closure")
def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.subclass_closure(tables.class_graph(spark, sf_dir)).select(short("root").alias("root"), short("class").alias("class"))


@query("WITH " + _NODE + " SELECT uri, CASE WHEN cls = 'Seg_BUILDING' THEN 'Seg_BUILDING' WHEN kind = 'c' THEN 'Put' ELSE 'Bouwwerk' END AS root FROM node")
def select_by_classes_first_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    n = r.first_held(r.found("node")).join(r.type_sets(), "s").select(F.col("s").alias("uri"), "types", "ord")
    return hierarchy.first_root(n, r.h, ["Seg_BUILDING", "Put", "Bouwwerk"]).select("uri", short("root").alias("root"))


@query("SELECT '{net}c' || c_custkey AS s, 1 + (c_custkey % 7 = 0)::BIGINT AS n FROM customer")
def graph_subjects_by_class_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Hierarchy.of(tables.class_graph(spark, sf_dir))
    return hierarchy.subjects_of_class(tables.graph(spark, sf_dir, items=False), h, "Put").groupBy("s").agg(F.count("*").alias("n"))


@query("""SELECT '{net}c' || c_custkey AS uri, CASE WHEN c_custkey % 7 = 0 THEN 'Put,Putorientatie,Seg_' || c_mktsegment ELSE 'Putorientatie,Seg_' || c_mktsegment END AS types FROM customer
UNION ALL SELECT '{net}s' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Hulpstuk,Hulpstukorientatie' ELSE 'Compartiment,Compartimentorientatie' END FROM supplier
UNION ALL SELECT '{net}o' || o_orderkey, 'Prio_' || left(o_orderpriority, 1) FROM orders""")
def types_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    sets = r.type_sets()
    empty = F.array().cast("array<string>")
    n = r.first_held(r.found("node")).join(sets, "s", "left").join(sets.toDF("o", "orientation_types"), "o", "left").select(F.col("s").alias("uri"), F.coalesce("types", empty).alias("types"), F.coalesce("orientation_types", empty).alias("orientation_types"))
    c = r.first_held(r.found("conduit")).join(sets, "s").select(F.col("s").alias("uri"), "types")
    return hierarchy.types_of(n, c).select("uri", F.array_join(hierarchy.short_types(F.col("types")), ",").alias("types"))


@query("""SELECT 'Put' AS root, count(*) AS n FROM customer UNION ALL SELECT 'Knooppunt', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'Leiding', count(*) FROM orders UNION ALL SELECT 'Nat_1', 0 UNION ALL SELECT 'Hulpstuk', count(*) FROM supplier WHERE s_suppkey % 3 = 0""")
def is_a_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    both = r.found("node").unionAll(r.found("conduit").withColumn("at", F.lit(None).cast(r.found("node").schema["at"].dataType))).select("s", "o").distinct()
    typed = both.select("s", F.explode(F.array("s", "o")).alias("x")).join(r.types.select(F.col("s").alias("x"), F.col("type").alias("class")), "x").select("s", "class")
    roots = ["Put", "Knooppunt", "Leiding", "Nat_1", "Hulpstuk"]
    hits = typed.join(r.h.hint(r.h.below_all(roots)), "class").groupBy("root").agg(F.countDistinct("s").alias("n"))
    asked = r.h.below_all(roots).select("root").distinct()
    return asked.join(hits, "root", "left").select(short("root").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT 'Gebied' AS root, count(*) AS n FROM nation UNION ALL SELECT 'Bouwwerk', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'Putdeksel', count(*) FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT 'Verbinding', count(*) FROM orders""")
def graph_is_a_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Hierarchy.of(tables.class_graph(spark, sf_dir))
    t = tables.graph(spark, sf_dir, items=False).types().withColumnRenamed("type", "class")
    return t.join(h.hint(h.below_all(["Gebied", "Bouwwerk", "Putdeksel", "Verbinding"])), "class").groupBy(short("root").alias("root")).agg(F.countDistinct("s").alias("n"))


@query("WITH " + _NODE + " SELECT uri, cls AS object_type FROM node")
def most_specific_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    n, types = r.first_held(r.found("node")), r.types_around(T.NODE_ROLE)
    own = n.select(F.col("s").alias("uri"), "s").join(types.select("s", "type"), "s").select("uri", "type")
    orientation = n.select(F.col("s").alias("uri"), F.col("o").alias("s")).join(types.select("s", "type"), "s").select("uri", "type")
    return hierarchy.object_type(own, orientation, r.h)


@query("WITH " + _NODE + " SELECT uri, cls AS falls_under FROM node WHERE kind = 'c' OR cls = 'Hulpstuk'")
def falls_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    own = r.first_held(r.found("node")).select(F.col("s").alias("uri"), "s").join(r.types.select("s", "type"), "s").select("uri", "type")
    return hierarchy.falls_under(own, r.h, ["Put", "Hulpstuk"])


@query("SELECT true AS known, true AS edge_is_connection, false AS put_is_connection, '1.6' AS version")
def hierarchy_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Hierarchy.of(tables.class_graph(spark, sf_dir))
    version = scalars.version_of(scalars.base_of(F.col("type")))
    version = tables.graph(spark, sf_dir, items=False).types().select(F.min_by(version, F.when(version.isNotNull(), F.col("pos")))).first()[0]
    return spark.createDataFrame([(h.known(), h.is_connection_class("Leidingorientatie"), h.is_connection_class("Put"), version)], "known boolean, edge_is_connection boolean, put_is_connection boolean, version string")


_SOURCED = "CASE WHEN {k} % 3 = 1 THEN NULL WHEN {k} % 4 <> 0 THEN 'Meth_' || ({k} % 5) END"
_DATE = "CASE WHEN {k} % 3 = 1 OR {k} % 5 IN (1, 2) THEN NULL WHEN {k} % 5 = 0 THEN (1950 + {k} % 70) || '-01-01' ELSE (1950 + {k} % 70) || '-07-1' || ({k} % 10) END"


@query(
    """SELECT '{net}c' || k AS uri, CASE WHEN k % 10 <> 9 THEN c_name ELSE '' END AS label, CASE WHEN k % 7 = 0 THEN 'Put,' ELSE '' END || 'Seg_' || c_mktsegment AS types, '{net}c' || k || '_o' AS orientation,
  CASE WHEN k % 50 <> 0 AND k % 53 <> 1 THEN 1000.0 * (k % 97) END AS x, CASE WHEN k % 50 <> 0 AND k % 53 <> 1 THEN 1000.0 * (k % 89) END AS y, CASE WHEN k % 50 <> 0 AND k % 53 <> 1 THEN (k % 100) / 10.0::DOUBLE END AS z,
  '{net}n' || c_nationkey AS parents, CASE WHEN k % 4 <> 3 THEN (k % 40 // 10) || '.' || (k % 10) END AS ground, CASE WHEN k % 4 <> 3 THEN """
    + _SOURCED.replace("{k}", "k")
    + """ END AS ground_method, CASE WHEN k % 4 <> 3 THEN """
    + _DATE.replace("{k}", "k")
    + """ END AS ground_date, CASE WHEN k % 3 <> 2 THEN (k % 70 // 10) || '.' || (k % 10) END AS cover,
  (k % 3 <> 2)::INT + (k % 8 <> 7)::INT + (k % 3 = 0)::INT AS n_aspects FROM (SELECT *, c_custkey AS k FROM customer)
UNION ALL SELECT '{net}s' || k, '', CASE WHEN k % 3 = 0 THEN 'Hulpstuk' ELSE 'Compartiment' END, '{net}s' || k || '_o', NULL, NULL, NULL, CASE WHEN k % 10 <> 5 THEN '{net}c' || (k * 13 % {nc}) ELSE '' END, NULL, NULL, NULL, NULL, 0 FROM (SELECT s_suppkey AS k FROM supplier)"""
)
def nodes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _reader(spark, sf_dir).nodes()
    return n.select(
        "uri", "label", F.array_join(hierarchy.short_types(F.col("types")), ",").alias("types"), "orientation", F.get("point.xs", F.lit(0)).alias("x"), F.get("point.ys", F.lit(0)).alias("y"), "z",
        F.array_join("parents", ",").alias("parents"), F.col("ground_aspect.value").alias("ground"), F.col("ground_provenance.method").alias("ground_method"), F.date_format("ground_provenance.date", "yyyy-MM-dd").alias("ground_date"), F.col("cover_aspect.value").alias("cover"), F.size("aspects").alias("n_aspects"),
    )


@query("""WITH """ + _ENDS + """ SELECT '{net}o' || o.o_orderkey AS uri, 'Prio_' || left(o_orderpriority, 1) AS types, start_node, end_node, CASE WHEN k % 6 <> 5 THEN (k % 90 // 10) || '.' || (k % 10) END AS invert_start, CASE WHEN k % 6 <> 5 THEN (k % 80 // 10) || '.' || (k % 10) END AS invert_end,
  2::INT AS n_points, (k % 11 = 0 AND end_node IS NOT NULL) AS end_repaired FROM ends JOIN orders o ON o.o_orderkey = k""")
def conduits_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    c = r.conduits(_ends(r))
    return c.select("uri", F.array_join(hierarchy.short_types(F.col("types")), ",").alias("types"), "start_node", "end_node", F.col("bob_start_aspect.value").alias("invert_start"), F.col("bob_end_aspect.value").alias("invert_end"), F.size("line.xs").alias("n_points"), "end_repaired")


@query("""SELECT 'nodes_without_geometry' AS what, (SELECT count(*) FROM customer WHERE c_custkey % 50 = 0) + (SELECT count(*) FROM supplier) AS n
UNION ALL SELECT 'nodes_without_role', count(*) FROM customer WHERE false HAVING count(*) > 0""")
def structural_recognition_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).structural_differences()


@query("SELECT '{net}c' || c_custkey AS uri, 'a coordinate is not a number' AS error FROM customer WHERE c_custkey % 53 = 1 AND c_custkey % 50 <> 0")
def geometry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    return r.errors("node").unionAll(r.errors("conduit"))


_ITEM = """item AS (SELECT DISTINCT l_orderkey, l_linenumber AS ln, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS q, l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber % 5 <> 0 OR l_linenumber % 3 = 0)"""


@query("""WITH """ + _ITEM + """, a AS (SELECT l_orderkey, 'Flag_' || l_returnflag AS kind, CASE WHEN ln % 5 <> 0 THEN q::VARCHAR END AS value, CASE WHEN ln % 3 = 0 THEN 'Ship_' || l_linestatus END AS reference FROM item
UNION ALL SELECT l_orderkey, 'Status_' || l_linestatus, CASE WHEN ln % 5 <> 0 THEN q::VARCHAR END, CASE WHEN ln % 3 = 0 THEN 'Ship_' || l_linestatus END FROM item WHERE ln % 4 = 0)
SELECT '{net}o' || l_orderkey AS s, kind, value, reference, count(*) AS n FROM a GROUP BY ALL""")
def attributes_of_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Reader(Graph(tables.item_triples(spark, sf_dir), TERMS))
    return r.attributes().select("s", F.explode("aspects").alias("a")).groupBy("s", "a.kind", "a.value", "a.reference").agg(F.count("*").alias("n"))


@query("SELECT '{net}c' || k || CASE WHEN k % 3 = 0 THEN '_mh' ELSE '_mp' END AS s, " + _SOURCED.replace("{k}", "k") + " AS method, " + _DATE.replace("{k}", "k") + " AS date FROM (SELECT c_custkey AS k FROM customer) WHERE k % 3 <> 1 AND (k % 4 <> 0 OR k % 5 NOT IN (1, 2))")
def provenance_first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    return r.provenance().select("s", "provenance.method", F.date_format("provenance.date", "yyyy-MM-dd").alias("date"))


@query("SELECT '{net}c' || k || '_o' AS o, (k % 40 // 10) || '.' || (k % 10) AS level, " + _SOURCED.replace("{k}", "k") + " AS method FROM (SELECT c_custkey AS k FROM customer) WHERE k % 4 <> 3")
def ground_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    return r.ground().select("o", F.col("aspect.value").alias("level"), "provenance.method")


@query("SELECT '{net}c' || k AS s, (k % 70 // 10) || '.' || (k % 10) AS level FROM (SELECT c_custkey AS k FROM customer) WHERE k % 3 <> 2")
def cover_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    return r.cover().filter(F.col("s").rlike(f"^{NET}c[0-9]+$")).select("s", F.col("aspect.value").alias("level"))


@query("""WITH """ + _ENDS + """ SELECT count(*) AS n_couplings, count(DISTINCT s) AS n_fittings FROM ends WHERE k % 11 = 0 AND end_node IS NOT NULL""")
def endpoint_binding_with_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    n = r.first_held(r.found("node")).join(r.type_sets().toDF("o", "orientation_types"), "o").select(F.col("s").alias("uri"), F.col("o").alias("orientation"), "orientation_types", "ord")
    bind = r.bindings(kept(n)).filter("repaired")
    return bind.agg(F.count("*").alias("n_couplings"), F.countDistinct("node").alias("n_fittings"))


@query("""SELECT '{net}c' || k AS uri, CASE WHEN k % 4 <> 3 AND k % 40 > 3 THEN (k % 40 // 10) || '.' || (k % 10) END AS ground, CASE WHEN k % 4 <> 3 AND k % 40 <= 3 THEN (k % 40) / 10.0::DOUBLE END AS filler FROM (SELECT c_custkey AS k FROM customer)""")
def filler_values_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _reader(spark, sf_dir).nodes().filter(F.col("uri").rlike(f"^{NET}c"))
    m = domain.mark_fillers(n, ["Maaiveldhoogte"], 0.3)
    return m.select("uri", F.col("ground_aspect.value").alias("ground"), F.get("fillers", F.lit(0))["value"].alias("filler"))


@query("SELECT 'conduit' AS what, '{net}o' || o_orderkey AS uri FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'node', '{net}c' || c_custkey FROM customer WHERE c_custkey % 3 = 0")
def subset_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    wanted = tables.read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(tables.iri("o", F.col("o_orderkey")).alias("uri")).unionAll(tables.read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(tables.iri("c", F.col("c_custkey")))).distinct()
    both = r.first_held(r.found("node")).select(F.lit("node").alias("what"), F.col("s").alias("uri")).unionAll(r.first_held(r.found("conduit")).select(F.lit("conduit"), "s"))
    return both.join(wanted, "uri", "left_semi").select("what", "uri")


@query("SELECT '{net}n' || c_nationkey AS holder, 0::INT AS n_conduits, string_agg('{net}c' || c_custkey, ',' ORDER BY '{net}c' || c_custkey) AS nodes FROM customer GROUP BY c_nationkey")
def system_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    n, c = r.first_held(r.found("node")).select(F.col("s").alias("uri")), r.first_held(r.found("conduit")).select(F.col("s").alias("uri"))
    got = domain.system_members(r.g, n, c).filter(F.col("holder").startswith(NET + "n"))
    return got.select("holder", F.size("conduits").alias("n_conduits"), F.array_join("nodes", ",").alias("nodes"))


@query("SELECT '{net}c' || c_custkey || '_w' AS s, NULL::VARCHAR AS value, CASE WHEN c_custkey % 8 <> 7 THEN '{base}Thema_' || (c_custkey % 4) END AS reference FROM customer")
def attribute_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.attribute_instances(tables.graph(spark, sf_dir, items=False), "WIBONThema")


@query("SELECT '{net}c' || k || '_mh' AS s, (k % 40 // 10) || '.' || (k % 10) AS value FROM (SELECT c_custkey AS k FROM customer) WHERE k % 4 <> 3")
def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.attribute_values(tables.graph(spark, sf_dir, items=False), "Maaiveldhoogte")


@query("SELECT '{net}n' || c_nationkey AS holder, count(*) AS n_parts FROM customer GROUP BY ALL UNION ALL SELECT '{net}c' || (s_suppkey * 13 % {nc}), count(*) FROM supplier WHERE s_suppkey % 10 <> 5 GROUP BY ALL")
def parts_filtered_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.graph(spark, sf_dir, items=False)
    return domain.parts_of(g, Hierarchy.of(tables.class_graph(spark, sf_dir)), "Bouwwerk").groupBy("holder").agg(F.count("*").alias("n_parts"))


@query("SELECT '{net}s' || k AS uri, CASE WHEN k % 10 <> 5 THEN '{net}c' || (k * 13 % {nc}) END AS node, CASE WHEN k % 10 <> 5 THEN 2 ELSE 1 END AS n_visited FROM (SELECT s_suppkey AS k FROM supplier) UNION ALL SELECT '{net}n' || n_nationkey, NULL, 0 FROM nation")
def climb_to_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    starts = tables.read(spark, sf_dir, "supplier").select(tables.iri("s", F.col("s_suppkey")).alias("uri")).unionAll(tables.read(spark, sf_dir, "nation").select(tables.iri("n", F.col("n_nationkey"))))
    return network.climb(starts, _slim_nodes(r), r.h, ["Put"]).select("uri", "node", F.size("visited").alias("n_visited"))


def _slim_nodes(r: Reader) -> DataFrame:
    """Only what climbing and directions need of nodes."""
    empty, near = F.array().cast("array<string>"), r.around(T.NODE_ROLE)
    n = r.first_held(r.found("node")).join(r.type_sets(near), "s", "left").join(r.type_sets(near).toDF("o", "orientation_types"), "o", "left").join(r.parents(), "s", "left").join(r.geometry(T.POINT), "o", "left")
    return kept(n.select(F.col("s").alias("uri"), F.col("o").alias("orientation"), F.coalesce("types", empty).alias("types"), F.coalesce("orientation_types", empty).alias("orientation_types"), F.coalesce("parents", empty).alias("parents"), F.col("geom").alias("point"), "ord"))


def _slim_conduits(r: Reader, nodes: DataFrame) -> DataFrame:
    bind = kept(r.bindings(nodes).select("point", "node"))
    c = r.first_held(r.found("conduit")).join(r.endpoints(), "o", "left").join(bind.toDF("begin", "start_node"), "begin", "left").join(bind.toDF("end", "end_node"), "end", "left").join(r.geometry(T.LINE), "o", "left")
    return c.select(F.col("s").alias("uri"), "start_node", "end_node", F.col("geom").alias("line"))


_NETWORK_NODE = """reach AS (SELECT k, CASE WHEN k % 9 <> 4 THEN '{net}c' || a WHEN s % 10 <> 5 THEN '{net}c' || (s * 13 % {nc}) END AS start_, CASE WHEN k % 11 <> 0 THEN '{net}c' || b WHEN s % 3 = 0 AND s % 10 <> 5 THEN '{net}c' || (s * 13 % {nc}) END AS end_, a, b FROM ends)"""


@query("WITH " + _ENDS + ", " + _NETWORK_NODE + " SELECT '{net}o' || k AS uri, start_ AS start_network, end_ AS end_network FROM reach")
def conduit_network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    n = _slim_nodes(r)
    return network.conduit_nodes(_slim_conduits(r, n), n, r.h, ["Put"]).toDF("uri", "start_network", "end_network")


@query("""WITH """ + _ENDS + ", " + _NETWORK_NODE + """, p AS (SELECT '{net}c' || c_custkey AS u, 1000.0 * (c_custkey % 97) AS x, 1000.0 * (c_custkey % 89) AS y FROM customer WHERE c_custkey % 50 <> 0 AND c_custkey % 53 <> 1),
l AS (SELECT reach.*, CASE WHEN k % 4 = 0 THEN b ELSE a END AS f, CASE WHEN k % 4 = 0 THEN a ELSE b END AS g FROM reach),
d AS (SELECT l.k, start_, end_, p1.x IS NOT NULL AND p2.x IS NOT NULL AS both_,
  sqrt((p1.x - 1000 * (f % 97)) ** 2 + (p1.y - 1000 * (f % 89)) ** 2) + sqrt((p2.x - 1000 * (g % 97)) ** 2 + (p2.y - 1000 * (g % 89)) ** 2) AS straight,
  sqrt((p1.x - 1000 * (g % 97)) ** 2 + (p1.y - 1000 * (g % 89)) ** 2) + sqrt((p2.x - 1000 * (f % 97)) ** 2 + (p2.y - 1000 * (f % 89)) ** 2) AS crossed
  FROM l LEFT JOIN p p1 ON p1.u = start_ LEFT JOIN p p2 ON p2.u = end_)
SELECT '{net}o' || k AS uri, CASE WHEN start_ <> end_ AND both_ THEN CAST(crossed < straight AS VARCHAR) END AS reversed FROM d""")
def drawing_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    n = _slim_nodes(r)
    return network.drawing_direction(_slim_conduits(r, n), n, r.h, ["Put"]).withColumn("reversed", F.col("reversed").cast("string"))


@query("SELECT '{base}Dt_' || p_partkey AS datatype, CASE WHEN p_partkey % 2 = 0 THEN 'integer' ELSE 'decimal' END AS base, (p_partkey % 50)::VARCHAR AS low, CASE WHEN p_partkey % 5 <> 0 THEN (p_size + 50)::VARCHAR END AS high FROM part")
def facet_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restrictions.facet_ranges(Graph(tables.restriction_triples(spark, sf_dir), TERMS))


@query("SELECT '{base}K_' || p_partkey AS class, CASE WHEN p_partkey % 2 = 0 THEN 'integer' ELSE 'decimal' END AS base, (p_partkey % 50)::VARCHAR AS low, CASE WHEN p_partkey % 5 <> 0 THEN (p_size + 50)::VARCHAR END AS high FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 3")
def attribute_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restrictions.attribute_ranges(Graph(tables.restriction_triples(spark, sf_dir), TERMS))


@query("SELECT 'K_' || p_partkey AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'hasReference' ELSE 'hasValue' END AS property FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 4 = 3)")
def expected_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(tables.restriction_triples(spark, sf_dir), TERMS)
    return restrictions.attribute_properties(g, Hierarchy.of(g))


@query("""WITH RECURSIVE k AS (SELECT p_partkey AS k FROM part), up(k, a) AS (SELECT k, k // 10 FROM k WHERE k >= 10 UNION SELECT k, a // 10 FROM up WHERE a >= 10),
own AS (SELECT k, 'Doen_' || (k % 7) AS f FROM k WHERE k % 4 = 0), inh AS (SELECT up.k, arg_min(f, 'F_' || own.k) AS f FROM up JOIN own ON own.k = up.a GROUP BY up.k)
SELECT '{base}F_' || k.k AS class, coalesce(own.f, inh.f) AS function FROM k LEFT JOIN own ON own.k = k.k LEFT JOIN inh ON inh.k = k.k WHERE coalesce(own.f, inh.f) IS NOT NULL""")
def class_function_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(tables.restriction_triples(spark, sf_dir), TERMS)
    return restrictions.class_functions(g, Hierarchy.of(g))


@query("""WITH RECURSIVE """ + _CLOSURE + """, term AS (SELECT sub AS t FROM edge UNION SELECT sup FROM edge) SELECT t AS term, coalesce((SELECT string_agg(DISTINCT sup, ',' ORDER BY sup) FROM edge WHERE sub = t), '') AS superclasses FROM term""")
def vocabulary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restrictions.vocabulary_index(tables.class_graph(spark, sf_dir)).select("term", F.array_join("superclasses", ",").alias("superclasses"))


@query("""SELECT page_id, regexp_extract(url, '([^/#]*)$', 1) AS name, CASE WHEN page_id % 3 = 0 THEN 'http://data.gwsw.nl/1.' || (page_id % 9) || '/totaal/' END AS base, CASE WHEN page_id % 3 = 0 THEN '1.' || (page_id % 9) END AS version FROM pages""")
def short_name_and_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "pages")
    made = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://data.gwsw.nl/1."), (F.col("page_id") % 9).cast("string"), F.lit("/totaal/Put"))).otherwise(F.col("url"))
    base = scalars.base_of(made)
    return p.select("page_id", short("url").alias("name"), base.alias("base"), scalars.version_of(base).alias("version"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN (event_id % 1000)::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN -(event_id % 100)::DOUBLE WHEN 4 THEN NULL ELSE (event_id % 50) * 100.0 END AS number FROM events""")
def aspect_number_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    text = F.element_at(F.array(F.lit("onbekend"), F.concat(F.lit(" "), (k % 1000).cast("string"), F.lit(".0 ")), F.concat((k % 9).cast("string"), F.lit("d")), F.concat(F.lit("-"), (k % 100).cast("string")), F.lit(""), F.concat((k % 50).cast("string"), F.lit("e2"))), (k % 6 + 1).cast("int"))
    return tables.read(spark, sf_dir, "events").select("event_id", scalars.number(text).alias("number"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN (1900 + event_id % 100) || '-01-01' END AS date FROM events""")
def aspect_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    text = F.element_at(F.array(day, F.concat(day, F.lit("T10:00:00")), F.concat(F.lit(" "), (1900 + k % 100).cast("string")), F.lit("2023-02-30"), F.lit("0000"), F.lit("geen datum")), (k % 6 + 1).cast("int"))
    return tables.read(spark, sf_dir, "events").select("event_id", F.date_format(scalars.date_of(text), "yyyy-MM-dd").alias("date"))


@query("""WITH v AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 3 THEN (c_custkey % 40) / 10.0::DOUBLE END AS g, CASE WHEN c_custkey % 3 <> 2 THEN (c_custkey % 70) / 10.0::DOUBLE END AS c, CASE WHEN c_custkey % 3 <> 2 THEN (500 + c_custkey % 3000) / 1000.0::DOUBLE END AS h FROM customer)
SELECT '{net}c' || k AS uri, g AS ground, c AS cover, coalesce(c, g) AS top, h AS height_m, round(coalesce(c, g) - h, 6) AS bottom FROM v""")
def derived_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _reader(spark, sf_dir).nodes().filter(F.col("uri").startswith(NET + "c"))
    d = scalars.node_columns()
    return n.select("uri", d["ground"].alias("ground"), d["cover"].alias("cover"), d["top"].alias("top"), d["height_m"].alias("height_m"), F.round(d["bottom"], 6).alias("bottom"))


@query("""SELECT '{net}o' || k AS uri, CASE WHEN k % 6 <> 5 THEN round((k % 90) / 10.0::DOUBLE - (k % 80) / 10.0::DOUBLE, 6) END AS invert_fall, CASE WHEN k % 13 <> 0 THEN (k % 75 + 1)::DOUBLE END AS length_m FROM (SELECT o_orderkey AS k FROM orders)""")
def derived_conduit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    c = r.first_held(r.found("conduit", True)).join(r.endpoints(), "o").join(r.of_class(T.BEGIN_INVERT).toDF("begin", "bob_start_aspect"), "begin", "left").join(r.of_class(T.END_INVERT).toDF("end", "bob_end_aspect"), "end", "left").join(r.attributes(), "s", "left")
    c = c.withColumn("z_values", F.array().cast("array<double>"))
    d = scalars.conduit_columns()
    return c.select(F.col("s").alias("uri"), F.round(d["invert_fall"], 6).alias("invert_fall"), d["length_m"].alias("length_m"))


def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GML literal per part, of eight forms."""
    k = F.col("p_partkey")
    n = lambda m: (k % m).cast("string")
    forms = F.array(
        F.concat(F.lit("<gml:Point><gml:pos>"), n(90), F.lit(" "), n(80), F.lit("</gml:pos></gml:Point>")),
        F.concat(F.lit('<gml:LineString srsDimension="3"><gml:posList>1 2 '), n(30), F.lit(" 4 5 "), n(60), F.lit("</gml:posList></gml:LineString>")),
        F.concat(F.lit("<gml:Polygon><gml:LinearRing><gml:posList>0 0 1 0 1 "), n(7), F.lit("  0 0</gml:posList></gml:LinearRing></gml:Polygon>")),
        F.lit("<gml:LineString><gml:posList>1 2 3 4 5</gml:posList></gml:LineString>"),
        F.lit("<gml:MultiCurve><gml:LineString><gml:posList>0 0 1 1</gml:posList></gml:LineString><gml:LineString><gml:posList>2 2 3 3</gml:posList></gml:LineString></gml:MultiCurve>"),
        F.lit("<gml:Curve><gml:pos>1 2</gml:pos></gml:Curve>"),
        F.lit("<gml:LineString><gml:posList></gml:posList></gml:LineString>"),
        F.lit('<gml:LineString srsDimension="2"><gml:posList>1 2</gml:posList></gml:LineString>'),
    )
    return tables.read(spark, sf_dir, "part").select(k.alias("k"), F.element_at(forms, (k % 8 + 1).cast("int")).alias("literal"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' WHEN 4 THEN 'LineString' END AS kind, CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 4 THEN 2 ELSE -1 END AS n_points,
  CASE WHEN p_partkey % 8 = 1 THEN (p_partkey % 30) || '.0,' || (p_partkey % 60) || '.0' ELSE '' END AS heights, p_partkey % 8 IN (3, 5, 6, 7) AS broken, p_partkey % 8 = 4 AS multipart FROM part""")
def gml_kind_dim_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _literals(spark, sf_dir).withColumn("g", gml.parsed(F.col("literal")))
    return g.select("k", F.col("g.geom.kind").alias("kind"), F.when(F.col("g.geom").isNotNull(), F.size("g.geom.xs")).otherwise(-1).alias("n_points"), F.array_join("g.zs", ",").alias("heights"), F.col("g.error").isNotNull().alias("broken"), gml.is_multipart(F.col("literal")).alias("multipart"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN 8 WHEN 3 THEN 5 WHEN 4 THEN 4 WHEN 5 THEN 2 WHEN 6 THEN 0 ELSE 2 END AS n_tokens, CASE p_partkey % 8 WHEN 0 THEN (p_partkey % 90) || ' ' || (p_partkey % 80) WHEN 1 THEN '1 2 ' || (p_partkey % 30) || ' 4 5 ' || (p_partkey % 60) WHEN 2 THEN '0 0 1 0 1 ' || (p_partkey % 7) || ' 0 0' WHEN 3 THEN '1 2 3 4 5' WHEN 4 THEN '0 0 1 1' WHEN 5 THEN '1 2' WHEN 6 THEN '' ELSE '1 2' END AS tokens,
  p_partkey % 8 IN (1, 7) AS declared, CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 1 WHEN 7 THEN 1 ELSE -1 END AS per_two FROM part""")
def coordinate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.col("literal")
    t = gml.coordinate_tokens(lit)
    return _literals(spark, sf_dir).select("k", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"), gml.has_dimension(lit).alias("declared"), F.coalesce(gml.tokens_per_point(lit, F.lit(2)), F.lit(-1)).alias("per_two"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN '<gml:Point><gml:pos>9 9</gml:pos></gml:Point>' WHEN 1 THEN '<gml:LineString srsDimension="3"><gml:posList>9 9</gml:posList></gml:LineString>' WHEN 2 THEN '<gml:Polygon><gml:LinearRing><gml:posList>9 9</gml:posList></gml:LinearRing></gml:Polygon>' WHEN 3 THEN '<gml:LineString><gml:posList>9 9</gml:posList></gml:LineString>'
  WHEN 4 THEN '<gml:MultiCurve><gml:LineString><gml:posList>9 9</gml:posList></gml:LineString><gml:LineString><gml:posList>2 2 3 3</gml:posList></gml:LineString></gml:MultiCurve>' WHEN 5 THEN '<gml:Curve><gml:pos>9 9</gml:pos></gml:Curve>' WHEN 6 THEN '<gml:LineString><gml:posList>9 9</gml:posList></gml:LineString>' ELSE '<gml:LineString srsDimension="2"><gml:posList>9 9</gml:posList></gml:LineString>' END AS literal FROM part""")
def replace_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, sf_dir).select("k", gml.replace_coordinates(F.col("literal"), F.lit("9 9")).alias("literal"))


# Boundaries for the grid of points (x below 97,000, y below 89,000): three strips, the third in two parts with a gap.
def strips() -> list[Polygon]:
    box = lambda x1, x2, y1, y2: [[(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]]
    return [Polygon("West", "West", [box(-1, 30500, -1, 90000)]), Polygon("Mid", "Mid", [box(30500, 60500, -1, 90000)]), Polygon("East", "East", [box(60500, 98000, -1, 40500), box(60500, 98000, 50500, 90000)])]


_SPOT = """spot AS (SELECT c_custkey AS k, 1000 * (c_custkey % 97) AS x, 1000 * (c_custkey % 89) AS y FROM customer WHERE c_custkey % 50 <> 0 AND c_custkey % 53 <> 1)"""
_PART = "CASE WHEN x <= 30500 THEN 0 WHEN x <= 60500 THEN 1 WHEN y <= 40500 OR y >= 50500 THEN 2 WHEN x - 60500 < least(y - 40500, 50500 - y) OR (x - 60500 = least(y - 40500, 50500 - y)) THEN 1 ELSE 2 END"


@query("WITH " + _SPOT + " SELECT '{net}c' || k || '_p' AS s, 1 << " + f"({_PART})" + "::INT AS mask FROM spot")
def point_in_polygon_or_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = _geometries(spark, sf_dir, r"c\d+_p$")
    return clip.placed(lit, strips()).filter("mask[0] <> 0").select("s", F.get("mask", F.lit(0)).cast("int").alias("mask"))


def _geometries(spark: SparkSession, sf_dir: str, pattern: str, cut: bool = True) -> DataFrame:
    g = tables.graph(spark, sf_dir, items=False)
    lit = g.of(TERMS.has_value).filter((F.col("dt") == T.GML_LITERAL) & F.col("s").rlike(pattern))
    return lit.select("s", F.col("o").alias("literal"), F.lit(cut).alias("cut"))


# The ends of conduits' lines, in the order in which they are drawn.
_DRAWN = """e AS (SELECT o_orderkey AS k, o_custkey AS a, (o_custkey * 7 + 13) % {nc} AS b FROM orders), drawn AS (
  SELECT k, 1000 * (f % 97) AS x0, 1000 * (f % 89) AS y0, 1000 * (g % 97) AS x1, 1000 * (g % 89) AS y1
  FROM (SELECT k, CASE WHEN k % 4 = 0 THEN b ELSE a END AS f, CASE WHEN k % 4 = 0 THEN a ELSE b END AS g FROM e))"""


@query("""WITH """ + _DRAWN + """, part_of AS (SELECT *,
    CASE WHEN x0 >= 60500 AND x1 >= 60500 THEN 0 WHEN x0 >= 60500 THEN 0 WHEN x1 >= 60500 THEN (60500 - x0)::DOUBLE / (x1 - x0) END AS e0,
    CASE WHEN x1 >= 60500 THEN 1 WHEN x0 >= 60500 THEN (x0 - 60500)::DOUBLE / (x0 - x1) END AS e1,
    CASE WHEN y0 <= 40500 THEN 0 WHEN y1 <= 40500 THEN (y0 - 40500)::DOUBLE / (y0 - y1) END AS s0,
    CASE WHEN y1 <= 40500 THEN 1 WHEN y0 <= 40500 THEN (40500 - y0)::DOUBLE / (y1 - y0) END AS s1,
    CASE WHEN y0 >= 50500 THEN 0 WHEN y1 >= 50500 THEN (50500 - y0)::DOUBLE / (y1 - y0) END AS n0,
    CASE WHEN y1 >= 50500 THEN 1 WHEN y0 >= 50500 THEN (y0 - 50500)::DOUBLE / (y0 - y1) END AS n1 FROM drawn),
bits AS (SELECT k, x0 AS x, y0 AS y, (least(x0, x1) <= 30500)::INT + 2 * (least(x0, x1) <= 60500 AND greatest(x0, x1) >= 30500)::INT
    + 4 * coalesce((e0 <= s1 AND s0 <= e1) OR (e0 <= n1 AND n0 <= e1), (e0 <= s1 AND s0 <= e1), (e0 <= n1 AND n0 <= e1), false)::INT AS mask FROM part_of)
SELECT '{net}o' || k || '_l' AS s, CASE WHEN mask = 0 THEN 1 << (""" + _PART + """)::INT ELSE mask END AS mask FROM bits""")
def line_touches_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that aren't cut, against all three strips; one that meets none is its own point's."""
    lit = _geometries(spark, sf_dir, r"o\d+_l$", cut=False)
    return clip.placed(lit, strips()).select("s", F.get("mask", F.lit(0)).cast("int").alias("mask"))


@query("""WITH """ + _DRAWN + """, cuts AS (SELECT k, list(t ORDER BY o) AS ts FROM (
    SELECT k, printf('%.3f %.3f', c::DOUBLE, y0 + (c - x0)::DOUBLE / (x1 - x0) * (y1 - y0)) AS t, CASE WHEN x1 > x0 THEN c ELSE -c END AS o
    FROM drawn, (VALUES (30500), (60500)) v(c) WHERE least(x0, x1) < c AND greatest(x0, x1) > c) GROUP BY k),
stops AS (SELECT drawn.k, (x0 > 30500)::INT + (x0 > 60500)::INT AS p, sign(x1 - x0)::INT AS way, CASE WHEN ts IS NOT NULL THEN list_concat([x0 || ' ' || y0], ts, [x1 || ' ' || y1]) END AS s FROM drawn LEFT JOIN cuts ON cuts.k = drawn.k)
SELECT '{net}o' || k || '_l' AS s, 0 AS sequence, p AS part, NULL::VARCHAR AS coordinates, false AS inserted_end FROM stops WHERE s IS NULL
UNION ALL SELECT '{net}o' || k || '_l', i::INT, p + way * i::INT, s[i + 1] || ' ' || s[i + 2], i < len(s) - 2 FROM stops, unnest(range(len(s) - 1)) AS t(i) WHERE s IS NOT NULL""")
def line_cut_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its text; a line that isn't cut is one row without."""
    box = lambda x1, x2: [[(x1, -1), (x2, -1), (x2, 90000), (x1, 90000), (x1, -1)]]
    layer = [Polygon(n, n, [box(a, b)]) for n, a, b in (("A", -1, 30500), ("B", 30500, 60500), ("C", 60500, 98000))]
    got = clip.placed(_geometries(spark, sf_dir, r"o\d+_l$"), layer)
    alone = F.struct(F.log2(F.get("mask", F.lit(0))).cast("int").alias("part"), F.lit(0).alias("sequence"), F.lit(None).cast("string").alias("coordinates"), F.lit(False).alias("inserted_end"))
    return got.select("s", F.explode(F.coalesce("pieces", F.array(alone))).alias("p")).select("s", "p.sequence", "p.part", "p.coordinates", "p.inserted_end")


@query("""SELECT '_:' || t || p_partkey AS b, CASE WHEN t IN ('e', 'x', 'y', 'lo', 'hi') THEN '{base}Dt_' || p_partkey WHEN t = 'f' THEN '{base}F_' || p_partkey ELSE '{base}K_' || p_partkey END AS owner
FROM part, (VALUES ('r'), ('e'), ('x'), ('y'), ('lo'), ('hi'), ('f')) v(t) WHERE (t <> 'f' OR p_partkey % 4 = 0)""")
def block_owner_of_bnode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip.owners(Graph(tables.restriction_triples(spark, sf_dir), TERMS))


@query("""WITH """ + _SPOT + """, m AS (SELECT k, 1 << (""" + _PART + """)::INT AS mask FROM spot), c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
up AS (SELECT n, bit_or(mask) AS mask FROM c JOIN m USING (k) GROUP BY n)
SELECT '{net}c' || c.k AS block, coalesce(m.mask, up.mask)::BIGINT AS mask FROM c LEFT JOIN m USING (k) JOIN up USING (n)
UNION ALL SELECT '{net}c' || c.k || '_o', coalesce(m.mask, CASE WHEN c.k % 3 = 2 AND bit_count(up.mask) > 1 AND up.mask & 1 <> 0 THEN 1 ELSE up.mask END)::BIGINT FROM c LEFT JOIN m USING (k) JOIN up USING (n)
UNION ALL SELECT '{net}n' || n, mask::BIGINT FROM up""")
def block_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks up and down again: customers without a point take those of their nation, and their orientations of these what they are connected with."""
    g = Graph(tables.customer_triples(spark, sf_dir), TERMS).stored()
    m = clip.Plan(g, strips()).masks
    return m.filter(F.col("block").rlike(f"^{NET}([cn][0-9]+|c[0-9]+_o)$")).select("block", F.get("mask", F.lit(0)).alias("mask"))


@query("SELECT part, count(*) AS n FROM (WITH " + _SPOT + " SELECT " + _PART + " AS part FROM spot) GROUP BY part")
def clip_points_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = clip.clip(Graph(tables.customer_triples(spark, sf_dir), TERMS).stored(), strips())
    readable = (F.col("p") == TERMS.has_value) & (F.col("dt") == T.GML_LITERAL) & F.col("o").contains("srsDimension")
    return parts.filter(readable).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, true AS has_cuts")
def clip_merge_roundtrip_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = tables.sizes(spark, sf_dir)
    rows = tables.holder_triples(spark, sf_dir).unionAll(tables.customer_triples(spark, sf_dir)).unionAll(tables.supplier_triples(spark, sf_dir, c)).unionAll(tables.order_triples(spark, sf_dir, c, s))
    g = Graph.by_subject(rows, TERMS)
    parts = kept(clip.clip(g, strips()))
    back = clip.merge(parts, TERMS)
    columns = ["s", "p", "o", "kind", "lang", "dt"]
    key = F.unhex(F.sha2(F.concat_ws("\x01", *[F.coalesce(c, F.lit("\x02")) for c in columns]), 256)).alias("k")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = g.triples.select(key, one.alias("a"), none.alias("b")).unionAll(back.select(key, none, one)).repartition("k").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    only = lambda x, y: F.coalesce(F.sum(F.when(F.col(y) == 0, F.col(x))), none)
    found = both.agg(only("a", "b").alias("missing"), only("b", "a").alias("extra"))
    cuts = parts.agg(F.max(F.col("p") == clip.ORIGIN).alias("has_cuts"))
    return found.withColumn("one", F.lit(1)).join(cuts.withColumn("one", F.lit(1)), "one").drop("one")


@query("SELECT 0.0::DOUBLE AS x_min, false AS fits_degrees, true AS fits_metres")
def bounding_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(tables.order_triples(spark, sf_dir, *tables.sizes(spark, sf_dir)), TERMS)
    box = clip.bounds_of_geometry(g)
    return spark.createDataFrame([(box[0], not clip.range_reasons((3.3, 50.7, 7.2, 53.6), box), not clip.range_reasons(clip.layer_box(strips()), box))], "x_min double, fits_degrees boolean, fits_metres boolean")


@query(r"""SELECT doc_id, (strlen(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')))::BIGINT AS non_ascii FROM documents""")
def non_ascii_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.non_ascii_report(tables.read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "non_ascii")


@query(r"""
WITH lines AS (
  SELECT unnest(string_split(regexp_replace(text, '[^\x{0}-\x{FF}]', '?', 'g'), chr(10))) AS line FROM documents WHERE text IS NOT NULL
)
SELECT line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x00-\x7F]') GROUP BY line
""")
def lines_recoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines beyond ASCII of all texts, written in files of an encoding of single bytes and read with it as the fallback."""
    folder = f"{shared_folder(spark)}/sluice-latin-{uuid.uuid4().hex}"
    single = F.encode(F.regexp_replace("text", r"[^\x{0}-\x{FF}]", "?"), "ISO-8859-1").cast("string")
    tables.read(spark, sf_dir, "documents").filter("text is not null").select(single.alias("value")).write.text(folder)
    lines = encoding.recoded(spark, folder, "latin-1").filter(F.col("line").rlike(r"[^\x00-\x7F]"))
    return lines.groupBy("line").agg(F.count("*").alias("n"))


def _through_a_folder(triples: DataFrame) -> Graph:
    """The triples after writing them as Turtle into a folder and reading that."""
    folder = f"{shared_folder(triples.sparkSession)}/sluice-turtle-{uuid.uuid4().hex}"
    sink.write_folder(triples, folder)
    return Graph(turtle.read(triples.sparkSession, folder), TERMS)


@query("""SELECT '{net}c' || k AS customer, 'Seg_' || c_mktsegment || CASE WHEN k % 7 = 0 THEN ',Put' ELSE '' END AS types, CASE WHEN k % 10 <> 9 THEN c_name END AS label,
  9 + (k % 7 = 0)::BIGINT + (k % 10 <> 9)::BIGINT + 3 * (k % 50 <> 0)::BIGINT + (k % 2 = 1 OR k % 5 = 0)::BIGINT + 3 * (k % 3 <> 2)::BIGINT + (k % 8 <> 7)::BIGINT + (k % 4 <> 3)::BIGINT + 2 * (k % 3 = 0)::BIGINT + 4 * (k % 3 = 2)::BIGINT
    + (k % 3 <> 1)::BIGINT * (6 + (k % 4 <> 0)::BIGINT) + 4 * (k % 3 = 1)::BIGINT + 2 * (k % 3 <> 2)::BIGINT AS n_triples
FROM (SELECT *, c_custkey AS k FROM customer)""")
def turtle_roundtrip_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' triples written as Turtle into a folder and read back: how many each customer has, its classes in their order, its label."""
    back = _through_a_folder(Graph(tables.customer_triples(spark, sf_dir), TERMS).triples)
    own = back.triples.filter(F.col("s").startswith(NET + "c")).withColumn("customer", F.regexp_extract("s", f"^({NET}c[0-9]+)", 1))
    itself = F.col("s") == F.col("customer")
    types = F.array_sort(F.collect_list(F.when(itself & (F.col("p") == T.TYPE), F.struct("pos", "o"))))
    return own.groupBy("customer").agg(F.array_join(F.transform(types, lambda t: scalars.short_name(t["o"])), ",").alias("types"), F.max(F.when(itself & (F.col("p") == T.LABEL), F.col("o"))).alias("label"), F.count("*").alias("n_triples"))


@query("WITH c AS (" + SQL["turtle_roundtrip_diff"] + """)
SELECT 'N' || c_nationkey AS part, count(*) AS customers, count(label) AS labels, sum(n_triples)::BIGINT AS statements, sum(n_triples)::BIGINT AS lines FROM c JOIN customer ON customer = '{net}c' || c_custkey GROUP BY c_nationkey
UNION ALL SELECT 'N' || n_nationkey, 0, 0, 0, 0 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""")
def parts_written_by_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' triples in a Turtle file for each nation, split into ranges, all written by one job: what is read of each nation's customers, and how many lines its file has."""
    triples = Graph(tables.customer_triples(spark, sf_dir), TERMS).triples
    nation = tables.read(spark, sf_dir, "customer").select(F.concat(F.lit(NET + "c"), F.col("c_custkey").cast("string")).alias("customer"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("part"))
    names = [f"N{r[0]}.ttl" for r in tables.read(spark, sf_dir, "nation").select("n_nationkey").collect()]
    of = lambda df: df.filter(F.col("s").startswith(NET + "c")).withColumn("customer", F.regexp_extract("s", f"^({NET}c[0-9]+)", 1)).join(nation, "customer")
    folder = f"{shared_folder(spark)}/sluice-turtle-{uuid.uuid4().hex}"
    sink.write_parts(of(triples).withColumn("file", F.concat("part", F.lit(".ttl"))), folder, files=names, split=True)
    text = spark.read.text(f"{folder}/*.ttl").withColumn("part", F.regexp_extract(F.input_file_name(), r"/(N\d+)\.ttl/[^/]*$", 1))
    lines = text.groupBy("part").agg(F.count_if(~F.col("value").rlike("^[#@]")).alias("lines"))
    label = (F.col("s") == F.col("customer")) & (F.col("p") == T.LABEL)
    read = of(turtle.read(spark, f"{folder}/*.ttl")).groupBy("part", "customer").agg(F.count("*").alias("n"), F.max(label).cast("long").alias("label"))
    read = read.groupBy("part").agg(F.count("*").alias("customers"), F.sum("label").alias("labels"), F.sum("n").alias("statements"))
    return lines.join(read, "part", "left").select("part", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("customers", "labels", "statements")], "lines")


@query("""SELECT '{base}Dt_' || p_partkey AS datatype, CASE WHEN p_partkey % 2 = 0 THEN 'integer' ELSE 'decimal' END AS base, (p_partkey % 50)::VARCHAR AS low, CASE WHEN p_partkey % 5 <> 0 THEN (p_size + 50)::VARCHAR END AS high, (SELECT 6 * count(*) + count(*) FILTER (p_partkey % 4 = 0) FROM part) AS n_blank FROM part""")
def turtle_folder_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ontology of blank nodes and lists, written into a folder's parts and read back: every list still has its own cells, and there are as many blank nodes as before."""
    back = _through_a_folder(Graph(tables.restriction_triples(spark, sf_dir), TERMS).triples)
    graph = Graph(kept(back.triples), TERMS, distinct=True)
    blank = graph.triples.filter("startswith(s, '_:')").select("s").unionAll(graph.triples.filter("kind = 'B'").select("o")).agg(F.countDistinct("s").alias("n_blank"))
    return restrictions.facet_ranges(graph).join(F.broadcast(blank))


@query("SELECT 'components' AS what, 2 * count(*) + count(*) FILTER (p_partkey % 4 = 0) AS n FROM part UNION ALL SELECT 'different', count(*) FROM part WHERE false UNION ALL SELECT 'kinds of difference without a list cell', 2")
def written_graph_is_isomorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ontology of blank nodes and lists against itself after a folder of Turtle, and after that without one list's end."""
    own = kept(Graph(tables.restriction_triples(spark, sf_dir), TERMS).triples)
    back = kept(_through_a_folder(own).triples)
    end = back.filter(F.col("p") == T.REST).filter(F.col("o") == T.NIL).agg(F.min("pos")).first()[0]
    first, second, lacking = (isomorphism.described(g) for g in (own, back, back.filter(F.col("pos") != end)))
    n = second.filter(F.col("what").startswith("component")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).select(F.lit("components").alias("what"), "n")
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n.unionAll(count(isomorphism.apart(first, second), "different")).unionAll(count(isomorphism.apart(first, lacking), "kinds of difference without a list cell"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'http://e/' || p_partkey WHEN p_partkey % 3 = 1 THEN '{base}K' || p_partkey ELSE '{base}' END AS iri FROM part")
def full_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("http://e/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("K"), k.cast("string"))).otherwise(F.lit(""))
    return tables.read(spark, sf_dir, "part").select(k.alias("k"), scalars.full_name(name, BASE).alias("iri"))


@query("SELECT (row_number() OVER (ORDER BY p) - 1)::INT AS place, o FROM (SELECT 0 AS p, '{base}Seg_' || c_mktsegment AS o FROM customer WHERE c_custkey = 7 UNION ALL SELECT 1, '{base}Put')")
def objects_of_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access path for one subject, in the source's order."""
    got = tables.graph(spark, sf_dir, items=False).objects(NET + "c7", T.TYPE)
    return got.select((F.row_number().over(Window.orderBy("pos")) - 1).alias("place"), "o")


@query("SELECT '{net}c' || c_custkey AS s FROM customer WHERE c_custkey % 7 = 0")
def subjects_of_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.graph(spark, sf_dir, items=False).subjects(T.TYPE, BASE + "Put").select("s")


@query("SELECT 'node' AS what, '{net}c' || c_custkey AS uri FROM customer UNION ALL SELECT 'node', '{net}s' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def objects_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of two classes by of_class, conduits included where they fall under one."""
    r = _reader(spark, sf_dir)
    empty = F.array().cast("array<string>")
    n = r.first_held(r.found("node")).join(r.type_sets(), "s", "left").select(F.col("s").alias("uri"), F.coalesce("types", empty).alias("types"), empty.alias("orientation_types"), "ord")
    c = r.first_held(r.found("conduit")).join(r.type_sets(), "s").select(F.col("s").alias("uri"), "types", "ord")
    n, c = kept(n), kept(c)
    both = hierarchy.of_class(n, c, r.h, "Put").unionAll(hierarchy.of_class(n, c, r.h, "Hulpstuk"))
    return both.select(F.when(F.col("what") == 0, "node").otherwise("conduit").alias("what"), "uri")


@query("SELECT 'K_' || p_partkey AS class, 'Dt_' || p_partkey AS target FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 3")
def restricted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(tables.restriction_triples(spark, sf_dir), TERMS)
    return restrictions.relations(g, "hasReference", "isAspectOf").select(short("class").alias("class"), short("target").alias("target"))


@query("""SELECT b, '_:b' || (row_number() OVER (ORDER BY k, o) - 1) AS new FROM (SELECT '_:' || t || p_partkey AS b, p_partkey AS k, o FROM part, (VALUES ('r', 0), ('e', 1), ('x', 2), ('lo', 3), ('y', 4), ('hi', 5), ('f', 6)) v(t, o) WHERE t <> 'f' OR p_partkey % 4 = 0)""")
def renumbered_bnodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank nodes by the order in which they are met."""
    old = kept(Graph(tables.restriction_triples(spark, sf_dir), TERMS).triples)
    new = sink.renumbered(old)
    ends = lambda df: df.filter("kind = 'B'").select("pos", "o").unionAll(df.filter("startswith(s, '_:')").select(F.col("pos") + (1 << 60), "s"))
    return ends(old).toDF("pos", "b").join(ends(new).toDF("pos", "new"), "pos").select("b", "new").distinct()


@query("WITH " + _SPOT + " SELECT '{net}c' || k || '_p' AS s, (x // 1000)::INT AS part FROM spot")
def points_among_many_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer of more polygons than a long has bits."""
    box = lambda x: [[(x - 500, -1), (x + 499, -1), (x + 499, 90000), (x - 500, 90000), (x - 500, -1)]]
    layer = [Polygon(f"b{i}", f"b{i}", [box(1000 * i)]) for i in range(97)]
    got = clip.placed(_geometries(spark, sf_dir, r"c\d+_p$"), layer)
    return got.select("s", F.explode(clip.Sets(97).members(F.col("mask"))).alias("part"))


@query("""SELECT '{net}c' || k || '_p' AS s, ((k % 97) * 100 + k % 89)::INT AS part FROM (SELECT c_custkey AS k FROM customer) WHERE k % 50 <> 0 AND k % 53 <> 1 UNION ALL SELECT '{net}c' || c_custkey || '_mp', 0 FROM customer WHERE c_custkey % 3 = 2""")
def points_in_a_layer_of_ten_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of the network in a layer of 100 by 100 boxes, by a join with its grid."""
    box = lambda x, y: [[(x - 500, y - 500), (x + 499, y - 500), (x + 499, y + 499), (x - 500, y + 499), (x - 500, y - 500)]]
    layer = [Polygon(f"b{i}", f"b{i}", [box(1000 * (i // 100), 1000 * (i % 100))]) for i in range(10_000)]
    spots = _geometries(spark, sf_dir, ".").withColumn("g", gml.parsed(F.col("literal"))).filter("g.geom.kind = 'Point'").select("s", F.get("g.geom.xs", F.lit(0)).alias("x"), F.get("g.geom.ys", F.lit(0)).alias("y"))
    return Grid(spark, layer).home(spots, "x", "y").select("s", F.col("home").alias("part"))


@query("""WITH """ + _DRAWN + """ SELECT '{net}o' || k || '_l' AS s, '<gml:LineString srsDimension="2"><gml:posList>' || x0 || ' ' || y0 || ' ' || x1 || ' ' || y1 || '</gml:posList></gml:LineString>' AS literal FROM drawn""")
def lines_cut_and_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line to the letter after cutting and merging."""
    rows = tables.order_triples(spark, sf_dir, *tables.sizes(spark, sf_dir))
    back = clip.merge(clip.clip(Graph.by_subject(rows, TERMS), strips()), TERMS)
    return back.filter((F.col("p") == TERMS.has_value) & (F.col("dt") == T.GML_LITERAL)).select("s", F.col("o").alias("literal"))


@query(r"""SELECT '{net}p ' || p_partkey || '>{|' || chr(92) || '`^' || chr(34) || '<é' AS s, 'say ' || chr(34) || p_partkey || chr(34) || chr(10) || chr(9) || chr(92) || 'n' AS o, CASE WHEN p_partkey % 2 = 0 THEN 'nl' END AS lang, CASE WHEN p_partkey % 2 = 1 THEN 'http://e/a b' END AS dt FROM part""")
def odd_terms_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and literals with every character that Turtle must escape, through a folder of Turtle files."""
    k = F.col("p_partkey").cast("string")
    odd = F.col("p_partkey") % 2 == 1
    rows = tables.read(spark, sf_dir, "part").select(
        F.concat(F.lit(NET + "p "), k, F.lit('>{|\\`^"<é')).alias("s"), F.lit("http://e/p").alias("p"), F.concat(F.lit('say "'), k, F.lit('"\n\t\\n')).alias("o"), F.lit("L").alias("kind"),
        F.when(~odd, F.lit("nl")).alias("lang"), F.when(odd, F.lit("http://e/a b")).alias("dt"), F.col("p_partkey").cast("long").alias("pos"),
    )
    folder = f"{shared_folder(spark)}/sluice-turtle-{uuid.uuid4().hex}"
    sink.write_folder(rows, folder)
    return turtle.read(spark, folder).select("s", "o", "lang", "dt")


@query("SELECT 'nodes' AS what, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'conduits', count(*) FROM orders UNION ALL SELECT 'geometry_errors', count(*) FROM customer WHERE c_custkey % 53 = 1 AND c_custkey % 50 <> 0")
def dataset_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset as a whole, with class knowledge from its own triples."""
    ds = domain.Dataset.load(tables.graph(spark, sf_dir, items=False))
    size = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return size("nodes", ds.nodes).unionAll(size("conduits", ds.conduits)).unionAll(size("geometry_errors", ds.geometry_errors))
