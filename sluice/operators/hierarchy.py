"""Class reasoning over rdfs:subClassOf, and selection by class."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice import terms as T
from sluice.functions.scalars import short_name
from sluice.operators.fixpoint import kept, until_stable
from sluice.operators.graph import Graph
from sluice.terms import Terms


#: Edges up to which a closure is made on the driver: vocabularies have a few thousand.
SMALL = 20_000
#: Classes up to which a filter names them.
NAMED = 100


def _closed(edges: list[tuple[str, str]]) -> set[tuple[str, str]]:
    below: dict[str, list[str]] = {}
    for root, sub in edges:
        below.setdefault(root, []).append(sub)
    out = set()
    for root in below:
        seen, going = {root}, [root]
        while going:
            for sub in below.get(going.pop(), ()):
                if sub not in seen:
                    seen.add(sub)
                    going.append(sub)
        out |= {(root, c) for c in seen}
    return out


def subclass_closure(graph: Graph) -> DataFrame:
    """(root, class): each class that has subclasses, with itself and all its descendants. Cycles are followed once.

    Hierarchies of a vocabulary's size, which is checked, are closed on the driver; larger ones by a loop.
    """
    edges = graph.of(T.SUBCLASS).filter("kind = 'I' and not startswith(s, '_:')").select(F.col("o").alias("root"), F.col("s").alias("class")).distinct()
    few = edges.limit(SMALL + 1).collect()
    if len(few) <= SMALL:
        pairs = _closed([tuple(r) for r in few])
        if len(pairs) <= 10 * SMALL:
            return edges.sparkSession.createDataFrame(sorted(pairs), "root string, class string")
    edges = kept(edges)
    below = until_stable(edges, lambda new: new.join(edges.select(F.col("root").alias("class"), F.col("class").alias("sub")), "class").select("root", F.col("sub").alias("class")))
    return kept(below.unionAll(edges.select("root", F.col("root").alias("class"))).distinct())


class Hierarchy:
    """A closure, with the terms of its base."""

    def __init__(self, closure: DataFrame, terms: Terms):
        self.closure, self.terms = closure, terms

    @cached_property
    def few(self) -> bool:
        return self.closure.limit(10 * SMALL + 1).count() <= 10 * SMALL

    def hint(self, classes: DataFrame) -> DataFrame:
        """Some of the closure's rows as the small side of a join, if it is known to be small."""
        return F.broadcast(classes) if self.few else classes

    @classmethod
    def of(cls, graph: Graph) -> Hierarchy:
        return cls(subclass_closure(graph), graph.terms)

    def below(self, root: str) -> DataFrame:
        """(class): root and its descendants; root alone if it has none."""
        iri = self.terms.iri(root)
        spark = self.closure.sparkSession
        return self.closure.filter(F.col("root") == iri).select("class").unionAll(spark.range(1).select(F.lit(iri).alias("class"))).distinct()

    def names_below(self, root: str) -> tuple[str, ...]:
        """The classes of `below`, if they are few enough to be named in a filter; else none."""
        names = [r["class"] for r in self.below(root).limit(NAMED + 1).collect()]
        return tuple(sorted(names)) if len(names) <= NAMED else ()

    def below_all(self, roots: list[str]) -> DataFrame:
        """(root, class, rank) for several roots; rank is the root's place in the list."""
        iris = [self.terms.iri(r) for r in roots]
        spark = self.closure.sparkSession
        asked = spark.createDataFrame([(r, i) for i, r in enumerate(iris)], "root string, rank int")
        return asked.join(self.closure, "root").select("root", "class", "rank").unionAll(asked.select("root", F.col("root").alias("class"), "rank")).distinct()

    def usable(self, root: str) -> bool:
        """Whether more than the root itself is known."""
        return self.below(root).limit(2).count() > 1

    def known(self) -> bool:
        """Whether both recognition classes have known subclasses."""
        return self.usable(T.NODE_ROLE) and self.usable(T.EDGE_ROLE)

    def is_connection_class(self, root: str) -> bool:
        return not self.below(T.EDGE_ROLE).filter(F.col("class") == self.terms.iri(root)).isEmpty()

    def strictly_below(self) -> DataFrame:
        """(ancestor, class), an ancestor not being the class itself."""
        return self.closure.filter("root <> class").select(F.col("root").alias("ancestor"), "class")

    def most_specific(self, typed: DataFrame, key: str = "s") -> DataFrame:
        """typed (key, type) without the types that have another type of the same key among their descendants; all of them, if none were left."""
        typed = typed.select(key, "type").distinct()
        pairs = typed.select(key, F.col("type").alias("ancestor")).join(self.strictly_below(), "ancestor")
        general = pairs.join(typed.withColumnRenamed("type", "class"), [key, "class"], "left_semi").select(key, F.col("ancestor").alias("type")).distinct()
        rest = typed.join(general, [key, "type"], "left_anti")
        return rest.unionAll(typed.join(rest.select(key).distinct(), key, "left_anti"))


def types_of(nodes: DataFrame, conduits: DataFrame) -> DataFrame:
    """(uri, types): of a node its own and its orientation's, else a conduit's; a node wins."""
    n = nodes.select("uri", F.array_sort(F.array_union("types", "orientation_types")).alias("types"))
    return n.unionAll(conduits.select("uri", F.array_sort("types").alias("types")).join(n.select("uri"), "uri", "left_anti"))


def graph_types_of(graph: Graph, nodes: DataFrame, conduits: DataFrame) -> DataFrame:
    """(uri, types) with the graph's own types of every subject added."""
    own = graph.types().select(F.col("s").alias("uri"), "type")
    both = own.unionAll(types_of(nodes, conduits).select("uri", F.explode("types").alias("type")))
    return both.groupBy("uri").agg(F.array_sort(F.collect_set("type")).alias("types"))


def is_a(typed: DataFrame, hierarchy: Hierarchy, root: str) -> DataFrame:
    """The uris of typed (uri, types) that are of a class or one below it."""
    return typed.select("uri", F.explode("types").alias("class")).join(hierarchy.hint(hierarchy.below(root)), "class", "left_semi").select("uri").distinct()


def of_class(nodes: DataFrame, conduits: DataFrame, hierarchy: Hierarchy, root: str) -> DataFrame:
    """(uri, what, ord): nodes, then conduits, of a class. Connection classes are no selection here."""
    if hierarchy.is_connection_class(root):
        raise ValueError(f"{root} is a class of connections; ask for conduits")
    n = nodes.select("uri", F.lit(0).alias("what"), "ord", F.array_union("types", "orientation_types").alias("types"))
    both = n.unionAll(conduits.select("uri", F.lit(1), "ord", "types"))
    hit = both.select("uri", "what", "ord", F.explode("types").alias("class")).join(hierarchy.hint(hierarchy.below(root)), "class", "left_semi")
    return hit.select("uri", "what", "ord").distinct()


def subjects_of_class(graph: Graph, hierarchy: Hierarchy, root: str) -> DataFrame:
    """(s): one row for every matching pair of subject and class."""
    return graph.types().withColumnRenamed("type", "class").join(hierarchy.hint(hierarchy.below(root)), "class").select("s", "class")


def first_root(objects: DataFrame, hierarchy: Hierarchy, roots: list[str]) -> DataFrame:
    """objects (uri, types, ord): (uri, root, rank, ord), each once, under the first of the roots that it falls under."""
    hits = objects.select("uri", "ord", F.explode("types").alias("class")).join(hierarchy.hint(hierarchy.below_all(roots)), "class")
    w = Window.partitionBy("uri").orderBy("rank", "ord")
    return hits.withColumn("k", F.row_number().over(w)).filter("k = 1").select("uri", "root", "rank", "ord")


def object_type(typed: DataFrame, orientation: DataFrame, hierarchy: Hierarchy) -> DataFrame:
    """(uri, object_type): the alphabetically first short name of the most specific own types, else of the orientation's, else ''."""
    own = typed.select("uri", "type").distinct()
    rest = orientation.select("uri", "type").join(own.select("uri").distinct(), "uri", "left_anti")
    best = hierarchy.most_specific(own.unionAll(rest), "uri")
    return best.groupBy("uri").agg(F.min(short_name(F.col("type"))).alias("object_type"))


def falls_under(typed: DataFrame, hierarchy: Hierarchy, roots: list[str]) -> DataFrame:
    """(uri, falls_under): as object_type, of the types below the roots only."""
    inside = typed.select("uri", "type").join(hierarchy.hint(hierarchy.below_all(roots).select(F.col("class").alias("type")).distinct()), "type", "left_semi")
    return hierarchy.most_specific(inside, "uri").groupBy("uri").agg(F.min(short_name(F.col("type"))).alias("falls_under"))


def short_types(types: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(types, short_name)))


def version_of_types(nodes: DataFrame, conduits: DataFrame) -> str | None:
    """The version in the first type IRI that has one, nodes before conduits."""
    from sluice.functions.scalars import base_of
    from sluice.terms import Base

    both = nodes.select(F.lit(0).alias("w"), "ord", F.explode("types").alias("t")).unionAll(conduits.select(F.lit(1), "ord", F.explode("types")))
    first = both.filter(base_of(F.col("t")).isNotNull()).orderBy("w", "ord", "t").select(base_of(F.col("t")).alias("b")).first()
    return Base.read(first["b"]).version if first else None
