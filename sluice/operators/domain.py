"""Nodes and conduits of a network, read from its triples.

A node is an object with an orientation whose class lies below the node role, a conduit one whose
orientation's class lies below the edge role. Without class knowledge a node has an orientation with
a point, a conduit one with a begin or end point. Whatever is written more than once, the first in
the source's order counts; `ord` columns are structs that compare in that order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import terms as T
from sluice.errors import ContentError
from sluice.functions import gml
from sluice.functions.scalars import number, short_name
from sluice.operators import hierarchy as hierarchies
from sluice.operators import network as networks
from sluice.operators import restrictions as ontologies
from sluice.operators.fixpoint import kept
from sluice.operators.graph import Graph, text_of
from sluice.operators.hierarchy import Hierarchy

ASPECT = "struct<kind:string,value:string,reference:string,provenance:struct<method:string,date:date>>"


class Reader:
    """The views from which nodes and conduits are made; each is a lazy DataFrame over the graph's property table."""

    def __init__(self, graph: Graph, hierarchy: Hierarchy | None = None):
        self.g, self.t = graph, graph.terms
        self.h = hierarchy
        self.p = graph.properties
        self._names: dict[str, tuple[str, ...]] = {}

    @cached_property
    def types(self) -> DataFrame:
        """(s, type, pos)."""
        return self.p.types

    def types_around(self, role: str) -> DataFrame:
        """types, of orientations of classes below the role and of their holders at least."""
        return self.p.types_near(self.around(role))

    @cached_property
    def parts(self) -> DataFrame:
        return self.p.edges("parts")

    def _below(self, role: str) -> DataFrame:
        return self.h.hint(self.h.below(role)) if self.h else F.broadcast(self.g.triples.sparkSession.createDataFrame([(self.t.iri(role),)], "class string"))

    def _named(self, role: str) -> tuple[str, ...]:
        """The classes of _below, if they are few."""
        if role not in self._names:
            self._names[role] = self.h.names_below(role) if self.h else (self.t.iri(role),)
        return self._names[role]

    def provenance(self) -> DataFrame:
        return self.p.provenance

    def _first(self, name: str) -> Column:
        """Of a holder's aspects the first of a class that has a value, as an aggregate: value and provenance."""
        return F.min_by(F.struct("value", "provenance"), F.when(self.p.is_a(name) & F.col("value").isNotNull(), F.col("ord")))

    def of_class(self, name: str) -> DataFrame:
        """(s, aspect): the first aspect of a class that has a value, with its provenance."""
        return self._levels(name).select("s", "aspect")

    def _valued(self, *names: str) -> DataFrame:
        """(holder, member, ord, types, value) of aspects of some of the classes, whose values are read one by one."""
        return self.p.members_of("held", names, "value")

    def _levels(self, name: str) -> DataFrame:
        """of_class, and point_provenance: that of the first point with a value beside it."""
        first = self.p.sourced(self._valued(name, T.POINT)).groupBy(F.col("holder").alias("s")).agg(self._first(name).alias("f"), self._first(T.POINT).alias("point")).filter("f is not null")
        aspect = F.struct(F.lit(short_of(name)).alias("kind"), F.col("f.value").alias("value"), F.lit(None).cast("string").alias("reference"), F.col("f.provenance").alias("provenance"))
        return first.select("s", aspect.alias("aspect"), F.col("point.provenance").alias("point_provenance"))

    def attributes(self) -> DataFrame:
        """(s, aspects): every aspect with a value or a reference, once for each of its classes."""
        a = self.p.held.filter("(value is not null or reference is not null) and size(types) > 0").withColumn("reference", short_name(F.col("reference")))
        each = F.transform("types", lambda t: F.struct(short_name(t["type"]).alias("kind"), F.col("value"), F.col("reference"), F.col("provenance")))
        rows = a.select(F.col("holder").alias("s"), F.struct("ord", each.alias("all")).alias("x"))
        return rows.groupBy("s").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["all"])).alias("aspects"))

    def geometry(self, name: str) -> DataFrame:
        """(o, geom, zs, error, multipart) of orientations o: the first aspect of the class that has a literal counts, readable or not."""
        lit = self._valued(name).filter("value is not null")
        first = lit.groupBy(F.col("holder").alias("o")).agg(F.min_by("value", "ord").alias("literal"), ((F.count("*") > 1) | F.max(gml.is_multipart(F.col("value")))).alias("multipart"))
        first = first.withColumn("g", gml.parsed(F.col("literal")))
        return first.select("o", F.col("g.geom").alias("geom"), F.col("g.zs").alias("zs"), F.col("g.error").alias("error"), "multipart")

    def ground(self) -> DataFrame:
        """(o, aspect, provenance): of the first ground orientation connected with o that has a level; its own provenance, else that of the point beside it."""
        ground = self.p.of_types(T.GROUND_ROLE)
        level = self._levels(T.GROUND_LEVEL).join(ground, "s", "left_semi")
        # links hold both ways, so from the ground's side the other end's way of writing is the opposite one
        near = level.join(self.p.links.select(F.col("a").alias("s"), F.col("b").alias("o"), F.struct((1 - F.col("ord.way")).alias("way"), "ord.pos").alias("ord")), "s")
        first = near.groupBy("o").agg(F.min_by(F.struct("aspect", "point_provenance"), "ord").alias("f"))
        return first.select("o", "f.aspect", F.coalesce("f.aspect.provenance", "f.point_provenance").alias("provenance"))

    def cover(self) -> DataFrame:
        """(s, aspect, provenance): the level on the object, else on a cover part's orientation, else on the part."""
        level = self._levels(T.COVER_LEVEL)
        found = ("aspect", "point_provenance")
        place = lambda r, a, q, b: F.struct(F.lit(r).alias("r"), a.alias("a"), F.lit(q).alias("q"), b.alias("b")).alias("ord")
        none = F.lit(None).cast("struct<way:int,pos:bigint>")
        direct = level.select("s", place(0, none, 0, none), *found)
        lids = self.p.members_under("parts", self._below(T.COVER), self._named(T.COVER)).select(F.col("holder").alias("s"), F.col("member").alias("lid"), F.col("ord").alias("a"))
        over = lids.join(self.p.edges("held", "holder").select(F.col("holder").alias("lid"), F.col("member").alias("beside"), F.col("ord").alias("b")), "lid").join(level.withColumnRenamed("s", "beside"), "beside")
        on = lids.join(level.withColumnRenamed("s", "lid"), "lid")
        every = direct.unionAll(over.select("s", place(1, F.col("a"), 0, F.col("b")), *found)).unionAll(on.select("s", place(1, F.col("a"), 1, none), *found))
        first = every.groupBy("s").agg(F.min_by(F.struct(*found), "ord").alias("f"))
        return first.select("s", "f.aspect", F.coalesce("f.aspect.provenance", "f.point_provenance").alias("provenance"))

    def labels(self) -> DataFrame:
        return self.p.described("label").filter("label is not null").select("s", "label")

    def around(self, role: str, structural: bool | None = None) -> tuple[str, ...]:
        """The classes near which found objects and orientations are, if that is known."""
        return () if self._structural(role, structural) else self._named(role)

    def type_sets(self, near: tuple[str, ...] = ()) -> DataFrame:
        names = F.array_sort(F.array_distinct(F.transform("types", lambda t: t["type"])))
        return self.p.described(near=near).filter("size(types) > 0").select("s", names.alias("types"))

    def _described(self, near: tuple[str, ...] = ()) -> DataFrame:
        """(s, label, types) of every subject, or of those near some classes at least: labels and type_sets at once."""
        return self.p.described("label", near=near).select("s", "label", F.array_sort(F.array_distinct(F.transform("types", lambda t: t["type"]))).alias("types"))

    def parents(self) -> DataFrame:
        own = self.parts.filter("not startswith(holder, '_:') and holder <> member")
        return own.groupBy(F.col("member").alias("s")).agg(F.array_sort(F.collect_set("holder")).alias("parents"))

    def orientations(self, role: str) -> DataFrame:
        """(o, at): orientations of classes below the role, by class name and then by place."""
        return self.p.under(self._below(role), self._named(role)).withColumnRenamed("s", "o")

    def structural_nodes(self) -> DataFrame:
        points = F.get(F.filter("types", lambda t: t["type"] == self.t.iri(T.POINT)), F.lit(0))["pos"]
        found = self.p.members_of("held", (T.POINT,))
        return found.groupBy(F.col("holder").alias("o")).agg(F.min(F.struct(points.alias("pos"), "ord")).alias("at"))

    def structural_conduits(self) -> DataFrame:
        names = [self.t.iri(n) for n in (*T.BEGIN_POINTS, *T.END_POINTS)]
        rank = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col("t.type"))
        ends = self.p.members_of("parts", (*T.BEGIN_POINTS, *T.END_POINTS)).select(F.col("holder").alias("o"), "ord", F.explode("types").alias("t")).filter(F.col("t.type").isin(names))
        return ends.groupBy("o").agg(F.min(F.struct(rank.alias("r"), "t.pos", "ord")).alias("at"))

    def _structural(self, role: str, structural: bool | None) -> bool:
        return structural if structural is not None else self.h is None or not self.h.usable(role)

    def found(self, which: str, structural: bool | None = None) -> DataFrame:
        """(s, o, at): every holder of every orientation, in reading order. which: 'node' or 'conduit'."""
        role = T.NODE_ROLE if which == "node" else T.EDGE_ROLE
        if self._structural(role, structural):
            o = self.structural_nodes() if which == "node" else self.structural_conduits()
            held = o.join(self.p.edges("held", "member").select(F.col("holder").alias("s"), F.col("member").alias("o"), "ord"), "o")
        else:
            held = self.p.members_under("held", self._below(role), self._named(role)).withColumnsRenamed({"holder": "s", "member": "o"})
        return held.select("s", "o", F.struct("at", "ord").alias("at"))

    def first_held(self, found: DataFrame) -> DataFrame:
        """(s, o, ord): the first orientation of each object; ord numbers the objects in reading order."""
        first = found.groupBy("s").agg(F.min_by("o", "at").alias("o"), F.min("at").alias("ord"))
        return first

    def errors(self, which: str, structural: bool | None = None) -> DataFrame:
        """(uri, error): unreadable geometry, the last of an object's orientations winning; orientations nobody holds go by their own name."""
        name, role = (T.POINT, T.NODE_ROLE) if which == "node" else (T.LINE, T.EDGE_ROLE)
        bad = self.geometry(name).filter("error is not null").select("o", "error")
        held = self.found(which, structural).join(bad, "o").groupBy("s").agg(F.max_by("error", "at").alias("error"))
        if self._structural(role, structural):
            all_o = (self.structural_nodes() if which == "node" else self.structural_conduits()).select("o")
        else:
            all_o = self.orientations(role).select("o")
        loose = bad.join(all_o, "o", "left_semi").join(self.p.edges("held", "member").select(F.col("member").alias("o")), "o", "left_anti").select(F.col("o").alias("s"), "error")
        return held.unionAll(loose).select(text_of(F.col("s")).alias("uri"), "error")

    def nodes(self, structural: bool | None = None) -> DataFrame:
        empty, near = F.array().cast("array<string>"), self.around(T.NODE_ROLE, structural)
        # What is known of orientations first, then what is known of the objects: two moves of the found pairs, none of the tables.
        n = self.first_held(self.found("node", structural)).join(self.geometry(T.POINT), "o", "left").join(self.type_sets(near).toDF("o", "orientation_types"), "o", "left").join(self.ground().toDF("o", "ground_aspect", "ground_provenance"), "o", "left")
        n = n.join(self._described(near), "s", "left").join(self.attributes(), "s", "left").join(self.parents(), "s", "left").join(self.cover().toDF("s", "cover_aspect", "cover_provenance"), "s", "left")
        return n.select(
            text_of(F.col("s")).alias("uri"),
            F.coalesce("label", F.lit("")).alias("label"),
            F.coalesce("types", empty).alias("types"),
            text_of(F.col("o")).alias("orientation"),
            F.coalesce("orientation_types", empty).alias("orientation_types"),
            F.col("geom").alias("point"),
            F.get("zs", F.lit(0)).alias("z"),
            F.coalesce("parents", empty).alias("parents"),
            F.coalesce("aspects", F.array().cast(f"array<{ASPECT}>")).alias("aspects"),
            "ground_aspect",
            "ground_provenance",
            "cover_aspect",
            "cover_provenance",
            F.coalesce("multipart", F.lit(False)).alias("multipart"),
            F.array().cast("array<struct<kind:string,value:double>>").alias("fillers"),
            "ord",
        )

    def endpoints(self) -> DataFrame:
        """(o, begin, end): the first part of each kind."""
        first = lambda names: F.min_by("member", F.when(self.p.is_a(*names), F.col("ord")))
        ends = self.p.members_of("parts", (*T.BEGIN_POINTS, *T.END_POINTS))
        return ends.groupBy(F.col("holder").alias("o")).agg(first(T.BEGIN_POINTS).alias("begin"), first(T.END_POINTS).alias("end"))

    def bindings(self, nodes: DataFrame) -> DataFrame:
        """(point, node, repaired): the node that an end point connects with.

        The first connected orientation of a node decides; only if there is none, a name that ends
        in a known tail and is a fitting without it stands for that fitting.
        """
        by_o = nodes.groupBy(F.col("orientation").alias("target")).agg(F.max_by("uri", "ord").alias("node"))
        fittings = nodes.select("uri", F.explode("orientation_types").alias("class")).join(self._below(T.FITTING_ROLE), "class", "left_semi").select(F.col("uri").alias("stem"), F.col("uri").alias("fitting")).distinct()
        ends = self.p.of_types(*T.BEGIN_POINTS, *T.END_POINTS).select(F.col("s").alias("a"))
        to = self.p.links.join(ends, "a", "left_semi").select(F.col("a").alias("point"), text_of(F.col("b")).alias("target"), "ord")
        to = to.withColumn("stem", F.when(F.col("target").endswith(T.PHANTOM_TAIL), F.expr(f"substring(target, 1, length(target) - {len(T.PHANTOM_TAIL)})")))
        to = to.join(by_o, "target", "left").join(fittings, "stem", "left")
        got = to.groupBy("point").agg(F.min_by("node", F.when(F.col("node").isNotNull(), F.col("ord"))).alias("node"), F.min_by("fitting", F.when(F.col("fitting").isNotNull(), F.col("ord"))).alias("fitting"))
        return got.select("point", F.coalesce("node", "fitting").alias("node"), (F.col("node").isNull() & F.col("fitting").isNotNull()).alias("repaired")).filter("node is not null")

    def conduits(self, nodes: DataFrame, structural: bool | None = None) -> DataFrame:
        c = self.first_held(self.found("conduit", structural)).join(self.endpoints(), "o", "left").join(self.geometry(T.LINE), "o", "left")
        bind = self.bindings(nodes)
        for point, out, name in (("begin", "start", T.BEGIN_INVERT), ("end", "end", T.END_INVERT)):
            c = c.join(bind.toDF(point, f"{out}_node", f"{out}_repaired"), point, "left").join(self.of_class(name).toDF(point, f"bob_{out}_aspect"), point, "left")
        c = c.join(self._described(self.around(T.EDGE_ROLE, structural)), "s", "left").join(self.attributes(), "s", "left")
        return c.select(
            text_of(F.col("s")).alias("uri"),
            F.coalesce("label", F.lit("")).alias("label"),
            F.coalesce("types", F.array().cast("array<string>")).alias("types"),
            F.col("geom").alias("line"),
            "start_node",
            "end_node",
            "bob_start_aspect",
            "bob_end_aspect",
            F.coalesce("aspects", F.array().cast(f"array<{ASPECT}>")).alias("aspects"),
            F.coalesce("multipart", F.lit(False)).alias("multipart"),
            F.coalesce("zs", F.array().cast("array<double>")).alias("z_values"),
            F.array().cast("array<struct<kind:string,value:double>>").alias("fillers"),
            F.coalesce("start_repaired", F.lit(False)).alias("start_repaired"),
            F.coalesce("end_repaired", F.lit(False)).alias("end_repaired"),
            "ord",
        )

    def structural_differences(self) -> DataFrame:
        """(what, n): holders that only one of the two recognitions finds; only counts that aren't 0."""
        parts = []
        for which, word in (("node", "nodes"), ("conduit", "conduits")):
            by_role = self.found(which, False).select("s").distinct()
            by_form = self.found(which, True).select("s").distinct()
            parts.append(by_role.join(by_form, "s", "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{word}_without_geometry").alias("what"), "n"))
            parts.append(by_form.join(by_role, "s", "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{word}_without_role").alias("what"), "n"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out.filter("n > 0")


def short_of(name: str) -> str:
    return T.local_name(name)


def repairs(conduits: DataFrame) -> DataFrame:
    """(n_couplings, n_fittings) of repaired bindings."""
    both = conduits.filter("start_repaired").select(F.col("start_node").alias("f")).unionAll(conduits.filter("end_repaired").select("end_node"))
    return both.agg(F.count("*").alias("n_couplings"), F.countDistinct("f").alias("n_fittings"))


def mark_fillers(objects: DataFrame, kinds: list[str], band: float = 0.0) -> DataFrame:
    """Objects whose values of these kinds within the band of 0 are gone and remembered in `fillers`; no kinds: the same objects."""
    if not kinds:
        return objects
    chosen = F.array(*[F.lit(k) for k in kinds])
    filler = lambda a: F.coalesce(F.array_contains(chosen, a["kind"]) & (F.abs(number(a["value"])) <= band), F.lit(False))
    note = lambda a: F.struct(a["kind"].alias("kind"), number(a["value"]).alias("value"))
    single = [c for c in ("ground_aspect", "cover_aspect", "bob_start_aspect", "bob_end_aspect") if c in objects.columns]
    notes = F.concat("fillers", *[F.when(F.col(c).isNotNull() & filler(F.col(c)), F.array(note(F.col(c)))).otherwise(F.array().cast("array<struct<kind:string,value:double>>")) for c in single], F.transform(F.filter("aspects", filler), note))
    out = {"fillers": notes, "aspects": F.filter("aspects", lambda a: ~filler(a))} | {c: F.when(~filler(F.col(c)), F.col(c)) for c in single}
    return objects.withColumns(out)


def attribute_values(graph: Graph, kind: str) -> DataFrame:
    """(s, value) of every attribute node of a class that has one."""
    return graph.of_types(kind).join(graph.value(graph.terms.has_value).toDF("s", "value"), "s")


def attribute_instances(graph: Graph, kind: str) -> DataFrame:
    """(s, value, reference) of every attribute node of a class."""
    t = graph.terms
    return graph.of_types(kind).join(graph.value(t.has_value).toDF("s", "value"), "s", "left").join(graph.value(t.has_reference).toDF("s", "reference"), "s", "left")


def parts_of(graph: Graph, hierarchy: Hierarchy | None = None, root: str | None = None) -> DataFrame:
    """(holder, part, ord); with a root only named parts of a class below it."""
    p = graph.parts().withColumnRenamed("member", "part")
    if root is None:
        return p
    inside = graph.types().withColumnRenamed("type", "class").join(hierarchy.hint(hierarchy.below(root)), "class", "left_semi").select(F.col("s").alias("part")).distinct()
    return p.filter("not startswith(part, '_:')").join(inside, "part", "left_semi").select("holder", "part", "ord")


def system_members(graph: Graph, nodes: DataFrame, conduits: DataFrame) -> DataFrame:
    """(holder, conduits, nodes): sorted members of each holder; what is both counts as a conduit."""
    p = graph.parts().select("holder", text_of(F.col("member")).alias("uri"))
    kinds = conduits.select("uri", F.lit("c").alias("what")).unionAll(nodes.select("uri", F.lit("n").alias("what")).join(conduits.select("uri"), "uri", "left_anti"))
    got = p.join(kinds, "uri")
    pick = lambda w: F.array_sort(F.collect_set(F.when(F.col("what") == w, F.col("uri"))))
    return got.groupBy("holder").agg(pick("c").alias("conduits"), pick("n").alias("nodes"))


@dataclass
class Dataset:
    """A graph with its nodes, conduits and geometry errors."""

    graph: Graph
    hierarchy: Hierarchy
    nodes: DataFrame
    conduits: DataFrame
    geometry_errors: DataFrame

    ontology: Graph | None = None

    @classmethod
    def load(cls, graph: Graph, ontology: Graph | None = None) -> Dataset:
        """Class knowledge comes from the ontology where there is one, else from the graph. Written once; an empty network is an error."""
        graph = graph.stored()
        graph.properties = graph.properties.stored()
        if ontology is not None and ontology.triples.isEmpty():
            ontology = None
        hierarchy = Hierarchy.of(ontology or graph)
        reader = Reader(graph, hierarchy)
        nodes = kept(reader.nodes())
        conduits = kept(reader.conduits(nodes))
        if nodes.isEmpty() and conduits.isEmpty():
            raise ContentError("the dataset has neither nodes nor conduits")
        return cls(graph, hierarchy, nodes, conduits, reader.errors("node").unionAll(reader.errors("conduit")), ontology)

    def subset(self, uris: DataFrame) -> Dataset:
        """The objects of uris (uri); the graph stays whole."""
        some = lambda df: df.join(uris.select("uri").distinct(), "uri", "left_semi")
        return Dataset(self.graph, self.hierarchy, some(self.nodes), some(self.conduits), some(self.geometry_errors), self.ontology)

    def with_fillers(self, kinds: list[str], band: float = 0.0) -> Dataset:
        if not kinds:
            return self
        return Dataset(self.graph, self.hierarchy, mark_fillers(self.nodes, kinds, band), mark_fillers(self.conduits, kinds, band), self.geometry_errors, self.ontology)

    def register(self, prefix: str = "") -> None:
        """Temporary views for SQL: triples, nodes, conduits, geometry_errors and subclass_closure, their names after a prefix."""
        for name, df in (("triples", self.graph.triples), ("nodes", self.nodes), ("conduits", self.conduits), ("geometry_errors", self.geometry_errors), ("subclass_closure", self.hierarchy.closure)):
            df.createOrReplaceTempView(prefix + name)

    # Questions, all set-wise: each gives a DataFrame, and a filter on it is the question about one object.

    @property
    def terms(self) -> T.Terms:
        return self.graph.terms

    def version(self) -> str | None:
        return hierarchies.version_of_types(self.nodes, self.conduits)

    def closure(self, root: str) -> DataFrame:
        return self.hierarchy.below(root)

    def types(self) -> DataFrame:
        """(uri, types) of nodes and conduits."""
        return hierarchies.types_of(self.nodes, self.conduits)

    def graph_types(self) -> DataFrame:
        return hierarchies.graph_types_of(self.graph, self.nodes, self.conduits)

    def is_a(self, root: str) -> DataFrame:
        """The uris of nodes and conduits of a class."""
        return hierarchies.is_a(self.types(), self.hierarchy, root)

    def graph_is_a(self, root: str) -> DataFrame:
        """The subjects of a class, whatever they are."""
        return hierarchies.subjects_of_class(self.graph, self.hierarchy, root).select("s").distinct()

    def of_class(self, root: str) -> DataFrame:
        return hierarchies.of_class(self.nodes, self.conduits, self.hierarchy, root)

    def subjects_of_class(self, root: str) -> DataFrame:
        return hierarchies.subjects_of_class(self.graph, self.hierarchy, root)

    def nodes_of(self, *roots: str) -> DataFrame:
        typed = self.nodes.select("uri", F.array_union("types", "orientation_types").alias("types"), "ord")
        return hierarchies.first_root(typed, self.hierarchy, list(roots))

    def conduits_of(self, *roots: str) -> DataFrame:
        return hierarchies.first_root(self.conduits.select("uri", "types", "ord"), self.hierarchy, list(roots))

    def object_types(self) -> DataFrame:
        own = self.nodes.select("uri", F.explode("types").alias("type")).unionAll(self.conduits.select("uri", F.explode("types")))
        return hierarchies.object_type(own, self.nodes.select("uri", F.explode("orientation_types").alias("type")), self.hierarchy)

    def falls_under(self, *roots: str) -> DataFrame:
        return hierarchies.falls_under(self.types().select("uri", F.explode("types").alias("type")), self.hierarchy, list(roots))

    def neighbours(self) -> DataFrame:
        return self.graph.neighbours()

    def parts(self, root: str | None = None) -> DataFrame:
        return parts_of(self.graph, self.hierarchy, root)

    def members(self) -> DataFrame:
        return system_members(self.graph, self.nodes, self.conduits)

    def attribute_values(self, kind: str) -> DataFrame:
        return attribute_values(self.graph, kind)

    def attribute_instances(self, kind: str) -> DataFrame:
        return attribute_instances(self.graph, kind)

    def attributes_of_subjects(self) -> DataFrame:
        """(s, aspects) of every subject, parts without geometry included."""
        return Reader(self.graph, self.hierarchy).attributes()

    def labels(self) -> DataFrame:
        return Reader(self.graph, self.hierarchy).labels()

    def climb(self, starts: DataFrame, *roots: str) -> DataFrame:
        return networks.climb(starts, self.nodes, self.hierarchy, list(roots))

    def conduit_nodes(self, *roots: str) -> DataFrame:
        return networks.conduit_nodes(self.conduits, self.nodes, self.hierarchy, list(roots))

    def drawing_direction(self, *roots: str) -> DataFrame:
        return networks.drawing_direction(self.conduits, self.nodes, self.hierarchy, list(roots))

    def structural_differences(self) -> DataFrame:
        return Reader(self.graph, self.hierarchy).structural_differences()

    def repairs(self) -> DataFrame:
        return repairs(self.conduits)

    def attribute_properties(self) -> DataFrame:
        return ontologies.attribute_properties(self.ontology or self.graph, self.hierarchy)

    def class_functions(self) -> DataFrame:
        return ontologies.class_functions(self.ontology or self.graph, self.hierarchy)


