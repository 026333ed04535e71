"""The driver's relational tables as a network dataset, for queries over data of any size.

Customers are nodes, suppliers compartments or fittings below a customer, orders conduits between
customers, line items attributes of orders, nations and regions holders. Everything is derived from
keys, so that plain SQL over the same tables can say what a query must find. A table gives the triples
that are asked of it, a few in one select.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import terms as T
from sluice.operators.graph import SCHEMA, Graph, deduplicated
from sluice.terms import Terms

NET = "http://net.example/"
TERMS = Terms()
#: Class edges that hold in every projection.
EDGES = (
    ("Putorientatie", "Knooppunt"), ("Compartimentorientatie", "Knooppunt"), ("Hulpstukorientatie", "Knooppunt"), ("Leidingorientatie", "Verbinding"),
    ("Put", "Bouwwerk"), ("Compartiment", "Bouwwerk"), ("Hulpstuk", "Bouwwerk"), ("ZwaarDeksel", "Putdeksel"), ("Gebied", "Reg_0"),
    ("Flag_A", "Kenmerk"), ("Flag_N", "Kenmerk"), ("Flag_R", "Kenmerk"), ("HoogtePut", "Kenmerk"), ("WIBONThema", "Kenmerk"), ("LengteLeiding", "Kenmerk"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iri(*parts: str | Column) -> Column:
    return F.concat(F.lit(NET), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def name(*parts: str | Column) -> Column:
    return F.concat(F.lit(TERMS.base), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: Triples of a row that one select makes: of 1, 2, 3, 5, 8 and all tried, 5 was the fastest on a table of few splits.
AT_ONCE = 5


class Triples:
    """Collects the triples of one table's rows. Whatever has a type in a table's rows has all its types there."""

    #: Predicates whose object is the one that classes are asked of; of the others it is the subject.
    FORWARD = (TERMS.has_aspect, TERMS.has_part)

    def __init__(self, start: Column):
        self.start, self.rows, self.predicates, self.sure = start, [], [], []
        self.about, self.holders = [], []  # whom a triple is about, and the other end, as expressions
        self.classes: list[tuple[str, ...] | None] = []

    def add(self, s: Column, p: str, o: Column, kind: str = "I", when: Column | None = None, dt: str | None = None, classes: tuple[str, ...] | None = None) -> None:
        """classes: names of all that o can be, or where they begin, if they are few and known."""
        t = F.struct(s.alias("s"), F.lit(TERMS.iri(p)).alias("p"), o.alias("o"), (F.lit(kind) if kind == "L" else F.when(o.startswith("_:"), "B").otherwise(kind)).alias("kind"), F.lit(None).cast("string").alias("lang"), F.lit(dt).cast("string").alias("dt"), (self.start + len(self.rows)).alias("pos"))
        self.rows.append(t if when is None else F.when(when, t))
        self.predicates.append(TERMS.iri(p))
        ends = str(s), str(o)
        self.about.append(ends[TERMS.iri(p) in self.FORWARD])
        self.holders.append(ends[TERMS.iri(p) not in self.FORWARD])
        self.classes.append(classes and tuple(TERMS.iri(c) for c in classes))
        self.sure.append(when is None)

    def is_a(self, s: Column, *classes: str, when: Column | None = None) -> None:
        """A type that is the same in each row."""
        for c in classes:
            self.add(s, T.TYPE, name(c), when=when, classes=(c,))

    def either(self, holder: Column, member: Column, forward: str, inverse: str, forward_when: Column, when: Column | None = None) -> None:
        """The edge in one of its two ways of writing."""
        both = F.lit(True) if when is None else when
        self.add(holder, forward, member, when=both & forward_when)
        self.add(member, inverse, holder, when=both & ~forward_when)

    def _may_be(self, i: int, classes: Iterable[str]) -> bool:
        """Whether the i-th triple may be about one of some classes; of a type, whether it may be one."""
        types = [i] if self.predicates[i] == T.TYPE else [j for j, p in enumerate(self.predicates) if p == T.TYPE and self.about[j] == self.about[i]]
        return not types or any(self.classes[j] is None or any(c.startswith(k) for k in self.classes[j] for c in classes) for j in types)

    def near(self, classes: Iterable[str]) -> set[str] | None:
        """Who may be of some classes or hold an aspect that is, as expressions; None if that may be somebody whose types aren't here."""
        typed = {x for x, p in zip(self.about, self.predicates, strict=True) if p == T.TYPE}
        out = {x for i, x in enumerate(self.about) if self.predicates[i] == T.TYPE and self._may_be(i, classes)}
        out |= {self.holders[i] for i, p in enumerate(self.predicates) if p in (TERMS.has_aspect, TERMS.is_aspect_of) and self._may_be(i, classes)}
        return out if out <= typed else None

    def of(self, df: DataFrame, predicates: Iterable[str] | None = None, classes: Iterable[str] | None = None, about: set[str] | None = None) -> DataFrame | None:
        """The triples of df's rows; of some predicates, about some classes or some expressions, only those are made. None if the table has none."""
        asked = [i for i, p in enumerate(self.predicates) if (predicates is None or p in predicates) and (about is None or self.about[i] in about)]
        if classes is not None:
            asked = [i for i in asked if self._may_be(i, classes)]
        out = None
        for at in range(0, len(asked), AT_ONCE):
            some = asked[at : at + AT_ONCE]
            part = df.select(F.inline(F.array(*[self.rows[i] for i in some])))
            if not all(self.sure[i] for i in some):
                part = part.filter("p is not null")
            out = part if out is None else out.unionAll(part)
        return out


def tenths(n: Column) -> Column:
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def point_x(k: Column) -> Column:
    return 1000 * (k % 97)


def point_y(k: Column) -> Column:
    return 1000 * (k % 89)


def class_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([(TERMS.iri(a), T.SUBCLASS, TERMS.iri(b), "I", None, None, i) for i, (a, b) in enumerate(EDGES)], SCHEMA)
    edge = lambda a, b, at: (a.alias("s"), F.lit(T.SUBCLASS).alias("p"), b.alias("o"), F.lit("I").alias("kind"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("dt"), at.cast("long").alias("pos"))
    region = read(spark, sf_dir, "region").select(*edge(name("Reg_", F.col("r_regionkey")), name("Gebied"), 100 + F.col("r_regionkey")))
    nation = read(spark, sf_dir, "nation").select(*edge(name("Nat_", F.col("n_nationkey")), name("Reg_", F.col("n_regionkey")), 1000 + F.col("n_nationkey")))
    segment = read(spark, sf_dir, "customer").select("c_mktsegment").distinct().select(*edge(name("Seg_", F.col("c_mktsegment")), name("Put"), F.lit(2000)))
    priority = read(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("x")).distinct().select(*edge(name("Prio_", F.col("x")), name("Leiding"), F.lit(3000)))
    return fixed.unionAll(region).unionAll(nation).unionAll(segment).unionAll(priority)


def _holder_rows() -> Triples:
    k, r = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    t = Triples(k * 64 + (1 << 40))
    t.add(iri("n", k), T.TYPE, name("Nat_", k), classes=("Nat_",))
    t.either(iri("r", r), iri("n", k), "hasPart", "isPartOf", k % 2 == 0)
    return t


def holder_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holder_rows().of(read(spark, sf_dir, "nation"))


def _customer_rows() -> Triples:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    c = lambda tail="": iri("c", k, tail)
    t = Triples(k * 64 + (1 << 42))
    t.add(c(), T.TYPE, name("Seg_", F.col("c_mktsegment")), classes=("Seg_",))
    t.is_a(c(), "Put", when=k % 7 == 0)
    t.add(c(), T.LABEL, F.col("c_name"), "L", when=k % 10 != 9)
    t.either(c(), c("_o"), "hasAspect", "isAspectOf", k % 2 == 0)
    t.is_a(c("_o"), "Putorientatie")
    has_point = k % 50 != 0
    t.add(c("_o"), "hasAspect", c("_p"), when=has_point)
    t.is_a(c("_p"), "Punt", when=has_point)
    gml = F.when(k % 53 == 1, F.lit("<gml:Point><gml:pos>x</gml:pos></gml:Point>")).otherwise(F.concat(F.lit('<gml:Point srsDimension="3"><gml:pos>'), point_x(k).cast("string"), F.lit(" "), point_y(k).cast("string"), F.lit(" "), tenths(k % 100), F.lit("</gml:pos></gml:Point>")))
    t.add(c("_p"), "hasValue", gml, "L", when=has_point, dt=T.GML_LITERAL)
    t.either(iri("n", n), c(), "hasPart", "isPartOf", k % 2 == 0)
    t.add(iri("n", n), "hasPart", c(), when=k % 5 == 0)
    t.add(c(), "isPartOf", iri("n", n), when=k % 5 == 0)
    tall = k % 3 != 2
    t.add(c(), "hasAspect", c("_h"), when=tall)
    t.is_a(c("_h"), "HoogtePut", when=tall)
    t.add(c("_h"), "hasValue", (500 + k % 3000).cast("string"), "L", when=tall)
    t.add(c(), "hasAspect", c("_w"))
    t.is_a(c("_w"), "WIBONThema")
    t.add(c("_w"), "hasReference", name("Thema_", k % 4), when=k % 8 != 7)
    t.add(c("_o"), "hasConnection", c("_m"), when=k % 2 == 0)
    t.add(c("_m"), "hasConnection", c("_o"), when=k % 2 == 1)
    t.is_a(c("_m"), "Maaiveldorientatie")
    t.add(c("_m"), "hasAspect", c("_mh"))
    t.is_a(c("_mh"), "Maaiveldhoogte")
    t.add(c("_mh"), "hasValue", tenths(k % 40), "L", when=k % 4 != 3)
    sourced = k % 3 != 1
    t.add(c("_mh"), "hasAspect", c("_mi"), when=k % 3 == 0)
    t.add(c("_m"), "hasAspect", c("_mp"), when=k % 3 == 2)
    t.is_a(c("_mp"), "Punt", when=k % 3 == 2)
    t.add(c("_mp"), "hasValue", F.lit("<gml:Point><gml:pos>1 2</gml:pos></gml:Point>"), "L", when=k % 3 == 2, dt=T.GML_LITERAL)
    t.add(c("_mp"), "hasAspect", c("_mi"), when=k % 3 == 2)
    t.is_a(c("_mi"), "Inwinning", when=sourced)
    t.add(c("_mi"), "hasAspect", c("_mw"), when=sourced & (k % 4 != 0))
    t.is_a(c("_mw"), "WijzeVanInwinning", when=sourced)
    t.add(c("_mw"), "hasReference", name("Meth_", k % 5), when=sourced)
    t.add(c("_mi"), "hasAspect", c("_md"), when=sourced)
    t.is_a(c("_md"), "DatumInwinning", when=sourced)
    t.add(c("_md"), "hasValue", date_text(k), "L", when=sourced)
    t.add(c(), "hasAspect", c("_k"), when=k % 3 == 0)
    t.add(c(), "hasPart", c("_d"), when=k % 3 == 1)
    t.is_a(c("_d"), "ZwaarDeksel", when=k % 3 == 1)
    t.add(c("_d"), "hasAspect", c("_do"), when=k % 3 == 1)
    t.add(c("_do"), "hasAspect", c("_k"), when=k % 3 == 1)
    t.is_a(c("_k"), "Putdekselniveau", when=k % 3 != 2)
    t.add(c("_k"), "hasValue", tenths(k % 70), "L", when=k % 3 != 2)
    return t


def customer_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_rows().of(read(spark, sf_dir, "customer"))


def date_text(k: Column) -> Column:
    """Full dates with a time, bare years, days that don't exist, and no date at all."""
    year = (1950 + k % 70).cast("string")
    return F.when(k % 5 == 0, year).when(k % 5 == 1, F.lit("onbekend")).when(k % 5 == 2, F.concat(year, F.lit("-02-30"))).otherwise(F.concat(year, F.lit("-07-1"), (k % 10).cast("string"), F.lit("T00:00:00")))


def _supplier_rows(n_customers: int) -> Triples:
    k = F.col("s_suppkey")
    s = lambda tail="": iri("s", k, tail)
    t = Triples(k * 64 + (1 << 44))
    t.add(s(), T.TYPE, F.when(k % 3 == 0, name("Hulpstuk")).otherwise(name("Compartiment")), classes=("Hulpstuk", "Compartiment"))
    t.add(s(), "hasAspect", s("_o"))
    t.add(s("_o"), T.TYPE, F.when(k % 3 == 0, name("Hulpstukorientatie")).otherwise(name("Compartimentorientatie")), classes=("Hulpstukorientatie", "Compartimentorientatie"))
    t.either(iri("c", k * 13 % n_customers), s(), "hasPart", "isPartOf", k % 2 == 0, when=k % 10 != 5)
    return t


def supplier_triples(spark: SparkSession, sf_dir: str, n_customers: int) -> DataFrame:
    return _supplier_rows(n_customers).of(read(spark, sf_dir, "supplier"))


def order_end(n_customers: int) -> Column:
    return (F.col("o_custkey") * 7 + 13) % n_customers


def _order_rows(n_customers: int, n_suppliers: int) -> Triples:
    k, a = F.col("o_orderkey"), F.col("o_custkey")
    b = order_end(n_customers)
    o = lambda tail="": iri("o", k, tail)
    t = Triples(k * 64 + (1 << 46))
    t.add(o(), T.TYPE, name("Prio_", F.substring("o_orderpriority", 1, 1)), classes=("Prio_",))
    t.add(o(), "hasAspect", o("_o"))
    t.is_a(o("_o"), "Leidingorientatie")
    t.either(o("_o"), o("_b"), "hasPart", "isPartOf", k % 3 != 0)
    t.either(o("_o"), o("_e"), "hasPart", "isPartOf", k % 3 != 1)
    t.is_a(o("_b"), "BeginpuntLeiding")
    t.is_a(o("_e"), "EindpuntLeiding")
    begin = F.when(k % 9 == 4, iri("s", k % n_suppliers, "_o")).otherwise(iri("c", a, "_o"))
    t.add(o("_b"), "hasConnection", begin, when=k % 2 == 0)
    t.add(begin, "hasConnection", o("_b"), when=k % 2 == 1)
    end = F.when(k % 11 == 0, iri("s", k % n_suppliers, "_put")).otherwise(iri("c", b, "_o"))
    t.add(o("_e"), "hasConnection", end)
    t.add(o("_o"), "hasAspect", o("_l"))
    t.is_a(o("_l"), "Lijn")
    xy = lambda n: F.concat_ws(" ", point_x(n).cast("string"), point_y(n).cast("string"))
    line = F.when(k % 4 == 0, F.concat_ws(" ", xy(b), xy(a))).otherwise(F.concat_ws(" ", xy(a), xy(b)))
    t.add(o("_l"), "hasValue", F.concat(F.lit('<gml:LineString srsDimension="2"><gml:posList>'), line, F.lit("</gml:posList></gml:LineString>")), "L", dt=T.GML_LITERAL)
    for side, kind, m in (("_b", "BobBeginpuntLeiding", 90), ("_e", "BobEindpuntLeiding", 80)):
        t.add(o(side), "hasAspect", o(side + "b"))
        t.is_a(o(side + "b"), kind)
        t.add(o(side + "b"), "hasValue", tenths(k % m), "L", when=k % 6 != 5)
    t.add(o(), "hasAspect", o("_len"))
    t.is_a(o("_len"), "LengteLeiding")
    t.add(o("_len"), "hasValue", F.when(k % 13 == 0, F.lit("1d")).otherwise((k % 75 + 1).cast("string")), "L")
    return t


def order_triples(spark: SparkSession, sf_dir: str, n_customers: int, n_suppliers: int) -> DataFrame:
    return _order_rows(n_customers, n_suppliers).of(read(spark, sf_dir, "orders"))


def _item_rows() -> Triples:
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    own = F.concat_ws("_", ok.cast("string"), ln.cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), "l_returnflag", "l_linestatus")
    a = iri("a", own)
    t = Triples((ok * 64 + ln) * 1024 + F.col("l_partkey") % 1000 + (1 << 50))
    t.add(iri("o", ok), "hasAspect", a)
    t.add(a, T.TYPE, name("Flag_", F.col("l_returnflag")), classes=("Flag_",))
    t.add(a, T.TYPE, name("Status_", F.col("l_linestatus")), when=ln % 4 == 0, classes=("Status_",))
    t.add(a, "hasValue", F.col("l_quantity").cast("int").cast("string"), "L", when=ln % 5 != 0)
    t.add(a, "hasReference", name("Ship_", F.col("l_linestatus")), when=ln % 3 == 0)
    return t


def item_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_rows().of(read(spark, sf_dir, "lineitem"))


def restriction_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ontology from `part`: a datatype with facets per part, a function per fitting class."""
    k = F.col("p_partkey")
    c, r, d = name("K_", k), F.concat(F.lit("_:r"), k.cast("string")), name("Dt_", k)
    t = Triples(k * 64 + (1 << 48))
    t.add(c, T.SUBCLASS, name("Kenmerk"))
    t.add(c, T.SUBCLASS, r)
    t.add(r, T.OWL + "onProperty", F.when(k % 3 == 0, name("hasReference")).otherwise(name("hasValue")))
    t.add(r, T.OWL + "allValuesFrom", d, when=k % 4 != 3)
    b = lambda tail: F.concat(F.lit("_:" + tail), k.cast("string"))
    t.add(d, T.OWL + "equivalentClass", b("e"))
    t.add(b("e"), T.OWL + "onDatatype", F.when(k % 2 == 0, F.lit(T.XSD + "integer")).otherwise(F.lit(T.XSD + "decimal")))
    t.add(b("e"), T.OWL + "withRestrictions", b("x"))
    t.add(b("x"), T.FIRST, b("lo"))
    t.add(b("x"), T.REST, b("y"))
    t.add(b("y"), T.FIRST, b("hi"))
    t.add(b("y"), T.REST, F.lit(T.NIL))
    t.add(b("lo"), T.XSD + "minInclusive", (k % 50).cast("string"), "L")
    t.add(b("hi"), T.XSD + "maxInclusive", (F.col("p_size") + 50).cast("string"), "L", when=k % 5 != 0)
    t.add(name("F_", k), T.SUBCLASS, F.when(k < 10, name("Hulpstuk")).otherwise(name("F_", F.floor(k / 10))))
    t.add(name("F_", k), T.SUBCLASS, b("f"), when=k % 4 == 0)
    t.add(b("f"), T.OWL + "onProperty", name("functie"), when=k % 4 == 0)
    t.add(b("f"), T.OWL + "hasValue", name("Doen_", k % 7), when=k % 4 == 0)
    return t.of(read(spark, sf_dir, "part"))


def sizes(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return read(spark, sf_dir, "customer").count(), read(spark, sf_dir, "supplier").count()


class TableGraph(Graph):
    """The network as its tables' rows say it, with nothing kept: whoever asks for a predicate has its triples made from the columns that they need.

    Kept, a row's dozens of triples and their properties are written, dealt out and read again at many
    times the table's size for each query, whatever it asks.
    """

    def __init__(self, tables: list[tuple[DataFrame, Triples]], classes: DataFrame, terms: Terms):
        self.tables, self.classes, self.terms = tables, classes, terms
        self._made: dict[tuple[tuple[str, ...] | None, ...], DataFrame] = {}

    @cached_property
    def triples(self) -> DataFrame:
        return deduplicated(self.statements())

    def statements(self, predicates: tuple[str, ...] | None = None, classes: tuple[str, ...] | None = None) -> DataFrame:
        """All statements, or those of some predicates, for which nothing else is made; with classes, what is surely about others is left out."""
        if (predicates, classes) not in self._made:
            out = self.classes if predicates is None or T.SUBCLASS in predicates else None
            for df, rows in self.tables:
                part = rows.of(df, predicates, classes)
                out = part if out is None else out if part is None else out.unionAll(part)
            self._made[predicates, classes] = self.classes.limit(0) if out is None else out
        return self._made[predicates, classes]

    def with_predicates(self, *predicates: str) -> DataFrame:
        return deduplicated(self.statements_of(*predicates))

    def statements_of(self, *predicates: str) -> DataFrame:
        return self.statements(tuple(sorted({self.terms.iri(p) for p in predicates})))

    def statements_with(self, classes: tuple[str, ...], *predicates: str) -> DataFrame:
        return self.statements(tuple(sorted({self.terms.iri(p) for p in predicates})), tuple(sorted({self.terms.iri(c) for c in classes})) or None)

    def statements_near(self, classes: tuple[str, ...], *predicates: str) -> DataFrame:
        iris, asked = [self.terms.iri(c) for c in classes], tuple(sorted({self.terms.iri(p) for p in predicates}))
        near = [rows.near(iris) for _, rows in self.tables]
        if not classes or None in near or set(asked) - {T.TYPE, T.LABEL}:
            return self.statements(asked)
        parts = [p for (df, rows), about in zip(self.tables, near, strict=True) if (p := rows.of(df, asked, about=about)) is not None]
        return reduce(DataFrame.unionAll, parts) if parts else self.classes.limit(0)

    def stored(self) -> Graph:
        return self


def graph(spark: SparkSession, sf_dir: str, items: bool = True) -> Graph:
    """The network, statements of nations and regions twice, made from the tables as it is asked for."""
    customers, suppliers, nations = (read(spark, sf_dir, n) for n in ("customer", "supplier", "nation"))
    c, s = customers.count(), suppliers.count()
    holders = (nations, _holder_rows())
    tables = [holders, holders, (customers, _customer_rows()), (suppliers, _supplier_rows(c)), (read(spark, sf_dir, "orders"), _order_rows(c, s))]
    if items:
        tables.append((read(spark, sf_dir, "lineitem"), _item_rows()))
    return TableGraph(tables, class_triples(spark, sf_dir), TERMS)


def class_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(class_triples(spark, sf_dir), TERMS)
