"""Small networks in Turtle, with the answers they must have."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice import terms as T
from sluice.errors import BoundaryError, ContentError, CutError
from sluice.functions import gml, plane, scalars
from sluice.operators import clip, domain, hierarchy, network, restrictions
from sluice.operators.domain import Dataset, Reader
from sluice.operators.graph import SCHEMA, Graph
from sluice.operators.hierarchy import Hierarchy
from sluice.sources import geojson, sink, turtle

HEAD = """@prefix g: <http://data.gwsw.nl/1.6/totaal/> . @prefix : <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix geo: <http://www.opengis.net/ont/geosparql#> .
g:Putorientatie rdfs:subClassOf g:Knooppunt . g:Compartimentorientatie rdfs:subClassOf g:Knooppunt . g:Hulpstukorientatie rdfs:subClassOf g:Knooppunt . g:Leidingorientatie rdfs:subClassOf g:Verbinding .
g:Inspectieput rdfs:subClassOf g:Put . g:Uitlaat rdfs:subClassOf g:Bouwwerk . g:Zwaar rdfs:subClassOf g:Putdeksel .
"""


def put(n, x, y, extra="", cls="Put", ori="Putorientatie"):
    return f':{n} a g:{cls} ; g:hasAspect :{n}_o . :{n}_o a g:{ori} ; g:hasAspect [ a g:Punt ; g:hasValue "<gml:Point srsDimension=\\"2\\"><gml:pos>{x} {y}</gml:pos></gml:Point>"^^geo:gmlLiteral ] . {extra}\n'


def line(n, a, b, coords, dim=' srsDimension=\\"2\\"', extra=""):
    return f':{n} a g:Leiding ; g:hasAspect :{n}_o . :{n}_o a g:Leidingorientatie ; g:hasPart :{n}_b , :{n}_e ; g:hasAspect [ a g:Lijn ; g:hasValue "<gml:LineString{dim}><gml:posList>{coords}</gml:posList></gml:LineString>"^^geo:gmlLiteral ] . :{n}_b a g:BeginpuntLeiding ; g:hasConnection :{a} . :{n}_e a g:EindpuntLeiding . :{b} g:hasConnection :{n}_e . {extra}\n'


def graph(spark, text):
    got, _ = turtle.parsed(HEAD + text)
    return Graph(spark.createDataFrame([(*r, i) for i, r in enumerate(got)], SCHEMA), T.Terms())


def short(x):
    return None if x is None else T.local_name(x)


def test_reading(spark):
    text = put("A", 0, 0, ':A rdfs:label "put A" . :A_o g:hasConnection :A_m . :A_m a g:Maaiveldorientatie ; g:hasAspect [ a g:Maaiveldhoogte ; g:hasValue "10.0" ] . :d a g:Zwaar ; g:isPartOf :A ; g:hasAspect :do . :do g:hasAspect [ a g:Putdekselniveau ; g:hasValue "9.95" ; g:hasAspect [ a g:Inwinning ; g:hasAspect [ a g:WijzeVanInwinning ; g:hasReference g:Inmeting ] , [ a g:DatumInwinning ; g:hasValue "2019-05-17" ] ] ] . :A g:hasAspect [ a g:HoogtePut ; g:hasValue "1500" ] .')
    text += put("B", 10, 0) + ":B_c1 a g:Compartiment ; g:isPartOf :B ; g:hasAspect :B_c1_o . :B_c1_o a g:Compartimentorientatie . :S g:hasPart :B , :A , :L1 ."
    text += put("T1", 5, 5, cls="Mof", ori="Hulpstukorientatie")
    text += line("L1", "A_o", "B_c1_o", "10 0 0 0", extra=':L1_b g:hasAspect [ a g:BobBeginpuntLeiding ; g:hasValue "8.60" ] .') + line("L2", "A_o", "T1_put", "0 0 5 5") + line("L3", "A_o", "B_put", "0 0 1 1")
    ds = Dataset.load(graph(spark, text))
    nodes = {short(r["uri"]): r for r in ds.nodes.collect()}
    assert set(nodes) == {"A", "B", "B_c1", "T1"}
    a = nodes["A"]
    assert a["label"] == "put A" and a["point"]["xs"] == [0.0] and nodes["B_c1"]["point"] is None
    assert (a["cover_aspect"]["value"], a["cover_provenance"]["method"], str(a["cover_provenance"]["date"])) == ("9.95", "Inmeting", "2019-05-17")
    assert [short(p) for p in nodes["B_c1"]["parents"]] == ["B"] and nodes["A"]["parents"] == ["http://e/S"]
    d = scalars.node_columns()
    row = ds.nodes.filter("uri = 'http://e/A'").select(*[c.alias(n) for n, c in d.items()]).first()
    assert (row["ground"], row["cover"], row["top"], row["height_m"]) == (10.0, 9.95, 9.95, 1.5) and row["bottom"] == pytest.approx(8.45)
    conduits = {short(r["uri"]): r for r in ds.conduits.collect()}
    assert [short(conduits[c]["start_node"]) for c in ("L1", "L2", "L3")] == ["A"] * 3
    assert [short(conduits[c]["end_node"]) for c in ("L1", "L2", "L3")] == ["B_c1", "T1", None]
    assert conduits["L1"]["bob_start_aspect"]["value"] == "8.60"
    assert tuple(domain.repairs(ds.conduits).first()) == (1, 1)
    ends = {short(r["uri"]): (short(r["start"]), short(r["end"])) for r in network.conduit_nodes(ds.conduits, ds.nodes, ds.hierarchy, ["Put"]).collect()}
    assert ends["L1"] == ("A", "B")
    turned = {short(r["uri"]): r["reversed"] for r in network.drawing_direction(ds.conduits, ds.nodes, ds.hierarchy, ["Put"]).collect()}
    assert turned["L1"] is True and turned["L3"] is None
    members = domain.system_members(ds.graph, ds.nodes, ds.conduits).filter("holder = 'http://e/S'").first()
    assert [short(x) for x in members["conduits"]] == ["L1"] and [short(x) for x in members["nodes"]] == ["A", "B"]
    assert ds.subset(spark.createDataFrame([("http://e/A",)], "uri string")).nodes.count() == 1
    marked = ds.with_fillers(["Maaiveldhoogte"], 10.0).nodes.filter("uri = 'http://e/A'").first()
    assert marked["ground_aspect"] is None and marked["fillers"][0]["value"] == 10.0 and ds.with_fillers([]) is ds


def test_geometry_errors_and_first_orientation(spark):
    bad = '[ a g:Punt ; g:hasValue "<gml:Point><gml:pos>x y</gml:pos></gml:Point>"^^geo:gmlLiteral ]'
    text = put("A", 1, 2000) + f":A g:hasAspect :A_o2 . :A_o2 a g:Putorientatie ; g:hasAspect {bad} . :lone a g:Putorientatie ; g:hasAspect {bad} ."
    ds = Dataset.load(graph(spark, text))
    assert ds.nodes.first()["point"]["ys"] == [2000.0]
    assert {short(r["uri"]) for r in ds.geometry_errors.collect()} == {"A", "lone"}


def test_structural_recognition_and_empty(spark):
    g = graph(spark, put("A", 0, 0) + ":B g:hasAspect :B_o . :B_o a g:Putorientatie . :C g:hasAspect :C_o . :C_o g:hasAspect [ a g:Punt ] .")
    r = Reader(g, Hierarchy.of(g))
    assert {x["what"]: x["n"] for x in r.structural_differences().collect()} == {"nodes_without_geometry": 1, "nodes_without_role": 1}
    with pytest.raises(ContentError):
        Dataset.load(graph(spark, ":x :y :z ."))


def test_inverse_writing_counts_once(spark):
    g = graph(spark, ":a g:hasPart :b . :b g:isPartOf :a . :c g:isPartOf :a . :a g:hasPart :d . :a g:hasConnection :b . :b g:hasConnection :a .")
    assert [(short(r["member"]), r["ord"]["way"]) for r in g.parts().orderBy("ord").collect()] == [("b", 0), ("d", 0), ("c", 1)]
    assert g.connections().count() == 4 and g.neighbours().count() == 2


def test_hierarchy_with_a_ring(spark):
    g = graph(spark, "g:X rdfs:subClassOf g:Y . g:Y rdfs:subClassOf g:X . g:Z rdfs:subClassOf g:X .")
    h = Hierarchy.of(g)
    assert {short(r["class"]) for r in h.below("Y").collect()} == {"X", "Y", "Z"}
    assert [short(r["class"]) for r in h.below("Alone").collect()] == ["Alone"] and not h.usable("Alone")
    typed = spark.createDataFrame([("a", T.DEFAULT_BASE + t) for t in ("X", "Y")], "uri string, type string")
    assert h.most_specific(typed, "uri").count() == 2  # each is above the other: all stay
    empty = spark.createDataFrame([], "uri string, type string")
    assert hierarchy.object_type(typed, empty, h).first()["object_type"] == "X"


def test_climbing_two_holders(spark):
    g = graph(spark, put("B", 0, 0, cls="Inspectieput") + ":street g:hasPart :c . :c a g:Compartiment ; g:isPartOf :B ; g:hasAspect :c_o . :c_o a g:Compartimentorientatie . :ring a g:Compartiment ; g:hasPart :ring2 ; g:isPartOf :ring2 ; g:hasAspect :r_o . :r_o a g:Compartimentorientatie . :ring2 a g:Compartiment ; g:hasAspect :r2_o . :r2_o a g:Compartimentorientatie .")
    ds = Dataset.load(g)
    starts = spark.createDataFrame([("http://e/c",), ("http://e/ring",), ("http://e/nobody",)], "uri string")
    got = {short(r["uri"]): (short(r["node"]), sorted(map(short, r["visited"]))) for r in network.climb(starts, ds.nodes, ds.hierarchy, ["Put"]).collect()}
    assert got == {"c": ("B", ["B", "c"]), "ring": (None, ["ring", "ring2"]), "nobody": (None, [])}


def test_lists_that_run_in_a_ring(spark):
    g = graph(spark, "_:a <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> 1 ; <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> _:a .")
    with pytest.raises(ContentError):
        restrictions.list_items(g, spark.createDataFrame([("_:b0",)], "head string"))


@pytest.mark.parametrize(
    ("literal", "kind", "heights"),
    [
        ("<gml:Point><gml:pos>168462.01 442691.30 22.45</gml:pos></gml:Point>", "Point", [22.45]),
        ("<gml:Point><gml:pos>1 2</gml:pos></gml:Point>", "Point", [None]),
        ('<gml:LineString><gml:posList srsDimension="3">1 2 30 4 5 60</gml:posList></gml:LineString>', "LineString", [30.0, 60.0]),
        ("<gml:LinearRing><gml:posList>0 0 1 0 1 1 0 0</gml:posList></gml:LinearRing>", "Polygon", [None] * 4),
        ("<gml:LineString><gml:posList>1 2 3 4 5</gml:posList></gml:LineString>", None, None),
        ('<gml:Point srsDimension="1"><gml:pos>1</gml:pos></gml:Point>', None, None),
        ("<gml:Point><gml:pos></gml:pos></gml:Point>", None, None),
        ("<gml:Blob><gml:pos>1 2</gml:pos></gml:Blob>", None, None),
        ("<gml:Point>1 2</gml:Point>", None, None),
        ('<gml:LineString srsDimension="2"><gml:posList>1 2</gml:posList></gml:LineString>', None, None),
    ],
)
def test_gml_in_columns(spark, literal, kind, heights):
    row = spark.createDataFrame([(literal,)], "l string").select(gml.parsed(F.col("l")).alias("g")).first()["g"]
    if kind is None:
        assert row["geom"] is None and row["error"]
        return
    assert (row["geom"]["kind"], row["zs"]) == (kind, heights) and len(row["geom"]["xs"]) == len(row["geom"]["ys"]) == len(heights)


def boxes(*spans):
    return [plane.Polygon(n, n, [[[(a, -50), (b, -50), (b, 50), (a, 50), (a, -50)]]]) for n, a, b in spans]


LAYER = boxes(("West", 0, 20), ("East", 20, 80))


def lit(coords, dim=' srsDimension="2"'):
    return f"<gml:LineString{dim}><gml:posList>{coords}</gml:posList></gml:LineString>"


CUTS = [
    (lit("5 0 40 0"), 3, ["5 0 20.000 0.000", "20.000 0.000 40 0"]),
    (lit("5 0 1.00 40 0 2.00", ' srsDimension="3"'), 3, ["5 0 1.00 20.000 0.000 1.429", "20.000 0.000 1.429 40 0 2.00"]),
    (lit("5 0 20 0 40 0"), 3, ["5 0 20 0", "20 0 40 0"]),
    (lit("5 0 20 0 20 0 40 0"), 3, ["5 0 20 0", "20 0 20 0 40 0"]),
    (lit("5 0 40 0 10 0"), 3, ["5 0 20.000 0.000", "20.000 0.000 40 0 20.000 0.000", "20.000 0.000 10 0"]),
    (lit("5 0 1 40 0 2 50 0 3 60 0 3 70 0 4", ""), 3, None),
    (lit("5  0 40 0"), 3, None),
    (lit("20 0 20 10"), 1, None),
    (lit("5 0 10 0"), 1, None),
    (lit("500 0 500 0"), 2, None),
    (lit("-9 0 95 0"), 3, ["-9 0 20.000 0.000", "20.000 0.000 95 0"]),
    (lit("300 0 400 0 900 0"), 2, None),
    ("<gml:Point><gml:pos>20 1</gml:pos></gml:Point>", 1, None),
    ("<gml:Point><gml:pos>99 1</gml:pos></gml:Point>", 2, None),
    ("<gml:LinearRing><gml:posList>15 0 45 0 45 9 15 9 15 0</gml:posList></gml:LinearRing>", 2, None),
    ("<gml:Point><gml:pos>x</gml:pos></gml:Point>", 0, None),
]


def test_cutting_lines(spark):
    rows = spark.createDataFrame([(i, c[0], True) for i, c in enumerate(CUTS)], "i int, literal string, cut boolean").repartition(3)
    got = {r["i"]: r for r in clip.placed(rows, LAYER).collect()}
    for i, (literal, mask, pieces) in enumerate(CUTS):
        assert got[i]["mask"] == [mask], literal
        assert (None if got[i]["pieces"] is None else [p["coordinates"] for p in got[i]["pieces"]]) == pieces, literal
    uncut = {r["i"]: r["mask"] for r in clip.placed(rows.withColumn("cut", F.lit(False)), LAYER).collect()}
    assert uncut[0] == uncut[7] == [3] and uncut[8] == [1] and uncut[9] == [2]


def test_random_lines_come_back_and_lie_where_they_should():
    rng = np.random.default_rng(5)
    layer = plane.Layer([plane.Polygon("a", "a", [[[(0, 0), (40, 5), (35, 60), (3, 50)], [(10, 10), (20, 10), (20, 20), (10, 20)]]]), *boxes(("b", 30, 70)), plane.Polygon("c", "c", [[[(80, 0), (90, 0), (85, 9)]], [[(80, 40), (95, 40), (90, 30), (85, 45)]]])])
    for _ in range(40):
        sizes = rng.integers(2, 7, 30)
        text = [[f"{v:.3f}" for v in rng.uniform(-10, 100, 3 * n)] for n in sizes]
        points = np.array([float(v) for t in text for v in t]).reshape(-1, 3)
        lines = plane.Lines(points[:, :2], points[:, 2], np.concatenate([[0], np.cumsum(sizes)]))
        table, pieces = plane.allot(layer, lines, text)
        for t, row, cut in zip(text, table, pieces, strict=True):
            if cut is None:
                assert row.sum() == 1
                continue
            assert set(np.flatnonzero(row)) == {p.part for p in cut} and all(a.part != b.part for a, b in itertools.pairwise(cut))
            back = []
            for p in cut:
                own = p.coordinates.split()
                back += own[3 * bool(p.sequence) : len(own) - 3 * p.inserted_end]
            assert back == t
            for p in cut:
                xy = np.array([float(v) for v in p.coordinates.split()]).reshape(-1, 3)[:, :2]
                asked = [(a + (b - a) * s) for a, b in itertools.pairwise(xy) for s in (0.3, 0.7)]
                held = layer.covering(np.array(asked))
                assert (layer.home(np.array(asked)) == p.part)[held.sum(axis=1) == 1].all()


@pytest.mark.parametrize("ends", [((61000, 41000), (63000, 44000)), ((61000, 41000), (64000, 48000)), ((61000, 41000), (65000, 50000))])
def test_own_point_of_a_line_of_two(ends):
    """Both ends are equally near to the middle, whatever its rounding says."""
    xy = np.array(ends, float)
    assert (plane.point_on_line(xy) == xy[0]).all() and (plane.point_on_line(xy[::-1]) == xy[1]).all()


def test_own_point_of_equally_near_vertices():
    a, b = (61000, 41000), (63000, 44000)
    assert (plane.point_on_line(np.array([a, a, b, b], float)) == a).all()


def test_polygons():
    ring = plane.Polygon("r", "r", [[[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]]])
    at = lambda *xy: np.array(xy, float)
    assert ring.covers(at((0, 5), (10, 5), (4, 5), (5, 5), (11, 5))).tolist() == [True, True, True, False, False]
    assert ring.distances(at((5, 5), (13, 14), (1, 1))).tolist() == [1, 5, 0]
    assert plane.Layer(LAYER).home(at((20, 0), (500, 0))).tolist() == [0, 1]
    assert plane.point_on_line(at((0, 0), (9, 0))).tolist() == [0, 0] and plane.point_on_line(at((0, 0), (1, 0), (4, 0), (10, 0))).tolist() == [4, 0]
    assert plane.point_in_ring(at((0, 0), (10, 0), (10, 10), (0, 10))).tolist() == [5, 5]


def test_boundary_layers():
    feature = '{"type":"Feature","properties":{"n":%s},"geometry":{"type":"%s","coordinates":%s}}'
    square = "[[[0,0],[1,0],[1,1],[0,0]]]"
    wrap = lambda *f: '{"features":[' + ",".join(f) + "]}"
    assert geojson.layer_of(wrap(feature % ('"De Wijk/1"', "Polygon", square)), "n")[0].file == "De-Wijk-1"
    for text in ("x", wrap(), wrap(feature % ("null", "Polygon", square)), wrap(feature % ('"a"', "Point", "[0,0]")), wrap(feature % ('"a"', "Polygon", "[]")), wrap(feature % ('"a b"', "Polygon", square), feature % ('"a/b"', "Polygon", square))):
        with pytest.raises(BoundaryError):
            geojson.layer_of(text, "n")


NETWORK = (
    put("P1", 5, 0, ":P1 g:hasPart :lid . :lid a g:Zwaar .") + put("P2", 40, 0)
    + line("L", "P1_o", "P2_o", "5 0 1.0 40 0 2.0", ' srsDimension=\\"3\\"', extra=":L g:hasPart :vent . :vent g:hasConnection :P2_o . :L rdfs:label \"lang\" .")
    + "_:x :note [ :deep _:y ] . <http://e/onto> a :Ontology ."
)


def test_clip_and_merge(spark):
    g = graph(spark, NETWORK)
    parts = clip.clip(g, LAYER).cache()
    of = lambda i: {(short(r["s"]), short(r["p"]), short(r["o"])) for r in parts.filter(f"part = {i}").collect()}
    west, east = of(0), of(1)
    assert ("P1", "hasPart", "lid") in west and not any(s == "P2" for s, _, _ in west) and not any(s in ("P1", "lid") for s, _, _ in east)
    assert ("vent", "hasConnection", "P2_o") in east and not any(s == "vent" for s, _, _ in west)
    assert all(any(s == "L" and p == "type" for s, p, _ in x) and any(s == "onto" for s, _, _ in x) for x in (west, east))
    assert any(p.endswith("isCut") and s == "L_o" for s, p, _ in west)
    texts = [r["o"] for r in parts.filter("dt like '%gmlLiteral' and o like '%LineString%'").orderBy("part").collect()]
    assert "20.000 0.000 1.429</" in texts[0] and ">20.000 0.000 1.429" in texts[1]
    for order in ("part", "1 - part"):
        back = clip.merge(parts.withColumn("part", F.expr(order).cast("int")), g.terms)
        assert sink.isomorphic_fingerprint(back).first() == sink.isomorphic_fingerprint(g.triples).first()
        assert back.filter(F.col("p").startswith(clip.CUT)).isEmpty()
    with pytest.raises(CutError):
        clip.merge(parts.filter("part = 0"), g.terms)
    with pytest.raises(CutError):
        clip.clip(Graph(parts.drop("part"), g.terms), LAYER)


@pytest.mark.parametrize("n", [12, 130])
def test_many_polygons(spark, n):
    g = graph(spark, NETWORK)
    layer = boxes(*[(f"b{i}", i * 48 / n, (i + 1) * 48 / n) for i in range(n)])
    back = clip.merge(clip.clip(g, layer), g.terms)
    assert sink.isomorphic_fingerprint(back).first() == sink.isomorphic_fingerprint(g.triples).first()


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0, 9, 9), (1, 1, 2, 2), []), ((3, 50, 7, 53), (100000, 400000, 200000, 500000), ["disjoint", "scale"]), ((0, 0, 1, 1), (5, 5, 6, 6), ["disjoint"]), ((-1, -1, 5000, 5000), (0, 0, 1, 1), ["scale"]), ((0, 0, 0, 0), (0, 0, 0, 0), []), ((0, 0, 0, 0), (1, 1, 2, 2), ["disjoint", "scale"])])
def test_range_reasons(a, b, want):
    assert clip.range_reasons(a, b) == want


def test_scalars(spark):
    texts = ["1500", None, "onbekend", "1d", " 1.5e2 ", "1_0", "-.5", "1980-01-01", "1980-01-01T00:00:00", "1980", "1980-02-30", "0000", "geen datum"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", scalars.number(F.col("t")).alias("n"), scalars.date_of(F.col("t")).cast("string").alias("d")).orderBy("i").collect()
    assert [r["n"] for r in got][:7] == [1500.0, None, None, None, 150.0, None, -0.5]
    assert [r["d"] for r in got][7:] == ["1980-01-01"] * 3 + [None] * 3
    assert T.local_name("http://x/a#b") == "b" and T.Base.read(T.DEFAULT_BASE, whole=True) == T.Base("1.6") and str(T.Base("1.6")) == T.DEFAULT_BASE
    assert T.Base.read("http://x/") is T.Base.read(None) is T.Base.read(T.DEFAULT_BASE + "Put", whole=True) is None and T.Base.read(T.DEFAULT_BASE + "Put") == T.Base("1.6")


def test_dataset_questions(spark):
    ds = Dataset.load(graph(spark, put("A", 0, 0, cls="Inspectieput") + put("B", 10, 0) + line("L", "A_o", "B_o", "0 0 10 0")))
    names = lambda df, c="uri": sorted(short(r[c]) for r in df.collect())
    assert names(ds.of_class("Put")) == ["A", "B"] and names(ds.is_a("Inspectieput")) == ["A"] and names(ds.conduits_of("Leiding")) == ["L"]
    assert {short(r["uri"]): short(r["root"]) for r in ds.nodes_of("Inspectieput", "Put").collect()} == {"A": "Inspectieput", "B": "Put"}
    assert {short(r["uri"]): r["object_type"] for r in ds.object_types().collect()} == {"A": "Inspectieput", "B": "Put", "L": "Leiding"}
    assert ds.version() == "1.6" and names(ds.graph_is_a("Put"), "s") == ["A", "B"]
    with pytest.raises(ValueError, match="connections"):
        ds.of_class("Leidingorientatie")
    assert {short(r["uri"]): (short(r["start"]), short(r["end"])) for r in ds.conduit_nodes("Put").collect()} == {"L": ("A", "B")}


def test_clip_and_merge_files(spark, tmp_path):
    (tmp_path / "net.ttl").write_text(HEAD + NETWORK)
    square = lambda a, b: f"[[[{a},-50],[{b},-50],[{b},50],[{a},50],[{a},-50]]]"
    (tmp_path / "b.geojson").write_text('{"features":[' + ",".join(f'{{"properties":{{"n":"{n}"}},"geometry":{{"type":"Polygon","coordinates":{square(a, b)}}}}}' for n, a, b in (("West", 0, 20), ("East", 20, 80))) + "]}")
    files = clip.clip_file(spark, str(tmp_path / "net.ttl"), str(tmp_path / "b.geojson"), str(tmp_path), "n", check_range=True)
    assert [f.rsplit("/", 1)[-1] for f in files] == ["West.ttl", "East.ttl"]
    clip.merge_files(spark, files[::-1], str(tmp_path / "back.ttl"))
    sign = lambda p: sink.isomorphic_fingerprint(turtle.load(spark, str(tmp_path / p)).triples).first()
    assert sign("back.ttl") == sign("net.ttl")


def test_both_closures_agree(spark, monkeypatch):
    g = graph(spark, "g:X s:subClassOf g:Y . g:Y s:subClassOf g:X . g:Z s:subClassOf g:X . g:W s:subClassOf g:Z .".replace("s:", "rdfs:"))
    small = {tuple(r) for r in hierarchy.subclass_closure(g).collect()}
    monkeypatch.setattr(hierarchy, "SMALL", 2)
    assert {tuple(r) for r in hierarchy.subclass_closure(g).collect()} == small and len(small) > 12
