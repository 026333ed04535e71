"""The network of the tables is made as it is asked for, and read without being stored."""

from pathlib import Path

import pytest

from sluice import terms as T
from sluice.operators.domain import Reader
from sluice.operators.fixpoint import shared_folder
from sluice.operators.graph import Graph
from sluice.operators.hierarchy import Hierarchy
from sluice.sources import tables
from sluice.terms import Terms

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def test_the_network_is_made_as_asked_and_never_written(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    had = set(folder.iterdir())
    g = tables.graph(spark, str(DATA), items=False)
    links = g.with_predicates("hasConnection")
    assert "LengteLeiding" not in links._jdf.queryExecution().optimizedPlan().toString()
    assert links.exceptAll(g.triples.filter(g.triples["p"] == g.terms.has_connection)).isEmpty()
    assert links.count() == g.triples.filter(g.triples["p"] == g.terms.has_connection).count()
    assert set(folder.iterdir()) == had


def test_readers_of_nothing_stored_find_what_stored_ones_do_with_statements_written_twice(spark):
    t = Terms()
    is_a = lambda s, c, at: (s, T.TYPE, t.iri(c), "I", None, None, at)
    edge = lambda s, p, o, at: (s, t.iri(p), o, "I", None, None, at)
    text = lambda s, v, at: (s, t.has_value, v, "L", None, None, at)
    rows = [
        is_a("n", "Put", 5), is_a("n", "Gebied", 2), is_a("n", "Put", 1), is_a("o", "Putorientatie", 6), edge("n", "hasAspect", "o", 7), edge("o", "isAspectOf", "n", 3),
        is_a("m", "Maaiveldorientatie", 8), edge("m", "hasConnection", "o", 9), edge("m", "hasConnection", "o", 4), edge("m", "hasAspect", "h", 10), is_a("h", "Maaiveldhoogte", 11), text("h", "2.0", 14), text("h", "1.0", 13), text("h", "2.0", 12),
        (t.iri("Putorientatie"), T.SUBCLASS, t.iri("Knooppunt"), "I", None, None, 20),
    ]
    rows = spark.createDataFrame(rows, "s string, p string, o string, kind string, lang string, dt string, pos long")

    class Twice(Graph):
        def statements_of(self, *predicates):
            return rows.filter(rows["p"].isin([self.terms.iri(p) for p in predicates]))

    lazy, stored = Twice(rows, t), Graph(rows, t).stored()
    stored.properties = stored.properties.stored()
    h = Hierarchy.of(stored)
    a, b = (Reader(g, h).nodes().collect() for g in (lazy, stored))
    assert a == b and len(a) == 1
    assert a[0]["ground_aspect"]["value"] == "2.0"
    assert [r["type"] for r in Reader(lazy, h).types.orderBy("s", "pos").collect()][-2:] == [r["type"] for r in Reader(stored, h).types.orderBy("s", "pos").collect()][-2:]
