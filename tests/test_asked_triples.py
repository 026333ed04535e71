"""The network of the tables makes of its rows only what a question can need, and a few triples in one select."""

from pathlib import Path

import pytest

from sluice import terms as T
from sluice.operators.domain import Reader
from sluice.operators.hierarchy import Hierarchy
from sluice.plans import queries as plans
from sluice.sources import tables

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_select_makes_more_triples_than_are_compiled_well(spark):
    made = tables.customer_triples(spark, str(DATA))
    assert "array_compact" not in _plan(made)
    assert max(line.count("struct(") for line in _plan(made).split("Generate ")) <= tables.AT_ONCE
    assert made.filter("p is null").isEmpty() and made.count() == made.select("pos").distinct().count()


def test_triples_of_a_row_whose_key_is_null_stay(spark):
    t = tables.Triples(tables.F.col("k"))
    t.add(tables.iri("x", tables.F.col("k")), "hasPart", tables.F.lit("y"))
    t.add(tables.iri("x", tables.F.col("k")), "hasPart", tables.F.lit("z"), when=tables.F.col("k") > 1)
    assert sorted(str(r["s"]) for r in t.of(spark.createDataFrame([(1,), (None,)], "k long")).collect()) == ["None", tables.NET + "x1"]


def test_what_is_left_out_is_about_other_classes(spark):
    g = tables.graph(spark, str(DATA), items=True)
    reader = Reader(g, Hierarchy.of(tables.class_graph(spark, str(DATA))))
    for role, other in ((T.NODE_ROLE, "o_orderkey"), (T.EDGE_ROLE, "s_suppkey")):
        names = reader.around(role)
        held, every = (g.aspects(classes=c) for c in (names, ()))
        member = g.type_statements(*names).select("s").distinct().withColumnRenamed("s", "member")
        assert held.join(member, "member").exceptAll(every.join(member, "member")).isEmpty()
        assert held.join(member, "member").count() == every.join(member, "member").count()
        who = every.join(member, "member").selectExpr("explode(array(holder, member)) AS s").distinct()
        near = reader.types_around(role)
        assert other not in _plan(near) and "l_linestatus" not in _plan(near)
        assert near.join(who, "s").exceptAll(reader.types.join(who, "s")).isEmpty()
        assert near.join(who, "s").count() == reader.types.join(who, "s").count()


def test_who_may_be_typed_in_another_table_is_never_left_out(spark):
    t = tables._item_rows()
    assert t.near([tables.TERMS.iri("Flag_A")]) is None and t.near([tables.TERMS.iri("Put")]) == set()


def test_most_specific_types_of_nodes_read_no_order(spark):
    assert "o_orderpriority" not in _plan(plans.QUERIES["most_specific_type"](spark, str(DATA)))
