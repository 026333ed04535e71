"""What cutting and merging move: triples lie by their subjects, and whoever names no piece of a line is not looked up again."""

from pyspark.sql import functions as F

from sluice import terms as T
from sluice.operators import clip
from sluice.operators.graph import Graph
from sluice.terms import Terms

ROW = "part int, s string, p string, o string, kind string, lang string, dt string, pos long"


def test_merging_keeps_what_a_cut_line_says_beside_its_geometry(spark):
    t, rows = Terms(), []
    for i, text in enumerate(("0 0 5 0", "5 0 9 0")):
        s = f"l{clip.TAIL}{i}"
        rows += [(i, s, t.has_value, f"<gml:LineString><gml:posList>{text}</gml:posList></gml:LineString>", "L", None, T.GML_LITERAL, 1), (i, s, t.has_value, "a note", "L", None, None, 2), (i, "o", t.has_aspect, s, "I", None, None, 3), (i, "k", "http://e/p", s, "I", None, None, 4), (i, "k", T.TYPE, "K", "I", None, None, 5)]
        rows += [(i, s, p, o, "L", None, None, 1) for p, o in ((clip.ORIGIN, "l"), (clip.SEQUENCE, str(i)), (clip.COUNT, "2"), *([(clip.INSERTED_END, "true")] if i == 0 else []))]
    rows.append((0, "k", "http://e/p", "l", "I", None, None, 6))
    got = sorted((r["s"], r["p"], r["o"]) for r in clip.merge(spark.createDataFrame(rows, ROW), t).collect())
    assert got == sorted([("l", t.has_value, "<gml:LineString><gml:posList>0 0 9 0</gml:posList></gml:LineString>"), ("l", t.has_value, "a note"), ("o", t.has_aspect, "l"), ("k", "http://e/p", "l"), ("k", T.TYPE, "K")])


def test_triples_by_subject_are_deduplicated_and_stay_where_they_are(spark):
    rows = spark.createDataFrame([("a", T.TYPE, "K", "I", None, None, 2), ("a", T.TYPE, "K", "I", None, None, 1), ("b", T.TYPE, "K", "I", None, None, 3)], ROW.removeprefix("part int, "))
    g = Graph.by_subject(rows, Terms())
    assert sorted((r["s"], r["pos"]) for r in g.triples.collect()) == [("a", 1), ("b", 3)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = g.triples.join(Graph.by_subject(rows, Terms()).triples.groupBy("s").agg(F.count("*").alias("n")), "s")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
