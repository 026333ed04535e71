"""A dataset's triples, and its access paths as set-wise DataFrames.

Columns of triples: s, p, o (blank nodes as `_:label`), kind of o ('I', 'B' or 'L'), lang, dt, pos. A
triple that is written more than once counts once, at its first place, and whatever comes first in
the source comes first in results: `ord` columns carry that order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import terms as T
from sluice.terms import Terms

COLUMNS = ("s", "p", "o", "kind", "lang", "dt")
SCHEMA = "s string, p string, o string, kind string, lang string, dt string, pos long"


def text_of(term: Column) -> Column:
    """A term's text: blank nodes lose their mark."""
    return F.when(term.startswith("_:"), F.substring(term, 3, 1 << 20)).otherwise(term)


def deduplicated(statements: DataFrame) -> DataFrame:
    """Each triple once, at its first place; a datatype of plain strings is dropped before."""
    dt = F.when(F.col("dt") != T.STRING, F.col("dt")).alias("dt")
    return statements.select("s", "p", "o", "kind", "lang", dt, "pos").groupBy(*COLUMNS).agg(F.min("pos").alias("pos"))


class Graph:
    """Triples with the terms of their base."""

    def __init__(self, statements: DataFrame, terms: Terms | None = None, distinct: bool = False):
        self.terms = terms or Terms()
        self.triples = statements if distinct else deduplicated(statements)

    def stored(self) -> Graph:
        """The same graph, its triples written once by predicate: whoever asks for one predicate reads its files alone."""
        import uuid

        from sluice.operators.fixpoint import shared_folder

        spark = self.triples.sparkSession
        path = f"{shared_folder(spark)}/sluice-triples-{uuid.uuid4().hex}"
        self.triples.hint("rebalance", F.col("p")).write.partitionBy("p").parquet(path)
        return Graph(spark.read.schema(self.triples.schema).parquet(path).select(*COLUMNS, "pos"), self.terms, distinct=True)

    @classmethod
    def by_subject(cls, statements: DataFrame, terms: Terms | None = None) -> Graph:
        """The graph of statements, its triples written once in buckets of their subjects: what is joined on a subject moves none of them."""
        from sluice.operators.properties import bucketed

        return cls(bucketed(statements.select(*COLUMNS, "pos"), "s", deduplicated), terms, distinct=True)

    @cached_property
    def properties(self):
        """The property table (sluice.operators.properties), lazily."""
        from sluice.operators.properties import Properties

        return Properties(self)

    def count(self) -> DataFrame:
        return self.triples.agg(F.count("*").alias("n_triples"))

    def with_predicates(self, *predicates: str) -> DataFrame:
        """The triples of some predicates, given in full or by their names."""
        return self.triples.filter(F.col("p").isin([self.terms.iri(p) for p in predicates]))

    def statements_of(self, *predicates: str) -> DataFrame:
        """As with_predicates, but a triple may come more than once: for those who take the first place anyway."""
        return self.with_predicates(*predicates)

    def statements_with(self, classes: tuple[str, ...], *predicates: str) -> DataFrame:
        """As statements_of, but other types than some classes may be missing, and what is said of subjects, or of members by their holders, that have none of them."""
        return self.statements_of(*predicates)

    def statements_near(self, classes: tuple[str, ...], *predicates: str) -> DataFrame:
        """As statements_of, but subjects that neither have some of the classes nor an aspect that has may be missing."""
        return self.statements_of(*predicates)

    def of(self, predicate: str) -> DataFrame:
        """(s, o, kind, lang, dt, pos) of a predicate, given in full or by its name."""
        return self.with_predicates(predicate).drop("p")

    def objects(self, subject: str, predicate: str) -> DataFrame:
        return self.of(predicate).filter(F.col("s") == subject).orderBy("pos")

    def subjects(self, predicate: str, obj: str) -> DataFrame:
        return self.of(predicate).filter(F.col("o") == obj).orderBy("pos")

    def value(self, predicate: str) -> DataFrame:
        """(s, o): the first object of each subject."""
        return self.statements_of(predicate).repartition("s").groupBy("s").agg(F.min_by("o", "pos").alias("o"))

    def contains(self, asked: DataFrame) -> DataFrame:
        """The rows of asked (s, p, o) that are triples with a resource as object."""
        return asked.join(self.triples.filter("kind <> 'L'").select("s", "p", "o"), ["s", "p", "o"], "left_semi")

    def known_subjects(self, asked: DataFrame) -> DataFrame:
        return asked.join(self.triples.select("s"), "s", "left_semi")

    def types(self) -> DataFrame:
        """(s, type, pos)."""
        return self.of(T.TYPE).filter("kind <> 'L'").select("s", F.col("o").alias("type"), "pos")

    def type_statements(self, *classes: str) -> DataFrame:
        """(s, type, pos), of some classes by name or IRI if any are given; a type may come more than once."""
        rows = self.statements_with(classes, T.TYPE).filter("kind <> 'L'").select("s", F.col("o").alias("type"), "pos")
        return rows.filter(F.col("type").isin([self.terms.iri(c) for c in classes])) if classes else rows

    def of_types(self, *classes: str) -> DataFrame:
        """The distinct subjects that have one of these classes by name or IRI."""
        hits = self.types().filter(F.col("type").isin([self.terms.iri(c) for c in classes])).select("s")
        return hits if len(classes) == 1 else hits.distinct()  # of one class triples have a subject once

    def _both_ways(self, forward: str, inverse: str, by: str | None = None, classes: tuple[str, ...] = ()) -> DataFrame:
        """By a column the rows are dealt out by it alone, so that who joins on it moves them no second time. Members without any of some classes may be missing."""
        rows = self.statements_with(classes, forward, inverse).filter("kind <> 'L'")
        there, back = (F.col("p") == self.terms.iri(x) for x in (forward, inverse))
        one = rows.filter(there).select(F.col("s").alias("holder"), F.col("o").alias("member"), F.lit(0).alias("way"), "pos")
        two = rows.filter(back).select(F.col("o").alias("holder"), F.col("s").alias("member"), F.lit(1).alias("way"), "pos")
        # From the holder the forward writing is its own triples and comes first; from the member the same way of writing does too.
        both = one.unionAll(two)
        return (both.repartition(by) if by else both).groupBy("holder", "member").agg(F.min(F.struct("way", "pos")).alias("ord"))

    def parts(self, by: str | None = None, classes: tuple[str, ...] = ()) -> DataFrame:
        """(holder, member, ord), however it is written; ord orders the members of a holder and the holders of a member."""
        return self._both_ways(self.terms.has_part, self.terms.is_part_of, by, classes)

    def aspects(self, by: str | None = None, classes: tuple[str, ...] = ()) -> DataFrame:
        return self._both_ways(self.terms.has_aspect, self.terms.is_aspect_of, by, classes)

    def connections(self, once: bool = True) -> DataFrame:
        """(a, b, ord) in both directions, both kept where both are written; not `once`, a triple may come more than once."""
        t = (self.with_predicates if once else self.statements_of)(self.terms.has_connection).filter("kind <> 'L'")
        return t.select(F.col("s").alias("a"), F.col("o").alias("b"), F.struct(F.lit(0).alias("way"), "pos").alias("ord")).unionAll(t.select(F.col("o").alias("a"), F.col("s").alias("b"), F.struct(F.lit(1).alias("way"), "pos").alias("ord")))

    def neighbours(self) -> DataFrame:
        return self.connections().groupBy("a", "b").agg(F.min("ord").alias("ord"))

    def holders(self, member: str) -> DataFrame:
        return self.parts().filter(F.col("member") == member).orderBy("ord").select("holder")

    def carriers(self, member: str) -> DataFrame:
        return self.aspects().filter(F.col("member") == member).orderBy("ord").select("holder")

    def same_text(self, asked: DataFrame) -> DataFrame:
        """asked (text) with the subject it names: an IRI, else a blank node of that name."""
        subjects = self.triples.select("s").distinct()
        iri = asked.join(subjects, asked["text"] == subjects["s"], "left").select("text", "s")
        bnode = subjects.filter(F.col("s").startswith("_:")).select(text_of(F.col("s")).alias("text"), F.col("s").alias("b"))
        return iri.join(bnode, "text", "left").select("text", F.coalesce("s", "b").alias("s"))


def first_distinct(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """Each key once, at its first place."""
    return rows.groupBy(key).agg(F.min(order).alias("ord"))
