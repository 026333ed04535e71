"""GML literals as columns: kind, dimension, coordinates and heights, all in JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the literal form.
KIND = r"<gml:(Point|LineString|Polygon|LinearRing)\b"
DIMENSION = r'srsDimension="(\d+)"'
COORDINATES = r"<gml:(?:pos|posList)[^>]*>([^<]*)</gml:(?:pos|posList)>"
MULTI = r"<gml:(Multi(?:Point|Curve|Surface|LineString|Polygon|Geometry))\b"

GEOMETRY = "struct<kind:string,xs:array<double>,ys:array<double>>"


def kind(literal: Column) -> Column:
    found = F.regexp_extract(literal, KIND, 1)
    return F.when(found == "LinearRing", F.lit("Polygon")).when(found != "", found)


def is_multipart(literal: Column) -> Column:
    return literal.rlike(MULTI) | (F.regexp_count(literal, F.lit(COORDINATES)) > 1)


def coordinate_tokens(literal: Column) -> Column:
    """The texts of the first coordinate list, without judgement; empty if there is none."""
    body = F.trim(F.regexp_replace(F.regexp_extract(literal, COORDINATES, 1), r"\s+", " "))
    return F.when(literal.isNull(), F.lit(None)).when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, " "))


def has_dimension(literal: Column) -> Column:
    return literal.rlike(r'srsDimension="\d+"')


def replace_coordinates(literal: Column, new: Column) -> Column:
    """The literal with another text in its first coordinate list; all else stays to the letter."""
    whole = F.regexp_extract(literal, COORDINATES, 0)
    head = F.regexp_extract(whole, r"^(<gml:(?:pos|posList)[^>]*>)", 1)
    tail = F.regexp_extract(whole, r"(</gml:(?:pos|posList)>)$", 1)
    at = F.instr(literal, whole)
    rest = F.substring(literal, at + F.length(whole), F.length(literal))
    return F.when(whole == "", literal).otherwise(F.concat(F.substring(literal, F.lit(1), at - 1), head, new, tail, rest))


def tokens_per_point(literal: Column, points: Column) -> Column:
    """How many texts a point has; null if they don't divide evenly."""
    n = F.size(coordinate_tokens(literal))
    return F.when((points > 0) & (n > 0) & (n % points == 0), (n / points).cast("int"))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once, however often it is used; a plain column expression is put in at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _dimension(said: Column, n: Column) -> Column:
    return F.when(said != "", said.try_cast("int")).when(n.isin(2, 3), n).when(n % 2 == 0, F.lit(2)).when(n % 3 == 0, F.lit(3))


def dimension(literal: Column) -> Column:
    """What is declared anywhere in the literal, else guessed from the number of values; null if that fails."""
    return _dimension(F.regexp_extract(literal, DIMENSION, 1), F.size(coordinate_tokens(literal)))


def parsed(literal: Column) -> Column:
    """struct(geom, zs, error) of a literal: the first coordinate list in the plane, a height (or null) per point, or what is wrong."""
    number = lambda t: F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double"))
    read = F.struct(kind(literal).alias("k"), (F.regexp_extract(literal, COORDINATES, 0) != "").alias("listed"), F.transform(coordinate_tokens(literal), number).alias("values"), F.regexp_extract(literal, DIMENSION, 1).alias("said"))
    return F.when(literal.isNotNull(), once(read, lambda r: once(F.struct(r["k"].alias("k"), r["listed"].alias("listed"), r["values"].alias("values"), F.size(r["values"]).alias("n"), _dimension(r["said"], F.size(r["values"])).alias("d")), _judged)))


def _judged(r: Column) -> Column:
    """What parsed gives, of a literal's kind k, listed, values, their number n and dimension d."""
    k, values, n, d = r["k"], r["values"], r["n"], r["d"]
    m = F.when((d > 1) & (n > 0), (n / d).cast("int"))
    pick = lambda at, most: F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.get(values, i * d + at))
    error = (
        F.when(k.isNull(), F.lit("unknown geometry kind"))
        .when(~r["listed"], F.lit("no coordinates"))
        .when(F.exists(values, lambda v: v.isNull()), F.lit("a coordinate is not a number"))
        .when(d.isNull() | (d < 2), F.lit("the dimension does not fit"))
        .when((n == 0) | (n % d != 0), F.lit("coordinates do not divide into points"))
        .when((k == "LineString") & (m < 2), F.lit("a line of fewer than two points"))
        .when((k == "Polygon") & (m < 3), F.lit("a ring of fewer than three points"))
    )
    zs = F.when(d >= 3, pick(2, m)).otherwise(F.array_repeat(F.lit(None).cast("double"), m))
    most = F.when(k == "Point", F.lit(1)).otherwise(m)
    good = F.struct(F.struct(k.alias("kind"), pick(0, most).alias("xs"), pick(1, most).alias("ys")).alias("geom"), zs.alias("zs"), F.lit(None).cast("string").alias("error"))
    bad = lambda e: F.struct(F.lit(None).cast(GEOMETRY).alias("geom"), F.array().cast("array<double>").alias("zs"), e.alias("error"))
    return once(error, lambda e: F.when(e.isNotNull(), bad(e)).otherwise(good))
