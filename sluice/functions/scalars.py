"""Column functions on names, numbers and dates, and on objects' attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.terms import BASE_PATTERN

#: What both Python's float() and Spark's cast read as the same number. float() also takes "_" between
#: digits, and digits beyond ASCII, which give null here; the cast also takes a final d or f, which
#: gives null too.
NUMBER = r"^[\s]*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?|nan))[\s]*$"


def short_name(iri: Column) -> Column:
    return F.substring_index(F.substring_index(iri, "/", -1), "#", -1)


def full_name(name: Column, base: str) -> Column:
    return F.when(name.startswith("http"), name).otherwise(F.concat(F.lit(base), name))


def base_of(iri: Column) -> Column:
    """The vocabulary base that an IRI starts with, else null."""
    found = F.regexp_extract(iri, "^" + BASE_PATTERN, 0)
    return F.when(found != "", found)


def version_of(iri: Column) -> Column:
    found = F.regexp_extract(iri, "^" + BASE_PATTERN + "$", 1)
    return F.when(found != "", found)


def number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.trim(F.regexp_replace(text, r"\s", "")).try_cast("double"))


def date_of(text: Column) -> Column:
    """The date that a text starts with, or the first day of a year that it is; null if neither, or no such day."""
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    year = F.regexp_extract(text, r"^\s*(\d{4})\s*$", 1)
    known = F.when(iso != "", F.when(~iso.startswith("0000"), iso.try_cast("date"))).when((year != "") & (year != "0000"), F.concat(year, F.lit("-01-01")).try_cast("date"))
    return known


def first_of_kind(aspects: Column, kind: str) -> Column:
    return F.get(F.filter(aspects, lambda a: a["kind"] == kind), F.lit(0))


def aspect_number(aspects: Column, kind: str) -> Column:
    return number(first_of_kind(aspects, kind)["value"])


def aspect_reference(aspects: Column, kind: str) -> Column:
    return first_of_kind(aspects, kind)["reference"]


def aspect_date(aspects: Column, kind: str) -> Column:
    return date_of(first_of_kind(aspects, kind)["value"])


def node_columns() -> dict[str, Column]:
    """Derived fields of nodes: levels in metres; heights are given in millimetres."""
    ground, cover = number(F.col("ground_aspect.value")), number(F.col("cover_aspect.value"))
    height = aspect_number(F.col("aspects"), "HoogtePut") / 1000
    top = F.coalesce(cover, ground)
    return {"ground": ground, "cover": cover, "top": top, "height_m": height, "bottom": top - height}


def conduit_columns() -> dict[str, Column]:
    """Derived fields of conduits."""
    begin, end = number(F.col("bob_start_aspect.value")), number(F.col("bob_end_aspect.value"))
    a = F.col("aspects")
    return {
        "z_start": F.get("z_values", F.lit(0)),
        "z_end": F.get("z_values", F.size("z_values") - 1),
        "invert_start": begin,
        "invert_end": end,
        "invert_fall": begin - end,
        "width_mm": aspect_number(a, "BreedteLeiding"),
        "height_mm": aspect_number(a, "HoogteLeiding"),
        "length_m": aspect_number(a, "LengteLeiding"),
        "material": aspect_reference(a, "MateriaalLeiding"),
        "shape": aspect_reference(a, "VormLeiding"),
        "start_year": F.year(aspect_date(a, "Begindatum")),
    }
