"""The RDF vocabulary that datasets are written in.

Only its base differs between versions; it is found once on the driver and goes into plans as literals.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

# Namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
GEO = "http://www.opengis.net/ont/geosparql#"
BASE_PATTERN = r"http://data\.gwsw\.nl/(\d+\.\d+)/totaal/"
BASE_FORMAT = "http://data.gwsw.nl/{}/totaal/"

DEFAULT_VERSION = "1.6"
KNOWN_VERSIONS = ("1.6", "1.7")
DEFAULT_BASE = BASE_FORMAT.format(DEFAULT_VERSION)

TYPE = RDF + "type"
FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"
LABEL, SUBCLASS = RDFS + "label", RDFS + "subClassOf"
GML_LITERAL, STRING = GEO + "gmlLiteral", XSD + "string"
DEFAULT_PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "geo": GEO, "skos": SKOS, "owl": OWL}


@dataclass(frozen=True)
class Terms:
    """The names of one base. Class and property names of the vocabulary are Dutch."""

    base: str = DEFAULT_BASE

    def iri(self, name: str) -> str:
        """Short names get the base; full IRIs stay."""
        return name if name.startswith("http") else self.base + name

    # Names in the vocabulary.
    @property
    def has_aspect(self) -> str:
        return self.base + "hasAspect"

    @property
    def is_aspect_of(self) -> str:
        return self.base + "isAspectOf"

    @property
    def has_part(self) -> str:
        return self.base + "hasPart"

    @property
    def is_part_of(self) -> str:
        return self.base + "isPartOf"

    @property
    def has_connection(self) -> str:
        return self.base + "hasConnection"

    @property
    def has_value(self) -> str:
        return self.base + "hasValue"

    @property
    def has_reference(self) -> str:
        return self.base + "hasReference"

    @property
    def function(self) -> str:
        return self.base + "functie"

    @property
    def datatype_prefix(self) -> str:
        return self.base + "Dt_"


# Classes the readers know by name.
NODE_ROLE, EDGE_ROLE = "Knooppunt", "Verbinding"
FITTING_ROLE = "Hulpstukorientatie"
POINT, LINE = "Punt", "Lijn"
COVER, COVER_LEVEL = "Putdeksel", "Putdekselniveau"
GROUND_ROLE, GROUND_LEVEL = "Maaiveldorientatie", "Maaiveldhoogte"
PROVENANCE, METHOD, METHOD_DATE = "Inwinning", "WijzeVanInwinning", "DatumInwinning"
BEGIN_POINTS = ("BeginpuntLeiding", "BeginpuntOnderdeel", "BeginpuntAfvoerrelatie")
END_POINTS = ("EindpuntLeiding", "EindpuntOnderdeel", "EindpuntAfvoerrelatie")
BEGIN_INVERT, END_INVERT = "BobBeginpuntLeiding", "BobEindpuntLeiding"
ATTRIBUTE = "Kenmerk"
PHANTOM_TAIL = "_put"


@dataclass(frozen=True)
class Base:
    """A base of the vocabulary, which differs between versions only."""

    version: str

    def __str__(self) -> str:
        return BASE_FORMAT.format(self.version)

    @classmethod
    def read(cls, text: str | None, whole: bool = False) -> Base | None:
        """The base that a text begins with, or, if `whole`, that it is."""
        found = _BASE.match(text or "")
        return cls(found[1]) if found and not (whole and found.end() < len(text)) else None


_BASE = re.compile(BASE_PATTERN)
#: The prefix that datasets declare their base under.
BASE_PREFIX = "gwsw"


def terms_of(prefixes: Mapping[str, str], predicates: Iterable[str] = ()) -> Terms:
    """Terms of a dataset: of the base that its own prefix declares, else that the first predicate with one has, else of the default, with a warning."""
    bases = (Base.read(prefixes.get(BASE_PREFIX), whole=True), *map(Base.read, predicates))
    known = [str(b) for b in bases if b]
    if not known:
        warnings.warn(f"no vocabulary base found; reading as version {DEFAULT_VERSION}", stacklevel=2)
    return Terms(known[0] if known else DEFAULT_BASE)


def local_name(iri: str) -> str:
    """What follows the last `/` or `#`."""
    return re.search(r"[^/#]*\Z", iri)[0]
