"""Which ontologies a dataset is read with.

No vocabulary comes with this package. A folder can hold some, one file per version; a dataset is then
read with that of its own version, else with the default version's, and a warning. An explicit list
of paths is stacked in its order; an empty list is a deliberate none.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import SparkSession

from sluice import terms as T
from sluice.operators.domain import Dataset
from sluice.operators.graph import Graph
from sluice.sources import turtle


def path_for(folder: str, version: str) -> str:
    if version not in T.KNOWN_VERSIONS:
        raise ValueError(f"unknown version {version!r}; known are {', '.join(T.KNOWN_VERSIONS)}")
    return f"{folder.rstrip('/')}/{version}.ttl"


def chosen(base: str, folder: str | None, paths: Sequence[str] | None) -> list[str]:
    """The files to read: the list if there is one, else the folder's for the base's version, else none."""
    if paths is not None:
        return list(paths)
    if folder is None:
        return []
    found = T.Base.read(base, whole=True)
    version = found.version if found else None
    if version not in T.KNOWN_VERSIONS:
        warnings.warn(f"no ontology of version {version}; reading with {T.DEFAULT_VERSION}", stacklevel=2)
        version = T.DEFAULT_VERSION
    return [path_for(folder, version)]


def load_dataset(spark: SparkSession, path: str, folder: str | None = None, ontologies: Sequence[str] | None = None, fallback: str | None = None) -> Dataset:
    """A Turtle export as a dataset; without an ontology its own class hierarchy counts."""
    graph: Graph = turtle.load(spark, path, fallback=fallback)
    files = chosen(graph.terms.base, folder, ontologies)
    return Dataset.load(graph, turtle.load(spark, *files) if files else None)
