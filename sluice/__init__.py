"""Sluice: a Spark-first analytics engine for urban-drainage RDF exports.

The names of `__all__` are the public surface; they are imported when they are first asked for.
"""

from importlib import import_module

#: Where each public name lives.
_PUBLIC = {
    "Dataset": "sluice.operators.domain",
    "Graph": "sluice.operators.graph",
    "Hierarchy": "sluice.operators.hierarchy",
    "Store": "sluice.sources.sink",
    "Terms": "sluice.terms",
    "clip": "sluice.operators.clip",
    "clip_file": "sluice.operators.clip",
    "load_dataset": "sluice.sources.ontology",
    "load_graph": "sluice.sources.turtle",
    "merge_files": "sluice.operators.clip",
    "open_for_rewrite": "sluice.sources.sink",
    "read_layer": "sluice.sources.geojson",
    "ready": "sluice.session",
    "register": "sluice.sources.turtle",
    "rewrite": "sluice.sources.sink",
    "rewrite_folder": "sluice.sources.sink",
    "write_file": "sluice.sources.sink",
    "write_folder": "sluice.sources.sink",
    "write_parts": "sluice.sources.sink",
}
_RENAMED = {"load_graph": "load"}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module 'sluice' has no attribute {name!r}")
    return getattr(import_module(_PUBLIC[name]), _RENAMED.get(name, name))
